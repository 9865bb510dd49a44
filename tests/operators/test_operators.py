"""Operators against plain Python on random rows, readers on files, streams on memory."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.operators import duplicates, joins, ordered, ranking, rulebook, state, vectors
from tributary.sources import tables, xbrl
from tributary.streaming import events


def test_capped_top_k_is_the_greedy_pass(spark):
    rng = random.Random(1)
    rows = [(g, f"s{rng.randrange(3)}", rng.random(), i) for i, g in enumerate(rng.choices(range(8), k=200))]
    df = spark.createDataFrame(rows, "g int, s string, x double, id int")
    got = {(r.g, r.id) for r in ranking.capped_top_k(df, ["g"], "s", [F.desc("x"), F.asc("id")], 2, 4).collect()}
    want = set()
    for g in range(8):
        used, taken = Counter(), 0
        for _, s, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[3])):
            if used[s] < 2 and taken < 4:
                used[s] += 1
                taken += 1
                want.add((g, i))
    assert got == want


def test_tolerance_join_is_the_theta_join(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(3), round(rng.uniform(-5, 5), 2)) for i in range(80)]
    right = [(i, rng.randrange(3), round(rng.uniform(-5, 5), 2)) for i in range(80)]
    got = joins.tolerance_join(spark.createDataFrame(left, "a int, k int, x double"), spark.createDataFrame(right, "b int, k int, y double"), "x", "y", 0.5, ["k"])
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((a, b) for a, k, x in left for b, m, y in right if k == m and abs(x - y) <= 0.5)


def test_cascade_stops_at_an_ambiguous_tier(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id int, p string, q string")
    right = spark.createDataFrame([(10, "a", "x"), (11, "a", "x"), (12, "b", "w")], "other int, p string, q string")
    got = {r.id: (r.tier, r.status, r.matched_other) for r in joins.cascading_match(left, right, [["p", "q"], ["p"]], "other").collect()}
    assert got == {1: (1, "ambiguous", None), 2: (2, "ambiguous", None), 3: (2, "matched", 12)}


def test_ranges_keep_every_point(spark):
    points = spark.createDataFrame([(i, "a", i) for i in range(10)], "id int, k string, p int")
    spans = spark.createDataFrame([("a", 2, 5), ("a", 4, 7), ("b", 0, 9)], "k string, s int, e int")
    got = {r.id: r.status for r in joins.point_in_range(points, spans, ["k"], "p", "s", "e", "id").collect()}
    assert got == {i: "ambiguous" if i == 4 else "assigned" if 2 <= i < 7 else "unassigned" for i in range(10)}


def test_ranges_with_nulls_and_ends(spark):
    rng = random.Random(5)
    part = lambda: rng.choice([None, *range(20)])
    points = [(i // 2, rng.choice(["a", "b", None]), part()) for i in range(120)]
    spans = [(rng.choice(["a", "b", None]), part(), part()) for _ in range(40)]
    held = lambda k, p: sum(k is not None and k == x and None not in (p, s) and p >= s and (e is None or p < e) for x, s, e in spans)
    got = joins.point_in_range(spark.createDataFrame(points, "id int, k string, p int"), spark.createDataFrame(spans, "k string, s int, e int"), ["k"], "p", "s", "e", "id")
    assert sorted(map(str, ((r.id, r.k, r.p, r.n_ranges) for r in got.collect()))) == sorted(str((i, k, p, held(k, p))) for i, k, p in points)


def test_leave_one_out_is_a_loop_over_folds(spark):
    rng = random.Random(3)
    rows = [(f"f{rng.randrange(4)}", rng.randrange(5), f"t{rng.randrange(3)}") for _ in range(150)]
    got = {r.fold: (r.observations, r.predicted, r.correct) for r in rulebook.leave_one_out(spark.createDataFrame(rows, "fold string, p int, t string"), ["p"], "t", "fold", 2).collect()}
    for fold in {r[0] for r in rows}:
        counts = defaultdict(Counter)
        for f, p, t in rows:
            if f != fold:
                counts[p][t] += 1
        rule = {p: min((t for t in c if c[t] >= 2), key=lambda t: (-c[t], t), default=None) for p, c in counts.items()}
        own = [(rule.get(p), t) for f, p, t in rows if f == fold]
        assert got[fold] == (len(own), sum(r is not None for r, _ in own), sum(r == t for r, t in own))


def test_merge_folds_in_source_order(spark):
    rows = [("r", "lexical", 0.5, "high"), ("r", "deterministic", 0.6, "low"), ("r", "dictionary", 0.7, "low"), ("q", "lexical", 0.3, "low")]
    df = spark.createDataFrame(rows, "row string, source string, score double, risk string")
    got = {r.row: (r.score, r.n_sources, r.risk) for r in ranking.merge_candidates(df, ["row"], "source", "score", "risk", ["deterministic", "dictionary", "lexical"]).collect()}
    assert got == {"r": (0.775, 3, "high"), "q": (0.3, 1, "low")}


def test_ordered(spark):
    df = spark.createDataFrame([(1, "h", "A"), (2, "r", None), (3, "h", "B"), (4, "r", None)], "p int, kind string, v string").withColumn("g", F.lit(1))
    assert [r.s for r in ordered.as_of(df, ["g"], ["p"], F.col("kind") == "h", F.col("v"), "s").orderBy("p").collect()] == ["A", "A", "B", "B"]
    assert [r.s for r in ordered.nearest(df, ["g"], ["p"], F.col("p"), F.col("kind") == "h", F.col("v"), "s").orderBy("p").collect()] == ["B", "B", "A", "B"]
    ends = ordered.range_ends(df, ["g"], "p", F.lit(9)).orderBy("p").collect()
    assert [r.end for r in ends] == [1, 2, 3, 9]


def test_survivors_and_backfill(spark):
    df = spark.createDataFrame([("k", "total", 2, "5"), ("k", "exact", 3, "5"), ("m", "x", 1, "1"), ("m", "x", 2, "2"), ("n", "x", 4, None)], "k string, role string, id int, v string")
    got = {r.k: (r.survivor, r.action) for r in duplicates.survivors(df, ["k"], "role", ["exact", "total"], "id", "v").collect()}
    assert got == {"k": (3, "dedupe"), "m": (1, "manual"), "n": (4, "keep")}
    filled = duplicates.unique_backfill(spark.createDataFrame([("a", "x"), ("a", " "), ("b", "x"), ("b", "y"), ("b", None)], "k string, v string"), ["k"], "v", "f").collect()
    assert sorted((r.k, r.f or "") for r in filled) == [("a", "x"), ("a", "x"), ("b", ""), ("b", "x"), ("b", "y")]


def test_vectors_of_no_length(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    got = vectors.nearest_vectors(df.where("id = 1"), df, 5, "id", "id", "v").collect()
    assert [(r.id, r.score) for r in got] == [(2, 0.0), (3, 0.0)]
    assert df.select(vectors.truncated(F.col("v"), 1).alias("t")).collect()[2].t == [1.0]


def test_state(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["start", "run", "done", "run"])], "k int, i int, s string")
    got = state.transitions(df, ["k"], ["i"], "s", [("start", "run"), ("run", "done")]).orderBy("i").collect()
    assert [r.legal for r in got] == [True, True, True, False]
    ended = state.terminal_once(df.withColumn("t", F.col("s") == "done"), ["k"], ["i"], "t").orderBy("i").collect()
    assert [r.sequence for r in ended] == [1, 2, 3, None]


def test_report_files(spark, tmp_path):
    report = {"case_reports": [{"case_id": "c1", "candidates": [
        {"label": "Revenue", "value": "1,234", "previous_value": "1,000", "row_type": "numeric_fact", "current_year": 2023, "confidence": 7.0},
        {"label": "Note", "value": "x", "row_type": "heading", "current_year": 3},
    ]}]}
    (tmp_path / "a.json").write_text(json.dumps(report))
    (tmp_path / "b.json").write_text("{broken")
    rows = tables.read_reports(spark, str(tmp_path))
    assert rows.count() == 2
    flat = tables.flatten_candidates(rows).orderBy("candidate_index").collect()
    assert [(r.candidate_id, r.confidence, r.current_year) for r in flat] == [("c1:candidate:0:0", 1.0, 2023), ("c1:candidate:0:1", 0.0, None)]
    seen = tables.observations(tables.flatten_candidates(rows)).collect()
    assert sorted((r.value_role, r.pdf_value, r.expected_year) for r in seen) == [("current", "1,234", 2023), ("prior", "1,000", 2022)]
    (tmp_path / "codes.csv").write_text("filename,new_code\nx,123456\ny,12\n")
    assert [r.valid for r in tables.code_rows(spark, str(tmp_path / "codes.csv")).collect()] == [True, False]
    tables.write_csv(spark.createDataFrame([("b", 1), ("a", 2)], "k string, n int"), str(tmp_path / "out"), ["k"])
    assert [r.k for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == ["a", "b"]


INSTANCE = """<xbrl xmlns:a="u"><context id="c1"><entity><identifier scheme="s">E1</identifier></entity><period><startDate>2023-01-01</startDate><endDate>2023-12-31</endDate></period>
<scenario><xbrldi:explicitMember dimension="a:D">a:M</xbrldi:explicitMember></scenario></context>
<context id="c2"><entity><identifier scheme="s">E1</identifier></entity><period><instant>2023-12-31</instant></period></context>
<unit id="u1"><measure>iso4217:EUR</measure></unit>
<a:Revenue contextRef="c1" unitRef="u1" decimals="0">(50)</a:Revenue><a:Name contextRef="c2">Firm &amp; Co</a:Name><a:Lost contextRef="c9" unitRef="u9">1</a:Lost><a:None contextRef="c2" xsi:nil="true"/></xbrl>"""


def test_instances(spark, tmp_path):
    (tmp_path / "a.xbrl").write_text(INSTANCE)
    (tmp_path / "b.xbrl").write_text("<!DOCTYPE x>" + INSTANCE)
    own = xbrl.read_instances(spark, str(tmp_path))
    got = {r.qname: r for r in xbrl.facts(own).collect()}
    assert set(got) == {"a:Revenue", "a:Name", "a:Lost", "a:None"}
    assert (got["a:Revenue"].period_end, got["a:Revenue"].measures, got["a:Revenue"].dimensions) == ("2023-12-31", ["iso4217:EUR"], ["a:D=a:M"])
    assert got["a:Lost"].warnings == ["missing_context_ref", "missing_unit_ref"] and got["a:None"].is_nil and not got["a:Name"].is_numeric


def test_label_linkbase(spark):
    text = '<linkbase><loc xlink:href="x.xsd#a_B" xlink:label="l1"/><labelArc xlink:from="l1" xlink:to="t1"/><label xlink:label="t1" xml:lang="en">Bee</label></linkbase>'
    df = spark.createDataFrame([("p", text)], "path string, text string")
    assert [tuple(r) for r in xbrl.concept_labels(df).collect()] == [("a_B", "Bee")]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", "run", 1.0), (1, "2024-01-01 00:00:02", "done", 2.0), (1, "2024-01-01 00:00:03", "run", 4.0), (2, "2024-01-01 01:00:00", "run", 8.0)]
    df = spark.createDataFrame(rows, "k long, t string, s string, v double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for i, (out, mode) in enumerate([(events.windowed(stream, "ts", "1 minute", "10 minutes", ["k"], "v"), "complete"), (events.latest(stream, ["k"], ["ts"]), "complete"), (events.terminal_once(stream, "k", "ts", "s", ["done"]), "append")]):
        q = out.writeStream.outputMode(mode).format("memory").queryName(f"out{i}").option("checkpointLocation", f"{tmp_path}/c{i}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {(r.k, r.n, r.total) for r in spark.table("out0").collect()} == {(1, 3, 7.0), (2, 1, 8.0)}
    assert {(r.k, r.s, r.v) for r in spark.table("out1").collect()} == {(1, "run", 4.0), (2, "run", 8.0)}
    assert sorted((r.k, r.s, r.sequence) for r in spark.table("out2").collect()) == [(1, "done", 2), (1, "run", 1), (2, "run", 1)]


@pytest.mark.parametrize("values", [[], [1.0]])
def test_consensus_of_little(spark, values):
    df = spark.createDataFrame([(1, 5, v) for v in values], "g int, x int, w double")
    assert [(r.x, r.dominant) for r in ordered.weighted_consensus(df, ["g"], "x", "w").collect()] == [(5, False)] * len(values)
