"""What must not grow faster than the rows: copies are worked once, few rows go far, and the results stay."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.operators.test_structure import CARDS, ENTRIES, HEADINGS, ROWS, RULES, card
from tributary.operators import aliases, alignment, anchors, boxes, json_paths, retrieval, search, vectors
from tributary.plans import queries


def test_retrieval_scores_kinds_once(spark):
    rows = spark.createDataFrame([(i, "Total current assets", True, ["g", "h"], None, None, None) for i in range(30)], ROWS)
    cards = spark.createDataFrame([card(f"a:C{i:02}", ["Current assets"], groups=["g", "h"]) for i in range(40)] + [card("a:Other", ["Other assets"])], CARDS)
    made, row_kinds, card_kinds = retrieval.scored_kinds(rows, cards, RULES, 0.0)
    assert made.count() == 2 and row_kinds.count() == 30 and card_kinds.count() == 41
    got = retrieval.retrieved(rows, cards, RULES, 3).collect()
    assert len(got) == 90 and {(r.qname, r["rank"]) for r in got} == {("a:C00", 1), ("a:C01", 2), ("a:C02", 3)}
    every = retrieval.audit(rows, cards, RULES)
    assert every.count() == 30 * 41 and every.where(F.col("rank") == 41).select("qname").distinct().collect()[0].qname == "a:Other"


def test_retrieval_shuffles_no_pairs(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: rng.choice(["current", "non-current", "total", "assets", "liability", "tax expense", "tax", "cash"])
    rows = spark.createDataFrame([(i, f"{word()} {word()}", i % 2 == 0, rng.sample(["g", "h", "i"], 2) + [None], [rng.choice(["position", "flows"])], word(), [f"total {word()}", word()]) for i in range(25)] + [(99, "tax", True, ["x"], None, None, None)], ROWS)
    some = [card(f"a:C{i:02}", [f"{word()} {word()}" for _ in range(i % 3)], groups=rng.sample(["g", "h", "i", "j"], 2), aliases=[word(), word()], parents=[word()], documentation=word(), exclusion=["tax", None], positive=[word()], period_type=rng.choice(["instant", "duration"]), abstract=i % 9 == 0) for i in range(30)]
    cards = spark.createDataFrame(some + [(f"a:D{i}", *some[4][1:]) for i in range(7)], CARDS)
    order = lambda df: sorted(map(str, df.collect()))
    every = retrieval.audit(rows, cards, RULES, least=0.2)
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")] and "Window" not in plan[: plan.index("FlatMapGroupsInArrow")]  # pairs stay where they are made
    want, best = order(every), order(every.where("rank <= 3"))
    assert len(want) > 300 and len(best) > 50
    for name, few in (("COPIES", 2), ("PAIRS_A_SLICE", 20), ("PAIRS_AT_ONCE", 40)):
        monkeypatch.setattr(retrieval, name, few)
    assert order(retrieval.audit(rows, cards, RULES, least=0.2)) == want
    assert order(retrieval.retrieved(rows, cards, RULES, 3, least=0.2)) == best
    for row, own in ((r, [x for x in every.collect() if x.row_id == r and x["rank"]]) for r in range(25)):
        assert [x["rank"] for x in sorted(own, key=lambda x: (-x.total_score, x.qname))] == list(range(1, len(own) + 1)), row


def test_vectors_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ITEMS_A_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERIES_A_BLOCK", 3)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], i % 3) for i in range(120)] + [(200, None, 0), (201, [1.0], 1), (202, [1.0, None, 0.0, 0.0], 2), (203, [0.0] * 4, 0)] + [(300 + i, [1.0, 1.0, 1.0, 0.0], 1) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")

    def cosine(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0

    good = {i: (v, mark) for i, v, mark in rows if v and len(v) == 4 and None not in v}
    for same in (None, "label"):
        found = vectors.nearest_vectors(df.where("id % 10 = 0"), df, 4, "id", "id", "v", same=same)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = {(r.query_id, r["rank"]): r.id for r in found.collect() if r.query_id in good}
        want = {}
        for i in (x for x in good if x % 10 == 0):
            order = sorted((-cosine(good[i][0], v), j) for j, (v, mark) in good.items() if j != i and (not same or mark == good[i][1]))
            want |= {(i, place + 1): j for place, (_, j) in enumerate(order[:4])}
        assert got == want
    assert vectors.nearest_vectors(df.limit(0), df, 4, "id", "id", "v").count() == 0


def test_every_vector_is_a_query(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTORS_A_BLOCK", 17)
    monkeypatch.setattr(vectors, "ITEMS_A_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERIES_A_BLOCK", 3)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], i % 3) for i in range(60)] + [(200, None, 0), (201, [1.0], 1), (202, [1.0, None, 0.0, 0.0], 2), (203, [0.0] * 4, 0)] + [(300 + i, [1.0, 1.0, 1.0, 0.0], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")

    def cosine(a, b):
        if not (a and b and len(a) == len(b) == 4 and None not in a and None not in b):
            return None
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0

    got = {(r.query_id, r["rank"]): (r.id, r.label, r.query_label) for r in vectors.nearest_of_each(df, 4, "id", "v").collect()}
    marks, want = {i: mark for i, _, mark in rows}, {}
    for i, v, mark in rows:
        order = sorted((s is None, -(s or 0), j) for j, w, _ in rows if j != i for s in [cosine(v, w)])
        want |= {(i, place + 1): (j, marks[j], mark) for place, (_, _, j) in enumerate(order[:4])}
    assert got == want
    assert vectors.nearest_of_each(df.limit(0), 4, "id", "v").count() == 0
    assert vectors.nearest_of_each(df.where("id = 7"), 4, "id", "v").count() == 0


def test_ranking_evaluation_asks_every_vector(spark, tmp_path):
    rows = [(i, [1.0, float(i)], i % 2) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.ranking_evaluation(spark, str(tmp_path)).collect()[0]["rows"] == 30


def test_search_lists_asked_terms_only(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "dog")], "id long, t string")
    asked = spark.createDataFrame([("dog",), ("dog",)], "term string")
    assert {(r.term, r.doc, r.tf) for r in search.index(docs, "id", "t", asked).collect()} == {("dog", 1, 1), ("dog", 2, 1)}


def test_names_move_no_text(spark):
    labels = spark.createDataFrame([(1, "net cash flow")], "label_id long, label string")
    concepts = spark.createDataFrame([(1, ["cash flow", "cash flow"], ["net cash flow"])], "concept int, labels array<string>, aliases array<string>")
    out = aliases.best_names(labels, concepts, 0.5)
    assert [(r.name, r.source) for r in out.collect()] == [("net cash flow", "alias")]
    assert aliases.names_of(concepts).count() == 3  # as they stand: nothing is grouped by its text


def test_names_stay_where_they_are(spark, monkeypatch):
    labels = spark.createDataFrame([(1, "net cash flow"), (2, "cash at bank"), (3, "cash at bank"), (4, "none of these"), (5, None), (6, "--")], "label_id long, label string")
    concepts = spark.createDataFrame([(1, ["cash flow"], ["net cash flow"]), (2, ["the bank"], ["cash at the bank", "cash bank at"])], "concept int, labels array<string>, aliases array<string>")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "-1")
        for few in (1, 2, 100):
            monkeypatch.setattr(aliases, "LABELS_AT_ONCE", few)
            out = aliases.best_names(labels, concepts, 0.5)
            assert sorted((r.label_id, r.concept, r.name, r.ratio) for r in out.collect()) == [(1, 1, "net cash flow", 1.0), (2, 2, "cash bank at", 1.0), (3, 2, "cash bank at", 1.0)]
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()  # no name is shuffled to meet a label
        assert aliases.best_names(labels.limit(0), concepts, 0.5).count() == 0
    finally:
        spark.conf.set(limit, own)


def test_alignment_counts_copies(spark):
    rows = spark.createDataFrame([(i, "Cash", 10.0, None, 2024) for i in range(3)] + [(9, "Cash", 99.0, None, 2024)], "row_id long, label string, value double, family string, year int")
    facts = spark.createDataFrame([(i, "Cash", None, 10.0, None, 2024, "instant", "MYR") for i in (7, 5, 6)], "fact_id long, fact_label string, aliases array<string>, fact_value double, fact_family string, fact_year int, period_type string, unit string")
    got = {r.row_id: (r.fact_id, r.gap, r.n_candidates, r.bucket) for r in alignment.aligned(rows, facts).collect()}
    assert got == {0: (5, 0, 3, "ambiguous"), 1: (5, 0, 3, "ambiguous"), 2: (5, 0, 3, "ambiguous"), 9: (None, None, 0, "unmatched")}
    assert "fact_copies" in alignment.scored(rows, facts.withColumn("fact_copies", F.lit(1))).columns


def test_alignment_moves_rows_once_and_no_pairs(spark):
    rows = spark.createDataFrame([(i, "Cash", None if i % 4 == 3 else 10.0 * (i % 4), None if i % 2 else "cash_flow", 2024, i % 3) for i in range(40)] + [(None, "Cash", 10.0, None, 2024, 0)], "row_id long, label string, value double, family string, year int, sample int")
    facts = spark.createDataFrame([(i, "Cash", None, 10.0 * i, None, 2024, "instant", "MYR") for i in range(3)] + [(9, "Cash", None, 10.0, None, 2024, "instant", "shares")], "fact_id long, fact_label string, aliases array<string>, fact_value double, fact_family string, fact_year int, period_type string, unit string")
    out = alignment.aligned(rows, facts, "sample")
    got = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row_id" not in plan and "ReusedExchange" in plan
    assert sorted((r.row_id is None, r.row_id or 0, r.sample, r.fact_id, r.n_candidates) for r in got) == [(False, i, i % 3, *((None, 0) if i % 4 == 3 else (i % 4, 1))) for i in range(40)] + [(True, 0, 0, None, 0)]
    summary = {r.sample: (r.n_rows, r.unmatched) for r in alignment.sample_summary(out, rows, "sample").collect()}
    assert summary == {s: (sum(i % 3 == s for i in range(40)) + (s == 0), sum(i % 3 == s and i % 4 == 3 for i in range(40)) + (s == 0)) for s in range(3)}


def test_boxes_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(boxes, "PAIRS_A_TASK", 10)
    df = spark.createDataFrame([(1, i, 0.0, 0.0, 1.0, 1.0) for i in range(20)], "page int, id int, x0 double, y0 double, x1 double, y1 double")
    out = boxes.overlaps(df, df, ["page"], 2.0)
    assert out.count() == 400 and out.rdd.getNumPartitions() == 40


def test_anchors_choose_in_a_stream(spark):
    heads = spark.createDataFrame([(d, f"h{i}", i + 1, "Cash flows", "title", None, None, None, None) for d in (1, 2) for i in range(4)] + [(1, "x", 9, "Cash desk and other rights", None, None, None, None, None)], HEADINGS)
    entries = spark.createDataFrame([(d, i, "Cash flows", None, None, "x") for d in (1, 2) for i in range(6)], ENTRIES)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(batch)
    try:
        spark.conf.set(batch, "3")  # documents and entries go over the ends of batches
        out = anchors.anchors(entries, heads)
        assert {(r.doc_id, r.entry_no): (r.heading_id, r.near_tie) for r in out.collect()} == {(d, i): (f"h{i}", i < 3) for d in (1, 2) for i in range(4)}
    finally:
        spark.conf.set(batch, own)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and plan.count("Join") == 3  # candidates are made once, and no document is handed over whole


def test_json_levels_in_one_pass(spark, monkeypatch):
    deep = '[{"a": ' * 8 + "null" + "}]" * 8
    df = spark.createDataFrame([(1, deep), (2, '{"a": [{}, [], null]}'), (3, "no json"), (4, None), (5, "7"), (None, "7")], "k int, t string")
    found = json_paths.paths(df.where("k <> 1"), "k", "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parse_json(") <= 1 and "Union" not in plan  # a text is parsed once
    assert sorted((r.key, r.path, r.kind) for r in found.collect()) == [(2, "$", "object"), (2, "$.a", "array"), (2, "$.a[0]", "object"), (2, "$.a[1]", "array"), (2, "$.a[2]", "void"), (5, "$", "bigint")]
    want = sorted("$" + "[0].a" * i + tail for i in range(9) for tail in ("", "[0]") if i < 8 or not tail)
    for levels in (6, 4):
        monkeypatch.setattr(json_paths, "LEVELS", levels)
        assert sorted(r.path for r in json_paths.paths(df, "k", "t").where("key = 1").collect()) == want
