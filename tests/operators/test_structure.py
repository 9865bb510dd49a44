"""Retrieval, anchors, JSON, boxes, budgets, search and names against plain loops, and on awkward rows."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tributary.operators import aliases, anchors, boxes, budget, json_paths, retrieval, search
from tributary.streaming import progress

RULES = retrieval.Rules(
    markers={"asset": r"\bassets?\b", "liability": r"\bliabilit", "current": r"\bcurrent\b", "noncurrent": r"\bnoncurrent\b", "total": r"\btotal\b"},
    contrasts=[("asset", "liability", 0.28), ("current", "noncurrent", 0.32), ("target:tax", "asset", 0.36)],
    targets=[("tax", r"\btax", r"\btax expense\b")],
    periods=[("position", None, "instant"), ("flows", r"\bclosing\b", "instant"), ("flows", None, "duration")],
    signals=[("asset", "liability")],
)
ROWS = "row_id long, label string, numeric boolean, groups array<string>, families array<string>, parent_label string, sibling_labels array<string>"
CARDS = "qname string, labels array<string>, aliases array<string>, documentation string, parents array<string>, groups array<string>, families array<string>, positive array<string>, exclusion array<string>, datatype string, substitution_group string, period_type string, abstract boolean"


def card(qname, labels, groups=("g",), **more):
    base = dict.fromkeys([c.split()[0] for c in CARDS.split(", ")]) | {"qname": qname, "labels": labels, "groups": list(groups)}
    return tuple((base | more).values())


def test_retrieval_reasons_in_order(spark):
    rows = spark.createDataFrame([
        (1, "Add: Total current assets", True, ["g", "g"], ["position"], "Assets", ["Total assets"]), (2, "Tax", True, ["g"], None, None, None), (3, None, None, None, None, None, None), (4, "closing cash", False, ["h"], ["flows"], None, [])
    ], ROWS)
    cards = spark.createDataFrame([
        card("a:CurrentAssets", ["Current assets"], period_type="instant"), card("a:CurrentLiabilities", ["Current liabilities"], period_type="instant"), card("a:NoncurrentAssets", ["Non-current assets"]),
        card("a:Abstract", ["Current assets"], abstract=True, period_type="duration"), card("a:Text", ["Assets text"], datatype="textBlockItemType"), card("a:RowsAxis", ["Assets"]), card("a:Flow", ["Assets"], period_type="duration"),
        card("a:Tax", ["Tax expense"], exclusion=["tax"]), card("h:Cash", ["Cash", None], groups=["h", None], aliases=["Closing cash"], period_type="instant"), card("x:None", ["Current assets"], groups=[]), card("x:Null", None),
    ], CARDS)
    got = {(r.row_id, r.qname): r for r in retrieval.audit(rows.selectExpr("*", "1 as rank", "2 as norm"), cards.selectExpr("*", "1 as like_alias"), RULES, least=0.1).collect()}
    why = lambda row, q: got[row, q].exclusion_reason
    assert {k[0] for k in got} == {1, 2, 4} and (1, "h:Cash") not in got and not any(k[1] == "x:None" for k in got)
    assert why(1, "a:Abstract") == "abstract_concept" and why(1, "a:Text") == why(1, "a:RowsAxis") == "datatype_incompatible" and why(1, "a:Flow") == "period_incompatible:instant!=duration"
    best = got[1, "a:CurrentAssets"]
    assert best.rank == 1 and best.period_score == 0.04 and best.contrast_penalty == 0 and math.isclose(best.lexical_score, 0.26 * 2 / 3, abs_tol=1e-6)
    assert got[1, "a:CurrentLiabilities"].contrast_penalty == 0.28 and got[1, "a:NoncurrentAssets"].contrast_penalty == 0.32
    assert got[2, "a:Tax"].exclusion_penalty == 0.08 and "supports:tax" in got[2, "a:Tax"].reasons and got[2, "a:CurrentAssets"].contrast_penalty == 0.36
    assert got[4, "h:Cash"].alias_score == 0.16 and got[4, "h:Cash"].period_score == 0.04
    assert {r.qname for r in retrieval.retrieved(rows, cards, RULES, 1).where("row_id = 1").collect()} == {"a:CurrentAssets"}
    assert retrieval.audit(rows.limit(0), cards, RULES).count() == retrieval.audit(rows, cards.limit(0), RULES).count() == 0
    plan = retrieval.audit(rows, cards, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


HEADINGS = "doc_id int, heading_id string, page int, text string, role string, top double, page_height double, page_labels array<string>, before_table boolean"
ENTRIES = "doc_id int, entry_no long, title string, printed_page int, printed_label string, scheme string"


def test_anchors_choose_once_in_order(spark):
    heads = [(1, "a", 5, "Statement of income", None, None, None, None, None), (1, "b", 9, "STATEMENT OF INCOME", "title", 1.0, 10.0, ["7"], True), (1, "c", 6, "3. Cash flows", None, None, None, None, None),
             (1, "d", 20, "Notes on leases and other rights", None, None, None, None, None), (1, "e", 8, "Changes in equity", None, None, None, None, None), (1, "f", 10, "Income tax", None, None, None, None, None), (2, "a", 1, None, None, None, None, None, None), (None, "a", 1, "Cash flows", None, None, None, None, None)]
    entries = [(1, 1, "Statement of income ..... 3", 3, None, "arabic"), (1, 2, "Cash flows", 4, None, "arabic"), (1, 3, "Statement of income", None, "7", "arabic"), (1, 4, "Leases", 18, None, "arabic"), (1, 6, "Changes in equity", 6, None, "arabic"), (1, 7, "Income tax", 8, None, "arabic"), (2, 1, "Cash flows", 1, None, "arabic"), (1, 5, "Statement of income", 3, None, "x"), (None, 1, "Cash flows", 1, None, "x")]
    e, h = spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(heads, HEADINGS)
    got = {(r.doc_id, r.entry_no): r for r in anchors.anchors(e, h).collect()}
    assert {k: v.heading_id for k, v in got.items()} == {(1, 1): "a", (1, 2): "c", (1, 3): "b", (1, 6): "e", (1, 7): "f"}  # the offset of 1 draws the first entry to page 5; nothing is left for entry 5
    assert got[1, 1].distance == 0 and got[1, 1].near_tie and got[1, 3].distance is None and got[1, 3].score == 1.0
    sections = {"profit and loss": "income", "statement of income": "income"}
    named = anchors.anchors(spark.createDataFrame([(1, 1, "Profit and loss", None, None, "x")], ENTRIES), h, sections).collect()
    assert [(r.heading_id, r.tier, r.method) for r in named] == [("b", "B", "same_section")]
    assert anchors.anchors(e.limit(0), h).count() == 0


def test_json_paths_and_hashes(spark):
    texts = ['{"a": {"b": [1, {"c": null}]}, "d": "x"}', ' {"d":"x","a":{"b":[1,{"c":null}]}}', '{"a": {"b": [{"c": null}, 1]}, "d": "x"}', "[]", "{}", "7", "no json", None, '{"a.b": 1, "Secret": {"token": true}}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = json_paths.paths(df, "k", "t")

    def plain(x, path="$", name=None):
        kind = "object" if isinstance(x, dict) else "array" if isinstance(x, list) else None
        yield path, name, kind is None
        for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
            yield from plain(v, f"{path}.{k}" if isinstance(x, dict) else f"{path}[{k}]", k if isinstance(x, dict) else None)

    want = Counter((k, *p) for k, t in enumerate(texts) if t and t != "no json" for p in plain(json.loads(t)))
    assert Counter((r.key, r.path, r.name, r.kind not in ("object", "array")) for r in found.collect()) == want
    hashes = {r.key: r.hash for r in json_paths.hashes(found).collect()}
    assert hashes[0] == hashes[1] != hashes[2] and hashes[3] != hashes[4] and set(hashes) == {0, 1, 2, 3, 4, 5, 8}
    assert {(r.key, r.path) for r in json_paths.with_names(found, ["TOKEN", "c"]).collect()} == {(0, "$.a.b[1].c"), (1, "$.a.b[1].c"), (2, "$.a.b[0].c"), (8, "$.Secret.token")}


def test_boxes_against_all_pairs(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.randrange(2), i, x := round(rng.uniform(-9, 9), 2), y := round(rng.uniform(-9, 9), 2), x + rng.choice([0.0, 0.5, 3.0, 9.0]), y + rng.choice([0.5, 2.0, -1.0])) for i in range(n)]
    a, b = make(60) + [(0, 99, None, 0.0, 1.0, 1.0)], make(60)
    schema = "page int, id int, x0 double, y0 double, x1 double, y1 double"
    got = boxes.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["page"], 2.0).collect()
    want = {}
    for p, i, x0, y0, x1, y1 in a:
        for q, j, u0, v0, u1, v1 in b:
            if p == q and x0 is not None and (w := min(x1, u1) - max(x0, u0)) > 0 and (h := min(y1, v1) - max(y0, v0)) > 0:
                want[p, i, j] = w * h / min((x1 - x0) * (y1 - y0), (u1 - u0) * (v1 - v0))
    assert len(got) == len(want) and all(math.isclose(want[r.page, r.left_id, r.right_id], r.share, rel_tol=1e-9) for r in got)


def test_budget_against_popping(spark):
    rng = random.Random(8)
    items = [(k, p, i, rng.choice([0, 3, 10, None])) for k in range(30) for p in range(3) for i in range(rng.randrange(12))]
    fixed = [(k, rng.choice([0, 20, 50, 99])) for k in range(28)] + [(77, 10), (None, 3)]
    schema = "k int, priority int, place long, size long"
    kept, summary = budget.within_budget(spark.createDataFrame([*items, (None, 0, 0, 1)], schema), spark.createDataFrame(fixed, "k int, size long"), "k", 60, run=4)
    lists, base = defaultdict(list), {k: s for k, s in fixed if k is not None}
    for k, p, i, s in sorted(items):
        lists[k].append((p, i, s or 0))
    want = {}
    for k in {*lists, *base}:
        mine, out = list(lists[k]), 0
        while mine and base.get(k, 0) + sum(s for *_, s in mine) > 60:
            mine.pop()
            out += 1
        want[k] = (base.get(k, 0) <= 60, base.get(k, 0) + sum(s for *_, s in mine), len(mine), out)
    assert {r.k: (r.fits, r.used, r.kept, r.omitted) for r in summary.collect()} == want
    assert kept.count() == sum(v[2] for v in want.values())


def test_search_needs_all_terms(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "The CAT sat"), (3, "dog dog dog cat"), (4, None), (None, "cat dog"), (5, "été")], "id long, t string")
    queries = spark.createDataFrame([(1, "cat dog cat"), (2, "cat bird"), (3, "Été"), (4, ""), (5, None), (None, "cat")], "query long, text string")
    got = [(r.query, r.doc, r.rank) for r in search.search(search.index(docs, "id", "t"), queries, 5, 2).orderBy("query", "rank").collect()]
    assert got == [(1, 3, 1), (1, 1, 2), (3, 5, 1)]


def test_names_against_all_pairs(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("asset cash net total other income tax profit loss of the".split())
    text = lambda: " ".join(word() for _ in range(rng.randrange(1, 6)))
    labels = [(i, text()) for i in range(60)] + [(90, None), (None, "cash"), (91, "Total")]
    concepts = [(i, [text()], [text() for _ in range(3)]) for i in range(25)] + [(70, None, ["total", "cash (note 3)"]), (None, ["cash"], None)]
    got = aliases.best_names(spark.createDataFrame(labels, "label_id long, label string"), spark.createDataFrame(concepts, "concept int, labels array<string>, aliases array<string>"), 0.5).collect()
    norm = lambda x: re.sub(r"\(?note \d+\)?", "", (x or "").lower()).strip()
    want = {}
    for i, label in labels:
        for c, ls, al in concepts:
            for source, name in [("label", n) for n in ls or []] + [("alias", n) for n in al or []]:
                a, b = norm(label), norm(name)
                if i is None or c is None or not a or b in ("", *aliases.GENERIC):
                    continue
                ratio = 1.0 if a == b else len({*a.split()} & {*b.split()}) / len({*a.split()} | {*b.split()})
                if ratio >= 0.5 and ratio > want.get((i, c), (0,))[0]:
                    want[i, c] = (ratio, b, source)
    assert {(r.label_id, r.concept): (r.name, r.source) for r in got} == {k: v[1:] for k, v in want.items()}


def test_progress_expires_by_event_time(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 5, "run"), (1, "2024-01-01 00:00:00", 6, "done"), (2, "2024-01-01 09:00:00", 7, "run"), (3, "2024-01-01 07:00:00", 8, "run"), (None, "2024-01-01 00:00:00", 9, "run")]
    df = spark.createDataFrame(rows, "k long, t string, e long, s string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = progress.run_to_the_end(spark, progress.progress(stream, "k", "ts", "e", "s", "1 hour", 3_600_000), "t")
    assert {(r.key, r.event_id, r.state) for r in progress.state_of(out).collect()} == {("1", 6, "expired"), ("2", 7, "live"), ("3", 8, "expired")}
