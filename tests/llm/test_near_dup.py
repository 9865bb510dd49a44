"""Near duplicates against brute force over all pairs."""

from __future__ import annotations

import random

from tests.llm import cases
from tributary.llm import graph, near_dup


def shingles(text: str | None) -> frozenset:
    w = cases.space_words(cases.lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple]) -> dict:
    sets = [(k, shingles(t)) for k, t, *_ in rows]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: find(k) for k in root}


def variants(rng: random.Random, base: int, n: int, edits: int) -> list[str]:
    """Chains of edits: neighbours are alike, the ends are not."""
    words = [f"v{rng.randrange(2000)}" for _ in range(base)]
    out = []
    for _ in range(n):
        out.append(" ".join(words))
        for _ in range(edits):
            words[rng.randrange(base)] = f"n{rng.randrange(10**6)}"
    return out


def test_components_against_all_pairs(spark):
    rng = random.Random(11)
    rows = cases.documents()
    texts = variants(rng, 60, 25, 1) + variants(rng, 120, 25, 4) + variants(rng, 9, 12, 1) + ["a b c", "a b c", "a b c d", "z"] * 2
    texts += [texts[3].upper(), texts[30].title()]
    base = [f"t{i}" for i in range(150)]
    for _ in range(40):  # variants of one text, most of them not alike
        own = list(base)
        for i in rng.sample(range(150), 8):
            own[i] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    ids = rng.sample(range(1000, 9000), len(texts))
    rows += [(k, t, "en", "s", 1) for k, t in zip(ids, texts, strict=True)]
    got = near_dup.op10(cases.frame(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    sizes = {k: len(shingles(t)) for k, t, *_ in rows}
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) for r in got)
    kept = near_dup.stage(cases.frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in want.items() if k == v)


def test_awkward_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text, None, None, 1), (None, None, None, None, None), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (3, "quite another text of some words", "en", "s", 1), (9, "quite another text of some words", "en", "s", 1)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dup.op10(cases.frame(spark, rows)).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (3, 3, True), (3, 3, True), (3, 3, True), (9, 3, False)]
    assert near_dup.op10(cases.frame(spark, rows).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 50), (60, 61), (61, 60)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 60, 61: 60}


def test_rows_without_an_id_stay(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "en", "s", 1), (None, "clean and unique words of some other kind", "en", "s", 2), (None, None, None, None, None), (3, text, "en", "s", 1), (4, text, "en", "s", 1)]
    got = [tuple(r) for r in near_dup.stage(cases.frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(rows[:4], key=str)


def templates(n: int, changed: int, seed: int = 3) -> list[tuple]:
    """Variants of one text of 220 words, each with some words of its own."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(220)]
    rows = []
    for k in range(n):
        own = list(base)
        for i in rng.sample(range(220), changed):
            own[i] = f"e{rng.randrange(10**9)}"
        rows.append((k, " ".join(own), "en", "s", 1))
    return rows


def test_links_grow_with_the_documents(spark, monkeypatch):
    """No pass over a group of variants makes more rows than a few per document."""
    made = []
    own = near_dup.saved
    monkeypatch.setattr(near_dup, "saved", lambda df, name: made.append((name, (out := own(df, name)).count())) or out)
    most = {}
    for n in (100, 200):
        made.clear()
        rows = templates(n, 4)
        got = {r.doc_id: r.component_id for r in near_dup.op10(cases.frame(spark, rows)).collect()}
        assert got == brute(rows)
        most[n] = {x: max(c for y, c in made if y == x) for x, _ in made if x in ("links", "stars", "open")}
    for n, own in most.items():
        assert own["links"] <= 2 * n and own["stars"] <= 12 * n and own.get("open", 0) <= n, most


def test_undecided_documents_are_settled_by_their_shingles(spark):
    """Too unlike for a link with most others, but some are copies of each other with one more change."""
    rng = random.Random(8)
    rows = templates(80, 9)
    for k in range(0, 80, 5):
        words = rows[k][1].split()
        words[rng.randrange(220)] = "again"
        rows.append((100 + k, " ".join(words), "en", "s", 1))
    got = {r.doc_id: r.component_id for r in near_dup.op10(cases.frame(spark, rows)).collect()}
    assert got == brute(rows)
