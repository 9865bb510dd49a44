"""Mixing: targets and fits against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np

from tests.llm import cases
from tributary.llm import mixing


def water(sizes: dict) -> dict:
    """Share by weight; what exceeds twice a source's size goes to the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def test_fit_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(0, 30), 4)))
        counts = np.array([rng.randrange(1, 4) for _ in lengths])
        budget = rng.randrange(0, 80)
        k = mixing.fit(lengths, counts, budget)
        sums = {int((lengths * np.array(c)).sum()) for c in itertools.product(*(range(n + 1) for n in counts))}
        assert (0 <= k).all() and (k <= counts).all()
        assert int((lengths * k).sum()) == max(s for s in sums if s <= budget)


def test_fit_is_exact_for_very_long_documents():
    take = lambda lengths, counts, budget: (mixing.fit(np.array(lengths), np.array(counts), budget) * lengths).sum()
    assert take([4_199_999, 4_200_001, 5_000_000], [1, 1, 1], 8_400_000) == 8_400_000
    assert take([7_000_003, 11_000_017], [100, 100], 400_000_333) == max(7_000_003 * i + 11_000_017 * j for i in range(101) for j in range(101) if 7_000_003 * i + 11_000_017 * j <= 400_000_333)
    assert take([5], [3], 4) == 0 and take([0, 3], [9, 1], 2) == 0


def check(got, rows):
    size = {k: len(cases.space_words(t)) for k, t, *_ in rows}
    by = defaultdict(int)
    for k, _, _, source, _ in rows:
        by[source] += size[k]
    want, taken = water(by), defaultdict(int)
    source_of = {k: s for k, _, _, s, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source_of[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == by[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    return want, taken


def test_mix(spark):
    rows = cases.documents(n=90)
    rng = random.Random(4)
    rows += [(1000 + i, cases.sentence(rng, rng.randrange(1, 200)), "en", rng.choice(["s1", "é", "z"]), 1) for i in range(900)]
    rows += [(5000, None, "en", "empty", None)]
    docs = cases.frame(spark, rows)
    got = mixing.op8(docs).collect()
    want, taken = check(got, rows)
    for s in want:
        assert abs(taken[s] - want[s]) <= 1 or s in (None, "s2", "s3"), (s, taken[s], want[s])
        assert abs(taken[s] - want[s]) <= 100
    again = mixing.op8(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    stage = mixing.stage(docs)
    assert stage.columns[: len(docs.columns)] == docs.columns and stage.count() == sum(r.times > 0 for r in got)


def test_awkward_tables(spark):
    assert mixing.op8(cases.frame(spark).limit(0)).count() == 0
    rows = [(1, "a b c", None, None, 1)] * 3 + [(None, "a b", None, "x", 1), (2, None, None, "x", 1)]
    assert len(mixing.op8(cases.frame(spark, rows)).collect()) == 5


def test_rows_without_an_own_id_stay_themselves(spark):
    rng = random.Random(9)
    rows = [(i, cases.sentence(rng, rng.randrange(1, 60)), "en", "ab"[i % 2], i) for i in range(60)]
    rows += [(None, cases.sentence(rng, rng.randrange(1, 60)), "en", "a", 100 + i) for i in range(40)]  # null ids
    rows += [(1000 + i % 7, cases.sentence(rng, rng.randrange(1, 60)), "de", "b", 200 + i) for i in range(40)]  # one id, several texts
    rows += [(2000, "equal rows of one id", "en", "c", 300)] * 9
    got = mixing.stage(cases.frame(spark, rows)).collect()
    have, took = Counter(rows), Counter(tuple(r)[:5] for r in got)
    assert all(n <= have[r] for r, n in took.items())
    assert any(r.doc_id is None for r in got)
    want = water({s: sum(len(cases.space_words(r[1])) for r in rows if r[3] == s) for s in "abc"})
    for s in want:
        words = [(len(cases.space_words(r.text)), r) for r in got if r.source == s]
        assert all(r.size == n and r.taken == n * r.times for n, r in words)
        assert abs(sum(r.taken for _, r in words) - want[s]) <= 4
