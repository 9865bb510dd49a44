"""LM scores against a plain computation."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from tributary.llm import lm
from tributary.llm import words as W


def brute(texts: list[list[str]], alpha: float = 0.4):
    uni = Counter(w for t in texts for w in t)
    bi = Counter(p for t in texts for p in zip(t, t[1:]))
    total = sum(uni.values())
    out = []
    for t in texts:
        score, seen = (math.log(uni[t[0]] / total) if t else 0.0), 0
        own, mine = Counter(zip(t, t[1:])), Counter(t)
        for (v, w), n in own.items():
            left = bi[v, w] - n
            if left > 0:
                score += n * math.log(left / (uni[v] - mine[v]))
                seen += n
            else:
                score += n * math.log(alpha * uni[w] / total)
        out.append((len(t), seen, score))
    return out


def test_nothing(spark):
    assert lm.op4(cases.frame(spark).limit(0)).count() == 0
    assert [r.score for r in lm.op4(cases.frame(spark, [(1, None, None, None, None)])).collect()] == [0.0]


@pytest.mark.parametrize(("head", "head_words", "bits"), [(0, 0, 6), (30, 7, 8), (10**5, 40, 20), (10**5, 10**5, 27)])
def test_scores_do_not_depend_on_what_is_broadcast(spark, head, head_words, bits):
    """All words are kept, and the heads and the bitmap are short cuts only."""
    rows = cases.documents() + [(900 + i, f"rare{i} rarer{i} the w1 rare{i} rarer{i}", None, None, 1) for i in range(30)]
    rows += [(950 + i, f"twice{i // 2} thrice{i // 2} w1 w2", None, None, 1) for i in range(10)]
    docs = cases.frame(spark, rows).selectExpr("*", "1 as score", "2 as _row", "3 as key")
    got = {r.doc_id: r for r in lm.scores(docs, head=head, head_words=head_words, filter_bits=bits).collect()}
    assert len(got) == len(rows)
    for (k, *_), (n, seen, score) in zip(rows, brute([cases.space_words(r[1]) for r in rows]), strict=True):
        assert (got[k].n_tokens, got[k].n_seen) == (n, seen)
        assert abs(got[k].score - score) < 1e-6 * max(1, abs(score))
        assert (got[k].mean_score is None) == (n == 0)


def test_rare_words_do_not_vouch_for_each_other(spark):
    """More distinct words than the head holds: no bigram occurs twice, so none is seen."""
    rows = [(i if i else None, " ".join(f"w{i}x{j}" for j in range(1000)), None, None, 1) for i in range(300)]
    got = lm.scores(cases.frame(spark, rows), head_words=1000).collect()
    assert len(got) == 300 and {r.n_seen for r in got} == {0} and {r.doc_id for r in got} == {None, *range(1, 300)}
    p = math.log(1 / 300_000)
    assert all(abs(r.score - (1000 * p + 999 * math.log(0.4))) < 1e-3 for r in got)


def shuffled(spark, since: int = -1) -> tuple[int, int]:
    """Records that stages after this one have shuffled, and the last stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    stages = [found.apply(i) for i in range(found.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > since), max((s.stageId() for s in stages), default=-1)


def test_no_row_for_each_word_is_shuffled(spark):
    """Keys go packed, a row for each block and bucket: the rows for each word filled executors and disks."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(1000)), None, None, 1) for i in range(100)]
    docs = cases.frame(spark, rows)
    _, last = shuffled(spark)
    got = {r.doc_id: r for r in lm.scores(docs, head=0, head_words=0, filter_bits=20).collect()}
    records, _ = shuffled(spark, last)
    assert records < 1000  # of 100,000 words
    for (k, *_), (n, seen, score) in zip(rows, brute([r[1].split() for r in rows]), strict=True):
        assert (got[k].n_tokens, got[k].n_seen) == (n, seen) and abs(got[k].score - score) < 1e-6 * abs(score)


@pytest.mark.parametrize(("block", "bucket"), [(100, 40), (1 << 20, 90), (700, 1 << 20)])
def test_scores_do_not_depend_on_blocks_and_buckets(spark, block, bucket):
    rows = cases.documents()[:40] + [(500, "a b a b c", None, None, 1)] * 3 + [(None, "a b c", None, None, 1), (None, None, None, None, None)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_seen, round(r.score, 6)) for r in lm.scores(cases.frame(spark, rows), block=block, bucket=bucket).collect())
    want = brute([cases.space_words(r[1]) for r in rows])
    assert got == sorted((-1 if k is None else k, n, seen, round(score, 6)) for (k, *_), (n, seen, score) in zip(rows, want, strict=True))


def test_keys_are_packed_whole():
    for x in ([0], [1, 0, 255], [256, 2**64 - 1, 0], [2**63, 5]):
        assert lm.unpack(lm.pack(np.array(x, np.uint64)), len(x)).tolist() == x


def test_words_are_numbered():
    texts = ["", None, "a", "b c", "d", " e\tf ", "Straße\n", "", "g"]
    for column in (pa.array(texts), pa.array(texts).slice(3), pa.array([], pa.string()), pa.array(["", None])):
        assert W.number(column) == sum(len(cases.space_words(x)) for x in column.to_pylist())
