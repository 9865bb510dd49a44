"""Substring dedup against brute force over all windows."""

from __future__ import annotations

import hashlib
import random

import pytest

from tests.llm import cases
from tributary.llm import substring


def brute(rows: list[tuple]) -> dict:
    seen, out = set(), {}
    for k, t in sorted((k, t) for k, t, *_ in rows):
        words = cases.space_words(t)
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone.update(range(i, i + 20))
            seen.add(w)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[k] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def more(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(k, t or "", *x) for k, t, *x in cases.documents(seed)]
    passage = [f"p{i}" for i in range(25)]
    for k in range(2000, 2060):
        own = [f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]
        cut = passage[rng.randrange(4) : 25 - rng.randrange(3)]
        rows.append((k, " ".join([*own, *cut, *(f"q{rng.randrange(3)}" for _ in range(rng.randrange(40)))]), "en", "s", 1))
    rows += [(k, " ".join(rng.choice("ab") for _ in range(120)), "en", "s", 1) for k in range(3000, 3006)]
    rows += [(4000, "same " * 70, "en", "s", 1), (4001, "x " + "same " * 30, "en", "s", 1), (4002, "u v w " * 25, "en", "s", 1)]
    return rows


@pytest.mark.parametrize("split", [substring.SPLIT, 2])
def test_against_all_windows(spark, monkeypatch, split):
    monkeypatch.setattr(substring, "SPLIT", split)
    rows = more(7)
    want = brute(rows)
    got = substring.op2(cases.frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {k: v[:3] for k, v in want.items()}
    if split != 2:
        stage = {r.doc_id: r for r in substring.stage(cases.frame(spark, rows)).collect()}
        assert set(stage) == {k for k, v in want.items() if v[3] or not v[0]}
        for k, r in stage.items():
            assert cases.space_words(r.text) == want[k][3]


def test_awkward_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, None, None, 1), (1, None, None, None, None), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (3, text + " tail", "en", "s", 1)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.op2(cases.frame(spark, rows)).collect())
    assert got == [(-1, 40, 0), (1, 0, 0), (2, 40, 0), (2, 40, 0), (3, 41, 40)]
    assert substring.op2(cases.frame(spark, rows).limit(0)).count() == 0
    clash = cases.frame(spark, rows).selectExpr("*", "1 as n_words", "2 as kept_sha256")
    assert substring.stage(clash).columns == clash.columns
