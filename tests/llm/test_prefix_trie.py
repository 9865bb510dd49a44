"""The prefix trie against every prefix of every conversation, at any cut into chunks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tributary.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, savings = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        savings[node] = (len(members[node]) - 1) * own + sum(savings[k] for k in kids[node])
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], savings[n], digest(n)) for n, m in members.items())


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def some_rows(seed, n, texts=3):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(10 * n), n):
        for turn in range(rng.choice([1, 2, 3, 3, 4, 9])):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d  e\tf é"][:texts])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("turns", "texts"), [(100_000, 5), (7, 2), (1, 1)])
def test_rebuilt_against_brute_force(spark, monkeypatch, turns, texts):
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    rows = some_rows(turns, 150, texts)
    got = [tuple(r[c] for c in NAMES) for r in prefix_trie.op11(spark.createDataFrame(rows, TURNS)).collect()]
    want = brute(rebuilt(conversations(rows)))
    assert key(got) == key(want)


def test_copies_long_ones_and_prefixes_of_others(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS", 300)
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(5)]  # copies
    rows += [(100 + k, t, "user", f"turn {t}") for k in range(4) for t in range(40 * k + 1)]  # each a prefix of the next
    rows += [(200 + k, t, "user", f"turn {t}" if t < 390 else f"own {k}") for k in range(3) for t in range(400)]
    rows += [(300, t, "user", None) for t in range(50)]
    convs = conversations(rows)
    frame = spark.createDataFrame(rows, TURNS)
    got = [tuple(r[c] for c in NAMES) for r in prefix_trie.trie(prefix_trie.digested(frame)).collect()]
    assert key(got) == key(brute(convs))


def test_defined_cases(spark):
    lone = next(c for c in range(20, 2000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(lone, 0, "user", "only turn"), (None, 0, "user", "no conversation")]  # rebuilt without a turn
    wide = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as path", "2 as key", "3 as depth", "4 as turns", "5 as family")
    got = prefix_trie.op11(wide).collect()
    assert [tuple(r[c] for c in NAMES) for r in got] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert prefix_trie.op11(spark.createDataFrame([], TURNS)).count() == 0
    both = [(5, None, "a", "x"), (5, 1, "a", "x"), (5, 1, "a", "x"), (25, 0, None, None)]
    got = [tuple(r[c] for c in NAMES) for r in prefix_trie.op11(spark.createDataFrame(both, TURNS)).collect()]
    assert key(got) == key(brute(rebuilt(conversations(both))))
