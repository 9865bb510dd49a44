"""Conversation repair against a search over all edits, and on awkward rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tributary.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out, ids = defaultdict(list), set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out[conv] += [(turn, "user" if act == 4 else role, text)] * {0: 0, 3: 2}.get(act, 1)
    return {c: sorted(out[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c in ids}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def follows(state, initial):
    """The state machine of s?(ua)+, written out; None where the initial can't follow."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def search(rows, flags):
    """Uniform-cost search over whole edit strings: any number of inserts anywhere."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, made
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if to := follows(state, role[0]):
                heapq.heappush(heap, (cost + repair.INSERT, audit + "I", i, to, (*made, f"{role}:")))
        if i == len(rows):
            continue
        _, own, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, made))
        if flags[i] in ("blank", "duplicate"):
            continue
        more = 5 * (flags[i] == "truncated")
        for edit, role, price in (("K", own, 0), ("R", "user", 1), ("R", "assistant", 1)):
            if to := follows(state, role[:1]):
                heapq.heappush(heap, (cost + price + more, audit + edit, i + 1, to, (*made, f"{role}:{text}")))
    raise AssertionError


def brute(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        flags = faults(mine)
        cost, audit, made = search(mine, flags)
        turns = [t for t, *_ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        assert LEGAL.fullmatch("".join(x[0] for x in made))
        out[conv] = (gaps, *(flags.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def result(spark, rows):
    got = repair.op12(spark.createDataFrame(rows, TURNS)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


@pytest.mark.parametrize("insert", [5, 1])  # at 5 a delete is always cheaper than an insert
def test_against_a_search_over_all_edits(spark, monkeypatch, insert):
    monkeypatch.setattr(repair, "INSERT", insert)
    rng = random.Random(12)
    rows = []
    for conv in range(250):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "cut", "x?\n ", "", " \t", None, "a. b", "end. ", "é.\x0b"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rng.shuffle(rows)
    got, want = result(spark, rows), brute(rows)
    assert got == want, [(k, got[k], want[k]) for k in want if got.get(k) != want[k]][:3]
    assert len({len(v[6]) for v in want.values()}) > 4 and (insert == 5 or any("I" in v[6] for v in want.values()))


def test_defined_cases(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, "user", "Hi."), (None, 4, "assistant", "So."), (-7, 1, "user", "a."), (-7, 1, "user", "a.")]
    got = result(spark, rows)
    assert got == brute(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.op12(spark.createDataFrame([], TURNS)).count() == 0
    wide = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as gone", "2 as fault", "3 as rows", "4 as cost", "5 as _copy", "6 as audit")
    assert {r.conv_id: r.audit for r in repair.op12(wide).collect()} == {k: v[6] for k, v in got.items()}


def test_one_long_conversation(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"turn {i}." + "x" * (i % 3)) for i in range(1500)]
    got, mine = result(spark, rows), damaged(rows)[1]
    flags = faults(mine)
    cost, audit, made = plain(mine, flags)
    assert got[1][5:] == (cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def plain(rows, flags):
    """A table of the best edits per row and state (for texts too long for the search)."""
    best = {"": (0, "", ())}

    def put(table, state, *x):
        if state is not None and (state not in table or x[:2] < table[state][:2]):
            table[state] = x

    def insert(table):
        out = dict(table)
        for s, (c, a, m) in table.items():
            for role in ("user", "assistant"):
                put(out, follows(s, role[0]), c + repair.INSERT, a + "I", (m, f"{role}:"))
        return out

    for (_, own, text), flag in zip(rows, flags, strict=True):
        new = {}
        for s, (c, a, m) in insert(best).items():
            put(new, s, c + 2, a + "D", m)
            if flag not in ("blank", "duplicate"):
                for edit, role, price in (("K", own, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    put(new, follows(s, role[:1]), c + price + 5 * (flag == "truncated"), a + edit, (m, f"{role}:{text}"))
        best = new
    end = insert(best)
    cost, audit, m = min(end[s] for s in ("", "a") if s in end)
    made = []
    while m:
        m, x = m
        made.append(x)
    return cost, audit, made[::-1]


def test_plan_is_native_with_one_exchange(spark):
    plan = repair.op12(spark.createDataFrame([(1, 1, "user", "a.")], TURNS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Python" not in plan
