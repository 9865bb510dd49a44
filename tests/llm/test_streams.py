"""Decontamination, licence scans and token counts against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from tests.llm import cases
from tributary.llm import decontaminate, licenses, token_counts
from tributary.llm.automaton import SuffixAutomaton


def test_matching_statistics_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randrange(0, 14))) for _ in range(4)]
        sam = SuffixAutomaton()
        for t in texts:
            sam.add(t)
        query = "".join(rng.choice("abcd") for _ in range(20))
        for i, (n, _) in enumerate(sam.matches(query)):
            best = max(k for k in range(i + 2) if any(query[i + 1 - k : i + 1] in t for t in texts))
            assert n == best


def brute_hits(words: list[str], items: list[tuple[int, list[str]]]) -> tuple[int, list[str]]:
    hit, found = set(), set()
    for k, item in items:
        n = min(10, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(k))
    return len(hit), sorted(found)


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("shard_words", [200_000, 30])
def test_decontamination(spark, short, shard_words):
    rows = cases.documents()
    words = [cases.mark_words(t) for _, t, *_ in rows]
    long = [w for w in words if len(w) > 40]
    items = [(10 + i, " ".join(w[5 + i : 20 + i]).upper().replace("É", "é").replace("Ñ", "ñ").replace("STRASSE", "straße")) for i, w in enumerate(long[:9])]
    items += [(10, items[0][1]), (99, None), (98, ""), (97, "nothing like it")]
    if short:
        items += [(1, "w3"), (2, "tie TIE"), (3, " ".join(long[3][3:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string, extra int") if False else spark.createDataFrame(items, "item_id long, text string")
    docs = cases.frame(spark, rows)
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, shard_words=shard_words).collect()}
    pairs = [(k, cases.mark_words(t)) for k, t in items]
    for (doc_id, *_), w in zip(rows, words, strict=True):
        n, ids = brute_hits(w, pairs)
        assert (got[doc_id].n_words, got[doc_id].n_hit, list(got[doc_id]["items"])) == (len(w), n, ids)
    assert any(r.n_hit for r in got.values())
    out = {r.doc_id: r for r in decontaminate.op9(docs, bench).collect()}
    assert all(out[k].items_sha256 == hashlib.sha256(",".join(brute_hits(w, pairs)[1]).encode()).hexdigest() for (k, *_), w in zip(rows, words, strict=True))
    for r in decontaminate.stage(docs, bench).collect():
        n, _ = brute_hits(cases.mark_words(dict((k, t) for k, t, *_ in rows)[r.doc_id]), pairs)
        assert len(cases.mark_words(r.text)) == got[r.doc_id].n_words - n
        assert n or r.text == dict((k, t) for k, t, *_ in rows)[r.doc_id]


def test_decontamination_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = cases.frame(spark)
    assert decontaminate.contamination(docs, empty).where("n_hit > 0").count() == 0
    assert decontaminate.op9(docs.limit(0), empty).count() == 0
    clash = docs.selectExpr("*", "1 as spans", "'x' as n_hit")
    assert decontaminate.contamination(clash, empty).count() == docs.count()


def test_licence_scan(spark):
    mit = licenses.TEMPLATES["mit"]
    texts = [None, "", "Released under the MIT License.", "GNU General Public license; the apache-license. CC BY cc by", mit, "x " + mit[:200] + " y", "the software is", mit.replace("copies", "examples") + " " + licenses.TEMPLATES["isc"]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.licence_scan(docs).collect()}
    for i, t in enumerate(texts):
        words = cases.mark_words(t)
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert got[i].n_words == len(words) and got[i].n_base == len(places)
        assert got[i].base_labels == ",".join(sorted({x for _, x in places}))
        assert (got[i].first_word, got[i].last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(got[i].base_labels.split(",")) - {""} <= set(got[i]["labels"].split(","))
        assert 0 <= got[i].score <= 1
    assert got[4]["labels"] == "mit" and got[4].score == 1 and got[4].n_base == 0
    assert got[5]["labels"] == "" and 0 < got[5].score < 0.5
    assert got[6]["labels"] == "" and got[7]["labels"] == "isc,mit" and got[7].score > 0.9


def test_token_counts(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = token_counts.vocabulary("word_bpe_49k.json")
    rows = cases.documents() + [(900, "x" * 5000, None, None, 5000), (900, "twice ́a é é ΣΣ  b<|startoftext|>c", None, None, 1)]
    t = Tokenizer.from_file(path)
    for head in (0, 5, 100_000):
        got = token_counts.token_counts(cases.frame(spark, rows).selectExpr("doc_id", "text", "lang as n_tokens", "lang"), path, head=head).collect()
        want = sorted((k, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x, *_ in rows)
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.op5(cases.frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("shard_words", [4, decontaminate.SHARD_WORDS])
def test_items_without_an_id_hit(spark, shard_words):
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(1, f"before {passage} after", None, None, 1), (2, "nothing of the kind", None, None, 1), (3, "Other Item here", None, None, 1)]
    bench = spark.createDataFrame([(None, passage), (None, "unrelated words"), (7, "other item")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(cases.frame(spark, rows), bench, shard_words=shard_words).collect()}
    assert got == {1: (14, []), 2: (0, []), 3: (2, ["7"])}
    out = {r.doc_id: r for r in decontaminate.op9(cases.frame(spark, rows), bench).collect()}
    assert (out[1].n_items, out[1].contaminated, out[1].items_sha256) == (0, True, out[2].items_sha256)
