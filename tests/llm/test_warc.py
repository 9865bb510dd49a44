"""WARC: round trips, and the roles of records with equal payloads."""

from __future__ import annotations

import base64
import hashlib
import random

from pyspark.sql import functions as F

from tributary.llm import warc

PAGES = "page_id long, url string, html string"


def pages() -> list[tuple]:
    rng = random.Random(1)
    texts = [None, "", "a", "é" * 9000, "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 1000, "€" * 30_001, "😀z" * 20_000]
    rows = [(i, f"http://h/{i}\n", t) for i, t in enumerate(texts)]
    rows += [(100 + i, None, rng.choice([*texts, "fresh" * i])) for i in range(40)]
    return rows + [(500, "u", "same id"), (500, "u", "same id"), (501, "u", "same id")]


def test_round_trip(spark):
    rows = pages()
    got = warc.op7(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    want = []
    for k, _, t in rows:
        p = (t or "").encode()
        first = min(a for a, _, b in rows if (b or "") == (t or ""))
        want.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if k == first else "revisit", None if k == first else first))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    assert all(r.valid for r in got)
    assert warc.op7(spark.createDataFrame([], PAGES)).count() == 0
    assert {r.record_type for r in warc.op7(spark.createDataFrame([(None, None, "t"), (3, "u", "t")], PAGES)).collect()} == {"response"}


def test_payloads_and_small_revisits(spark, tmp_path):
    rows = [(k, u, t) for k, u, t in pages() if k < 200]
    warc.write(spark.createDataFrame(rows, PAGES), f"{tmp_path}/a", segment=300, min_bytes=2)
    read = warc.read_records(spark, f"{tmp_path}/a")
    got = warc.payloads(warc.reassembled(read)).collect()
    assert sorted((r.payload or b"") for r in got if r.type == "response" and r.payload_bytes < 2) == sorted((t or "").encode() for *_, t in rows if len((t or "").encode()) < 2)
    assert {bytes(r.payload) for r in got if r.type == "response"} == {(t or "").encode() for *_, t in rows}
    assert len(got) == len(rows) and all(r.valid for r in got)
    # a lost or repeated segment is noticed
    longest = read.where("number > 3").groupBy("origin").count().orderBy(F.desc("count")).first()["origin"]
    lost = read.where((F.coalesce("origin", "id") != longest) | (F.coalesce("number", F.lit(1)) != 3))
    bad = [r for r in warc.payloads(warc.reassembled(lost)).collect() if not r.valid]
    assert [r.id for r in bad] == [longest]


def test_chunks():
    body = warc.chunked(b"abc" * 5000)
    assert warc.unchunked(body) == b"abc" * 5000
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
