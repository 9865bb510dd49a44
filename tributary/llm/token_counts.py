"""Token counts without token ids.

A pre-token here is a run of bytes without ASCII white space; the tokenizer's own pre-tokenizer never
crosses one, so counts add up. Three steps, all over the whole corpus:

1. pre-tokens and their frequencies, summed per Arrow batch before the shuffle;
2. each distinct pre-token is counted in pieces once;
3. documents meet the counts: the most frequent pre-tokens (at most ``HEAD`` rows, each of at
   most ``HEAD_BYTES``) are broadcast and settled where the text is read; every other (document,
   pre-token, frequency) row is joined to the table of counts by a shuffle. Pieces are then summed.

Defined cases: null or empty text has no tokens (and 0 bytes); rows may repeat a key: each row is
counted on its own; special strings inside a text are what the library makes of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import words as W
from tributary.llm.shared import most_frequent, saved

HEAD = 100_000
HEAD_BYTES = 64
LIMIT = 2048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _slices(c: W.Words, at: np.ndarray) -> pa.Array:
    """The words at these places, as an Arrow string array."""
    start, size = c.start[at], c.end[at] - c.start[at]
    data = c.data[W.ranges(start, size)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): every pre-token of the corpus and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for c in W.chunks(batch.column(0)):
                if len(c.hash):
                    _, first, n = np.unique(c.hash, return_index=True, return_counts=True)
                    parts.append(pa.table({"piece": _slices(c, first), "n": n.astype(np.int64)}))
            if parts:
                yield from pa.concat_tables(parts).group_by("piece").aggregate([("n", "sum")]).rename_columns(["piece", "n"]).to_batches()

    return docs.select(text).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_counts(pieces: DataFrame, path: str) -> DataFrame:
    """(piece, n, pieces): what the tokenizer makes of each distinct pre-token, counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            own = batch.column(0).to_pylist()
            counts = np.zeros(len(own), np.int64)
            for i in range(0, len(own), 1024):
                counts[i : i + 1024] = [len(e) for e in tokenizer.encode_batch_fast(own[i : i + 1024], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], names=["piece", "n", "pieces"])

    return pieces.mapInArrow(run, "piece string, n long, pieces long")


def token_counts(docs: DataFrame, path: str, text: str = "text", head: int = HEAD) -> DataFrame:
    """The documents with n_bytes and n_tokens. Other columns pass through; text itself is left out."""
    spark = docs.sparkSession
    counts = saved(piece_counts(frequencies(docs, text), path), "pieces")
    top = most_frequent(counts.where(F.octet_length("piece") <= HEAD_BYTES), "n", head).select("piece", "pieces").toArrow()
    frequent = spark.sparkContext.broadcast((top.column(0).combine_chunks(), top.column(1).to_numpy()))
    others = [f for f in docs.schema if f.name not in (text, "n_bytes", "n_tokens")]
    keyed = docs.select(*(f.name for f in others), F.monotonically_increasing_id().alias("_row"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, settled = frequent.value
        _, hashes = _hashes(known)
        order = np.argsort(hashes)
        hashes, known, settled = hashes[order], known.take(pa.array(order)), settled[order]
        for batch in batches:
            done = np.zeros(batch.num_rows, np.int64)
            rows, rest, times = [], [], []
            for c in W.chunks(batch.column(text)):
                if not len(c.hash):
                    continue
                doc = c.doc()
                place = np.minimum(np.searchsorted(hashes, c.hash), max(len(hashes) - 1, 0))
                hit = hashes[place] == c.hash if len(hashes) else np.zeros(len(c.hash), bool)
                done[c.first : c.first + c.n_docs] += np.bincount(doc[hit], settled[place[hit]], c.n_docs).astype(np.int64)
                left = np.flatnonzero(~hit)
                if len(left):
                    own = np.lexsort((c.hash[left], doc[left]))
                    left = left[own]
                    new = np.append(True, (c.hash[left][1:] != c.hash[left][:-1]) | (doc[left][1:] != doc[left][:-1]))
                    at = np.flatnonzero(new)
                    rows.append(doc[left[at]] + c.first)
                    rest.append(_slices(c, left[at]))
                    times.append(np.diff(np.append(at, len(left))))
            offsets, _ = W.buffers(batch.column(text))
            # a row for each document, with what is settled; then its rarer pre-tokens
            at = np.concatenate([np.arange(batch.num_rows), *rows]).astype(np.int64)
            n = len(at) - batch.num_rows
            # a document's own row has a key that no pre-token equals, since it holds a space
            piece = pa.concat_arrays([pc.binary_join_element_wise("row", batch.column("_row").cast(pa.string()), " "), *rest])
            own = [batch.column("_row").take(pa.array(at)), piece, pa.array(np.concatenate([np.ones(batch.num_rows, np.int64), *times])), pa.array(np.concatenate([done, np.zeros(n, np.int64)])), pa.array(np.concatenate([np.diff(offsets), np.zeros(n, np.int64)]))]
            if others:
                mask = pa.array(np.arange(len(at)) >= batch.num_rows)
                keep = [batch.column(f.name).take(pa.array(np.minimum(at, batch.num_rows - 1))) for f in others]
                own += [pc.if_else(mask, pa.scalar(None, x.type), x) for x in keep]
            yield pa.RecordBatch.from_arrays(own, names=["_row", "_piece", "_times", "_done", "_bytes", *(f.name for f in others)])

    kinds = ", ".join(["_row long, _piece string, _times long, _done long, _bytes long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others)])
    rows = keyed.mapInArrow(run, kinds)
    met = rows.join(counts.select(F.col("piece").alias("_piece"), "pieces"), "_piece", "left")
    return (
        met.groupBy("_row")
        .agg(
            F.sum("_bytes").alias("n_bytes"),
            F.sum(F.col("_done") + F.coalesce(F.col("_times") * F.col("pieces"), F.lit(0))).alias("n_tokens"),
            *(F.max(f.name).alias(f.name) for f in others),
        )
        .select(*(f.name for f in others), "n_bytes", "n_tokens")
    )


def _hashes(known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an array of single pre-tokens."""
    parts = [np.zeros(0, np.uint64), *(c.hash for c in W.chunks(known))]
    return np.arange(len(known)), np.concatenate(parts)


def op5(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    out = token_counts(docs.select("doc_id", "text"), vocabulary(name))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
