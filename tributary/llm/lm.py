"""LM scoring: Stupid backoff over n-gram counts of the corpus, computed relationally.

The model is a bigram model over every word of the corpus:

    S(w | v) = c(v w) / c(v)          if the bigram occurs elsewhere,
               ALPHA * n(w) / N       if not, and n(w) / N for the first word of a text.

A document's own occurrences are taken out of both c(v w) and c(v), so that a text does not vouch for
itself; the end of the chain, n(w) / N, is of the whole corpus, since a word that nothing else has would
have no score there. Words and bigrams are keyed by 64-bit hashes; no word is merged with another.

1. Documents are dealt into blocks of some megabytes by the hash of their row. This shuffle of the texts
   is read twice.
2. Asking: a block sends each different key (word or bigram) once, with its number in the block. Keys go by
   their range to buckets, a row for each block and bucket, packed as the differences of sorted keys.
3. Counting: a bucket adds up its keys and answers each block with the counts alone, in the order of its keys.
4. Scoring: a block meets its answers, finds the same keys in the same order, and scores its documents.

So every key is counted whole, nothing is broadcast or held by the driver but N and the number of bytes, and
what is shuffled is in proportion to the input. A block and a bucket are bounded by ``BLOCK`` and ``BUCKET``,
by the longest text, and by rows that are equal in key and text, which share a block.

Defined cases: null or empty text has no words and score 0 (and no mean); repeated rows are scored each
on its own and count each time, so exact copies vouch for each other; null keys are kept; an empty table
scores nothing; other columns are left out, so none can clash. Results don't depend on blocks and buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import words as W

ALPHA = 0.4
#: Bytes of text in a block, and words of the corpus whose keys go to a bucket, on the average.
BLOCK = 6 << 20
BUCKET = 1 << 21


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit keys of bigrams."""
    p = W.powers(2, 2)
    with np.errstate(over="ignore"):
        return W.mix(v * p[0] + w * p[1])


def pack(x: np.ndarray) -> bytes:
    """Integers of 64 bits, as few bytes of each as the largest needs: all lowest bytes first, since high ones are mostly 0."""
    wide = max(1, -(-int(x.max()).bit_length() // 8))
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def unpack(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(packed, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view(np.uint64).reshape(-1)


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts in turn: hashes, number in each text, places of those with another after them, and bigram keys there."""
    own = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)), *((c.hash, np.diff(c.offset)) for part in texts.chunks for c in W.chunks(part))]
    h, size = (np.concatenate(x) for x in zip(*own, strict=True))
    at = W.ranges(np.cumsum(size) - size, np.maximum(size - 1, 0))
    return h, size, at, pair_keys(h[at], h[at + 1])


def measure(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Number of words and of bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, _ = W.buffers(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([W.number(batch.column(0))]), pa.array([int(offsets[-1] - offsets[0])])], names=["n", "b"])

    return tuple(x or 0 for x in docs.select(text).mapInArrow(run, "n long, b long").agg(F.sum("n"), F.sum("b")).first())


def asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, size, keys, ns): the different keys of each block that belong to a bucket, and their numbers in the block."""

    def run(rows: pa.Table) -> pa.Table:
        h, _, _, pair = tokens(rows["text"])
        keys, n = np.unique(np.concatenate([h, pair]), return_counts=True)
        first = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
        cut = np.append(np.searchsorted(keys, first), len(keys))
        full = np.flatnonzero(np.diff(cut))
        parts = [slice(a, b) for a, b in zip(cut[full], cut[full + 1], strict=True)]
        packed = [pack(np.diff(keys[x], prepend=first[i])) for i, x in zip(full, parts, strict=True)]
        columns = [full.astype(np.int32), np.full(len(full), rows["block"][0].as_py(), np.int32), np.diff(cut)[full].astype(np.int32)]
        return pa.table([*map(pa.array, columns), pa.array(packed, pa.binary()), pa.array([pack(n[x]) for x in parts], pa.binary())], names=["bucket", "block", "size", "keys", "ns"])

    return blocks.groupBy("block").applyInArrow(run, "bucket int, block int, size int, keys binary, ns binary")


def answered(asked: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, size, counts): the numbers of the same keys, in the same order, in the whole corpus."""

    def run(rows: pa.Table) -> pa.Table:
        size, first = rows["size"].to_pylist(), np.uint64((rows["bucket"][0].as_py() << 64) // buckets)
        with np.errstate(over="ignore"):
            keys = np.concatenate([first + np.cumsum(unpack(x.as_py(), k), dtype=np.uint64) for x, k in zip(rows["keys"], size, strict=True)])
        n = np.concatenate([unpack(x.as_py(), k) for x, k in zip(rows["ns"], size, strict=True)])
        _, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, n).astype(np.uint64)[which]
        packed = [pack(x) for x in np.split(total, np.cumsum(size)[:-1])]
        return pa.table([rows["block"], rows["bucket"], rows["size"], pa.array(packed, pa.binary())], names=["block", "bucket", "size", "counts"])

    return asked.groupBy("bucket").applyInArrow(run, "block int, bucket int, size int, counts binary")


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = 0, alpha: float = ALPHA, head_words: int = 0, filter_bits: int = 0, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(key, n_tokens, n_seen, score, mean_score) of every row: n_seen bigrams occur elsewhere; score is the natural log.

    head, head_words and filter_bits set short cuts of an earlier form, and change nothing.
    """
    n, n_bytes = measure(docs, text)
    total, n_blocks, n_buckets = max(n, 1), n_bytes // block + 1, n // bucket + 1
    # a function of the row alone, so that a block is the same whenever it is made
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    own = own.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(n_blocks)).cast("int"))
    # no fewer partitions than other shuffles have, or the texts would be dealt anew to meet the answers
    blocks = own.repartition(max(n_blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        h, size, at, pair = tokens(rows["text"])
        both = np.concatenate([h, pair])
        del h, pair  # the largest arrays of a task
        keys, which = np.unique(both, return_inverse=True)
        which, n_words, n_keys = which.astype(np.int32), len(both) - len(at), len(keys)
        del both, keys
        answers = answers.sort_by("bucket")
        found = [unpack(x.as_py(), k) for x, k in zip(answers["counts"], answers["size"].to_pylist(), strict=True)]
        count = np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.int64)
        if len(count) != n_keys:
            raise ValueError(f"a block of {n_keys} keys got {len(count)} counts")
        word, bigram = which[:n_words], which[n_words:]
        # which words a bigram has
        history, last = np.zeros(n_keys, np.int32), np.zeros(n_keys, np.int32)
        history[bigram], last[bigram] = word[at], word[at + 1]
        doc = np.repeat(np.arange(len(size)), size)
        mine, n_mine = np.unique(doc << 32 | word, return_counts=True)
        both, n = np.unique(doc[at] << 32 | bigram, return_counts=True)
        d, k = both >> 32, both & 0xFFFFFFFF
        left = count[k] - n
        part = n * np.log(alpha * count[last[k]] / total)
        seen = np.flatnonzero(left > 0)
        v, left = history[k[seen]], left[seen]
        elsewhere = count[v] - n_mine[np.searchsorted(mine, d[seen] << 32 | v)]
        part[seen] = n[seen] * np.log(left / np.maximum(elsewhere, left))
        some = np.flatnonzero(size)
        score = np.bincount(d, part, len(size)).astype(np.float64)
        score[some] += np.log(count[word[(np.cumsum(size) - size)[some]]] / total)
        n_seen = np.bincount(d[seen], n[seen], len(size)).astype(np.int64)
        return pa.table([rows["key"], pa.array(size), pa.array(n_seen), pa.array(score)], names=["key", "n_tokens", "n_seen", "score"])

    kind = docs.schema[key].dataType.simpleString()
    answers = answered(asked(blocks, n_buckets), n_buckets)
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"key {kind}, n_tokens long, n_seen long, score double")
    return out.select(F.col("key").alias(key), "n_tokens", "n_seen", "score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("mean_score"))


def op4(docs: DataFrame) -> DataFrame:
    """Scores rounded to four places, so that the order in which parts are summed doesn't show."""
    out = scores(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "n_seen", F.round("score", 4).alias("score"), F.round("mean_score", 4).alias("mean_score"))
