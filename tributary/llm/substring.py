"""Substring dedup with suffix automata of reference shards.

A word goes if a window of ``WINDOW`` words over it also starts earlier in the corpus. An automaton of
the whole corpus would neither fit a task nor a broadcast, and streaming every document through every
shard is quadratic, so both sides are routed by content:

1. Anchors. Each window has one anchor: the leftmost of its 4-word groups with the smallest hash. Equal
   windows have equal anchors, so all occurrences of a window share a reference shard. Consecutive
   windows with one anchor form a segment (at most 17 windows, which differ from each other).
2. Anchors that occur once can't belong to a repeated window. The others keep their segments; segments
   with equal words are one content, whose first occurrence (smallest doc_id, then start) counts.
3. A shard holds the contents of some anchors. Each content is streamed, in corpus order, through the
   automaton of the earlier contents of its anchor: wherever the matching statistic reaches the
   window, that window occurs earlier. Then it is added. The result is a bit mask per content. Anchors
   with one content need no automaton: nothing is before it. Anchors with more than ``SPLIT`` contents
   (a common passage in ever other surroundings) are split by window, so no group grows with the data.
4. Occurrences take the mask of their content; every occurrence but the first loses all its windows.
5. Masks are gathered per document, and the maximal spans of marked windows are cut from the text.

Words are told apart by 64-bit hashes throughout; texts are read again wherever words are needed.

Defined cases: null or empty text has no words; texts of fewer than 20 words lose nothing; rows that
repeat a doc_id are read as one document's occurrences at the same places: they don't count as earlier
than each other, and each loses what any of them loses; rows with a null doc_id are left as they are
and repeat nothing; other columns pass through, but for the added ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tributary.llm import words as W
from tributary.llm.automaton import SuffixAutomaton
from tributary.llm.shared import aside, saved

WINDOW = 20
GROUP = 4
SPLIT = 500


def segments(c: W.Words, window: int = WINDOW, group: int = GROUP) -> tuple[np.ndarray, ...]:
    """anchor hash, content hash, document, start word in the document, windows: of each segment."""
    total, none = len(c.hash), np.zeros(0, np.int64)
    if total < window:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    value = W.window_hashes(c.hash, group, 5)
    place = np.arange(len(value), dtype=np.int64)
    span, goal = 1, window - group + 1
    while span < goal:  # leftmost smallest group of each window, by doubling
        step = min(span, goal - span)
        right = value[step:] < value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        span += step
    counts = np.maximum(np.diff(c.offset) - window + 1, 0)
    at = W.ranges(c.offset[:-1], counts)
    if not len(at):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    anchor = place[at]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]) | np.append(True, at[1:] != at[:-1] + 1))
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    with np.errstate(over="ignore"):
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(c.hash * W.powers(6, total), out=sums[1:])
        content = W.mix((sums[start + n + window - 1] - sums[start]) * W.powers(6, total, inverse=True)[start] + n.astype(np.uint64))
    doc = np.searchsorted(c.offset, start, side="right") - 1
    return value[start], content, doc, start - c.offset[doc], n


def anchor_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(h, times): anchors that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [segments(c)[0] for c in W.chunks(batch.column(0))]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "times"])

    known = docs.where(F.col(key).isNotNull()).select(text)
    return known.mapInArrow(run, "h long, times long").groupBy("h").agg(F.sum("times").alias("times")).where("times > 1")


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(h, c, doc, start, n): every segment of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch.column(1)):
                h, content, doc, start, n = segments(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(pa.array(doc + c.first)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["h", "c", "doc", "start", "n"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, f"h long, c long, doc {kind}, start int, n int")


def contents_with_words(contents: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(g, h, c, doc, start, shift, tokens): the words of the contents, a row per window where `split`."""
    wanted = contents.groupBy("doc").agg(F.collect_list(F.struct("h", "c", "start", "n", "split")).alias("_wanted")).withColumnRenamed("doc", "_doc")
    # all columns go along: the same shuffle of the documents then serves the last step
    met = docs.where(F.col(key).isNotNull()).join(wanted, F.col(key) == F.col("_doc")).drop("_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_wanted")
            flat, bounds = lists.flatten(), lists.offsets.to_numpy()
            h, content, start, n, split = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            bounds = bounds - bounds[0]
            for c in W.chunks(batch.column(text)):
                lo, hi = bounds[c.first], bounds[c.first + c.n_docs]
                if lo == hi:
                    continue
                doc = np.repeat(np.arange(c.n_docs), np.diff(bounds[c.first : c.first + c.n_docs + 1]))
                at = c.offset[doc] + start[lo:hi]
                size = n[lo:hi].astype(np.int64)
                # rows that repeat a doc_id may be shorter than the one the content comes from
                ok = at + size + WINDOW - 1 <= c.offset[doc + 1]
                own = np.flatnonzero(ok) + lo
                doc, at, size, parted = doc[ok], at[ok], size[ok], split[own].astype(bool)
                times = np.where(parted, size, 1)
                row = np.repeat(np.arange(len(own)), times)
                shift = W.ranges(np.zeros(len(own), np.int64), times)
                begin = at[row] + shift
                length = np.where(parted[row], WINDOW, size[row] + WINDOW - 1)
                words = c.hash[W.ranges(begin, length)]
                ends = np.concatenate([[0], np.cumsum(length * 8)]).astype(np.int32)
                group = h[own][row].copy()
                if parted.any():
                    hashes = W.window_hashes(c.hash, WINDOW, 7).view(np.int64)
                    group[parted[row]] = hashes[begin[parted[row]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group), pa.array(h[own][row]), pa.array(content[own][row]), batch.column(key).take(pa.array(doc[row] + c.first)), pa.array((start[own][row] + shift).astype(np.int32)), pa.array(shift.astype(np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.tobytes())])],
                    names=["g", "h", "c", "doc", "start", "shift", "tokens"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return met.mapInArrow(run, f"g long, h long, c long, doc {kind}, start int, shift int, tokens binary")


def earlier_windows(rows: DataFrame) -> DataFrame:
    """(h, c, mask): windows of each content that an earlier content of its anchor has; 0 where none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = before = None
        sam, begun = SuffixAutomaton(), False
        for batch in batches:
            masks = np.zeros(batch.num_rows, np.int64)
            shifts = batch.column("shift").to_numpy()
            tokens = batch.column("tokens")
            names = zip(*(batch.column(k).to_pylist() for k in ("g", "c", "doc", "start")), strict=True)
            for i, name in enumerate(names):
                if name == before:  # of a row that repeats a doc_id
                    continue
                before, g = name, name[0]
                if g != group:
                    group, sam, begun = g, SuffixAutomaton(), False
                own = np.frombuffer(tokens[i].as_buffer(), np.uint64).tolist()
                mask = 0
                if begun:
                    for k, (n, _) in enumerate(sam.matches(own)):
                        if n >= WINDOW:
                            mask |= 1 << (k + 1 - WINDOW)
                if not begun or mask != (1 << (len(own) - WINDOW + 1)) - 1:
                    sam.add(own)
                begun = True
                masks[i] = mask << int(shifts[i])
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(masks)], names=["h", "c", "mask"])

    ordered = rows.repartition("g").sortWithinPartitions("g", "doc", "start", "c")
    return ordered.mapInArrow(run, "h long, c long, mask long").groupBy("h", "c").agg(F.bit_or("mask").alias("mask"))


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, marks): per document, the segments with marked windows (start, mask)."""
    found = saved(occurrences(docs, key, text).join(anchor_counts(docs, key, text).select("h"), "h"), "segments")
    contents = found.groupBy("h", "c").agg(F.min(F.struct("doc", "start")).alias("first"), F.max("n").alias("n"))
    several = contents.groupBy("h").agg(F.count("*").alias("k"))
    contents = saved(contents.join(several, "h").select("h", "c", "first.doc", "first.start", "n", "k"), "contents")
    shared = contents.where("k > 1").withColumn("split", F.col("k") > SPLIT)
    masks = earlier_windows(contents_with_words(shared, docs, key, text)).where("mask != 0")
    first = contents.select("h", "c", F.col("doc").alias("doc0"), F.col("start").alias("start0")).join(masks, ["h", "c"], "left")
    whole = F.expr("shiftleft(1L, n) - 1")
    own = F.when((F.col("doc") == F.col("doc0")) & (F.col("start") == F.col("start0")), F.coalesce("mask", F.lit(0))).otherwise(whole)
    rows = found.join(first, ["h", "c"]).select("doc", "start", own.cast("long").alias("mask")).where("mask != 0")
    return rows.groupBy("doc").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))


ADDED = ["n_words", "n_removed", "kept_sha256"]


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: bool = True) -> DataFrame:
    """docs with n_words, n_removed and kept_sha256 (of the kept words, joined by a space); with
    `rewrite` the text without the removed words and what follows them, else without the text."""
    own = [f for f in docs.schema if f.name not in ADDED and (rewrite or f.name != text)]
    schema = T.StructType([*own, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    out_schema = to_arrow_schema(schema)
    docs = docs.select(*(f.name for f in docs.schema if f.name not in ADDED))
    found = marks(docs, key, text).select(F.col("doc").alias("_doc"), F.col("marks").alias("_marks"))
    known = docs.where(F.col(key).isNotNull()).join(found, F.col(key) == F.col("_doc"), "left").drop("_doc")
    met = known.union(docs.where(F.col(key).isNull()).withColumn("_marks", F.lit(None).cast(found.schema["_marks"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows = batch.column("_marks"), batch.num_rows
            n_words, n_removed = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            hashes, texts = [], []
            for c in W.chunks(batch.column(text)):
                n_words[c.first : c.first + c.n_docs] = np.diff(c.offset)
                raw = c.data.tobytes()
                for d in range(c.n_docs):
                    lo, hi = int(c.offset[d]), int(c.offset[d + 1])
                    gone = np.zeros(hi - lo, bool)
                    for m in lists[c.first + d].as_py() or ():
                        bits = m["mask"]
                        for s, e in runs(bits):
                            gone[m["start"] + s : m["start"] + e + WINDOW - 1] = True
                    n_removed[c.first + d] = gone.sum()
                    left = np.flatnonzero(~gone) + lo
                    hashes.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(c.start[left].tolist(), c.end[left].tolist(), strict=True)])).hexdigest())
                    if rewrite:
                        texts.append(without(raw, c, lo, hi, gone) if gone.any() else None)
            columns = []
            for f in own:
                column = batch.column(f.name)
                if f.name == text:
                    new = pa.array(texts, pa.string())
                    column = pc.if_else(pa.array(n_removed > 0), new, column)
                columns.append(column)
            columns += [pa.array(n_words), pa.array(n_removed), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays([x.cast(t) if x.type != t else x for x, t in zip(columns, out_schema.types, strict=True)], schema=out_schema)

    return met.mapInArrow(run, schema)


def runs(bits: int) -> Iterator[tuple[int, int]]:
    """Stretches of set bits: first, and the place after the last."""
    at = 0
    while bits:
        zeros = (bits & -bits).bit_length() - 1
        bits >>= zeros
        at += zeros
        ones = (~bits & (bits + 1)).bit_length() - 1
        yield at, at + ones
        bits >>= ones
        at += ones


def without(raw: bytes, c: W.Words, lo: int, hi: int, gone: np.ndarray) -> str:
    """The bytes of words lo:hi, cutting each marked span together with the white space after it."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    base = int(c.start[lo])
    parts, done = [], base
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        parts.append(raw[done : int(c.start[lo + s])])
        done = int(c.start[lo + e]) if lo + e < hi else int(c.end[hi - 1])
    return b"".join([*parts, raw[done : int(c.end[hi - 1])]]).decode("utf-8", "replace")


def op2(docs: DataFrame) -> DataFrame:
    return deduplicated(docs.select("doc_id", "text"), rewrite=False)


def stage(docs: DataFrame) -> DataFrame:
    """Documents without repeated spans; one of which nothing is left goes. Columns of any name pass through."""
    own, names = aside(docs, [*ADDED, "_marks", "_doc", "_wanted"])
    return deduplicated(own).where("n_words = 0 or n_removed < n_words").select(*own.columns).withColumnsRenamed(names)
