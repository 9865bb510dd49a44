"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton of the items is broadcast, in shards of at most ``SHARD_WORDS`` words: benchmarks are
small, and a larger one is streamed against one bounded shard after another. Training tokens are
streamed through it; wherever the longest match reaches the window, the words below it are hit.

Only stretches of a document whose words and neighbouring pairs all occur in the items can carry a
match, since these are the first two transitions of the automaton. They are found for a whole chunk
at a time with hash tables; the automaton then walks the real words of those stretches.

Defined cases: null or empty text has no words and no hits; an item without words has no window;
items may repeat (every item_id is reported); an item without an id hits, but has no id to report; an empty benchmark hits nothing; other columns of the
documents are passed through, but for the added ones, which replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tributary.llm import words as W
from tributary.llm.automaton import SuffixAutomaton
from tributary.llm.shared import aside

WINDOW = 10
SHARD_WORDS = 200_000
#: A document is dropped by the pipeline once more than this share of its words is hit.
MAX_COVERAGE = 0.5


class Items:
    """The automaton of one shard of items, with what the stream needs to know of each state."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.window = window
        self.automaton = sam = SuffixAutomaton()
        self.ids = [k for k, _ in items]
        texts = pa.array([t for _, t in items], pa.string())
        sequences: list[list[bytes]] = []
        word_hashes, pair_hashes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for c in W.chunks(texts, mark=True):
            for d in range(c.n_docs):
                sequences.append([c.text(i) for i in range(c.offset[d], c.offset[d + 1])])
            word_hashes.append(c.hash)
            pair_hashes.append(c.windows(2, 2)[1])
        for s in sequences:
            sam.add(s)
        self.full: dict[int, set[int]] = {}  # state of a window -> items that have it
        self.short: dict[int, dict[int, set[int]]] = {}  # state -> length -> items of so few words
        for k, s in enumerate(sequences):
            for i, (n, state) in enumerate(sam.matches(s)):
                if n >= window and i + 1 >= window:
                    self.full.setdefault(sam.of_length(state, window), set()).add(k)
            if s and len(s) < window:
                own = sam.of_length(state, len(s)) if len(s) else 0
                self.short.setdefault(own, {}).setdefault(len(s), set()).add(k)
        #: no match of fewer words is a window
        self.least = min([window if self.full else 1 << 30, *(n for x in self.short.values() for n in x)])
        self.words = np.unique(np.concatenate(word_hashes))
        self.pairs = np.unique(np.concatenate(pair_hashes))

    def hits(self, tokens: list[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """start, end and items of each window that occurs in the tokens."""
        sam, window, full, short = self.automaton, self.window, self.full, self.short
        for i, (n, state) in enumerate(sam.matches(tokens)):
            if n >= window:
                own = full.get(sam.of_length(state, window))
                if own:
                    yield i + 1 - window, i + 1, own
            if short and n:
                # the longest match may be cut to any suffix: look along the links
                while state > 0:
                    for length, own in short.get(state, {}).items():
                        if length <= n:
                            yield i + 1 - length, i + 1, own
                    state = sam.link[state]
                    n = min(n, sam.length[state]) if state > 0 else 0


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values; a small bit table settles most of them."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    bits = max(16, int(len(sorted_values) * 16).bit_length())
    shift = np.uint64(64 - bits)
    seen = np.zeros(1 << bits, bool)
    seen[sorted_values >> shift] = True
    out = seen[x >> shift]
    at = np.flatnonzero(out)
    own = x[at]
    place = np.minimum(np.searchsorted(sorted_values, own), len(sorted_values) - 1)
    out[at] = sorted_values[place] == own
    return out


def stretches(c: W.Words, items: Items) -> list[tuple[int, int, int]]:
    """(document, start, end) of stretches of words that may carry a window."""
    n = len(c.hash)
    if not n or items.least > n:
        return []
    known = member(items.words, c.hash)
    joined = np.zeros(n, bool)  # word i and word i - 1 are neighbours in some item
    both = np.flatnonzero(known[1:] & known[:-1]) + 1
    if len(both):
        with np.errstate(over="ignore"):
            p = W.powers(2, 2)
            pair = W.mix(c.hash[both - 1] * p[0] + c.hash[both] * p[1])
        joined[both] = member(items.pairs, pair)
    joined[c.offset[:-1][np.diff(c.offset) > 0]] = False
    breaks = np.flatnonzero(~joined)
    ends = np.append(breaks[1:], n)
    keep = (ends - breaks >= items.least) & known[breaks]
    start, end = breaks[keep], ends[keep]
    docs = np.searchsorted(c.offset, start, side="right") - 1
    return list(zip(docs.tolist(), start.tolist(), end.tolist(), strict=True))


ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping or touching spans joined; flat: start, end, start, end ..."""
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def scan(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int, text: str) -> DataFrame:
    """One pass of the documents against one shard of items; earlier spans and items are kept."""
    again = "spans" in docs.columns
    others = [f for f in docs.schema if f.name not in ADDED.names]
    schema = T.StructType([*others, *ADDED])
    out_schema = to_arrow_schema(schema)
    shard = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(shard.value, window)
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
            found: list[list[str]] = [[] for _ in range(batch.num_rows)]
            if again:
                spans, found = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for c in W.chunks(batch.column(text), mark=True):
                n_words[c.first : c.first + c.n_docs] = np.diff(c.offset)
                by_doc: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
                for d, start, end in stretches(c, own):
                    for s, e, which in own.hits([c.text(i) for i in range(start, end)]):
                        at, ids = by_doc.setdefault(d, ([], set()))
                        at.append((start + s - int(c.offset[d]), start + e - int(c.offset[d])))
                        ids |= which
                for d, (at, ids) in by_doc.items():
                    k = c.first + d
                    spans[k] = merged([*at, *zip(spans[k][::2], spans[k][1::2], strict=True)])
                    found[k] = sorted({*found[k], *(own.ids[i] for i in ids if own.ids[i] is not None)})
            n_hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
            columns = [batch.column(f.name) for f in others] + [pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([x.cast(t) if x.type != t else x for x, t in zip(columns, out_schema.types, strict=True)], schema=out_schema)

    return docs.select(*(f.name for f in others), *(["spans", "items"] if again else [])).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents with n_words, n_hit, spans (flat word places, end excluded) and items (ids, as strings)."""
    docs = docs.drop(*ADDED.names)
    items = benchmark.select(F.col(item_id).cast("string").alias("k"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.coalesce(F.length("t"), F.lit(0)))).first()[0] or 0
    shards = max(1, -(-size // (6 * shard_words)))
    out = docs
    for s in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(shards)) == s)
        out = scan(out, [(r.k, r.t) for r in own.collect()], window, text)
    return out


def without_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The text with the words of ``spans`` taken out, together with what separates them."""
    names = [f for f in docs.schema if f.name not in ADDED.names]
    schema = T.StructType(names)
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text), batch.column("spans").to_pylist()
            new = texts.to_pylist()
            for k in (k for k, x in enumerate(spans) if x):
                c = next(W.chunks(texts.slice(k, 1), mark=False))  # bytes unchanged
                at = W.cut(W.lower(c.data), np.array([0, len(c.data)]), mark=True)
                raw, parts, done = c.data.tobytes(), [], 0
                for s, e in zip(spans[k][::2], spans[k][1::2], strict=True):
                    parts.append(raw[done : at.start[s]])
                    done = int(at.start[e]) if e < len(at.start) else len(raw)
                new[k] = b"".join([*parts, raw[done:]]).decode("utf-8", "replace")
            columns = [pa.array(new, pa.string()) if f.name == text else batch.column(f.name) for f in names]
            yield pa.RecordBatch.from_arrays([x.cast(t) if x.type != t else x for x, t in zip(columns, out_schema.types, strict=True)], schema=out_schema)

    return docs.mapInArrow(run, schema)


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns; window by window, over whole documents."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Documents without hit spans; one that the benchmark covers beyond the limit is dropped whole.

    Rows with null or repeated ids are rows like others; columns of any name pass through.
    """
    own, names = aside(docs, ADDED.names)
    found = contamination(own, benchmark)
    return without_spans(found.where(F.col("n_hit") <= F.col("n_words") * max_coverage)).select(*own.columns).withColumnsRenamed(names)
