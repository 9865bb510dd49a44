"""MinHash near-duplicates by min-max hashing, on five-word shingles of the text with A-Z in lower case.

Under each permutation both the minimum and the maximum of a document's shingle hashes are kept, so a
signature of ``ROWS * BANDS`` values takes half as many hash evaluations. The first half of the bands
is made of minima, the second of the maxima under the same permutations; within a band all values come
from different permutations. At a similarity of 0.75 a pair misses every band with a chance of 2e-5.

1. One row per document: size, 128-bit fingerprint of the set, band keys (numpy, from the text).
2. Documents with equal sets are one class; its smallest doc_id stands for it from here on. Thousands
   of copies are thus a single row.
3. Bucket by bucket each representative is held against a centre, the document that has most company:
   a star, never all pairs. Links are confirmed on the full shingle sets, from the whole texts, and
   contracted to components.
4. What is undecided then (documents of one bucket, in different components, neither its centre) is
   settled by the shingles themselves: documents with too few shingles in common with all other
   components are done. Only the rest is compared, in blocks that give a forest of links.
5. Components again, over all links; copies get the component of their representative.

Defined cases: null or empty text has an empty set and is linked with nothing (its own component);
texts of fewer than five words have one shingle, the whole sequence; rows that repeat a doc_id are one
node, linked by what any of them holds; a null doc_id is in a component of its own; other columns pass
through ``components_of`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import graph
from tributary.llm import words as W
from tributary.llm.shared import release, saved

SHINGLE = 5
PERCENT = 75
BLOCK = 256
BLOCK_SETS = 200_000
ROWS = 5
BANDS = 40


def shingle_sets(c: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of the distinct shingles of each document, sorted within the document."""
    counts = np.diff(c.offset)
    at, hashes = c.windows(size)
    doc = np.repeat(np.arange(c.n_docs), np.maximum(counts - size + 1, 0))
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        own = np.array([W.window_hashes(c.hash[c.offset[d] : c.offset[d + 1]], int(counts[d]), 3)[0] for d in few], np.uint64)
        doc, hashes = np.concatenate([doc, few]), np.concatenate([hashes, own])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return np.searchsorted(doc, np.arange(c.n_docs + 1)), hashes


def band_keys(offset: np.ndarray, hashes: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Of each document with shingles, a 64-bit key per band."""
    half = bands // 2
    odd = np.random.default_rng(W.SEED).integers(0, 1 << 31, rows * half).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    some = np.flatnonzero(np.diff(offset) > 0)
    keys = np.zeros((len(offset) - 1, bands), np.uint64)
    if not len(some):
        return keys
    starts, short = offset[:-1][some], (hashes >> np.uint64(32)).astype(np.uint32)
    permuted = np.empty_like(short)
    p = np.uint64(W._odd(4)[0])
    low, high = (np.zeros((half, len(some)), np.uint64) for _ in range(2))
    with np.errstate(over="ignore"):
        for band in range(half):
            for r in range(rows):
                np.multiply(short, odd[band * rows + r], out=permuted)
                low[band] = low[band] * p + np.minimum.reduceat(permuted, starts)
                high[band] = high[band] * p + np.maximum.reduceat(permuted, starts)
        number = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        keys[some] = W.mix(W.mix(np.concatenate([low, high]).T) + number)
    return keys


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc, n, f1, f2, keys): set size, fingerprint and band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch.column(1), lowered=True):
                offset, hashes = shingle_sets(c)
                n = np.diff(offset)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(hashes ^ np.uint64(s)))]) for s in (0x5DEECE66D, 0xB5026F5AA96619E9)]
                with np.errstate(over="ignore"):
                    f1, f2 = ((x[offset[1:]] - x[offset[:-1]]).view(np.int64) for x in sums)
                keys = band_keys(offset, hashes, rows, bands).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n_docs), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), lists], names=["doc", "n", "f1", "f2", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc"), F.col(text)).mapInArrow(run, f"doc {kind}, n long, f1 long, f2 long, keys array<long>")


def sets_of(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted shingle hashes of each different text of a column, and which of them each row has."""
    coded = column.dictionary_encode()
    sets: list[np.ndarray] = []
    for c in W.chunks(coded.dictionary, lowered=True):
        offset, hashes = shingle_sets(c)
        sets += [hashes[offset[d] : offset[d + 1]] for d in range(c.n_docs)]
    return sets, coded.indices.to_numpy(zero_copy_only=False)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if not len(a) or not len(b):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. texts: (doc, text)."""
    met = pairs.select("a", "b").join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a join by a leaves the rows of one a together: its set is made once a batch
            (sa, ia), (sb, ib) = (sets_of(batch.column(k)) for k in (2, 3))
            keep = []
            for i, j in zip(ia.tolist(), ib.tolist(), strict=True):
                both = common(sa[i], sb[j])
                keep.append(both > 0 and 100 * both >= percent * (len(sa[i]) + len(sb[j]) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return met.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the component of their document; a document without links is its own."""
    named = rows.drop("component").join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    return named.withColumn("component", F.coalesce("component", "doc"))


def undecided(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return rows.join(mixed, "key", "left_semi")


def peeled(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stars of the buckets, and the rows without their centres. rows: (key, doc, n, m, component),
    n and m being the least and largest set of the document's rows there.

    The centre of a bucket is the document that has most company in all of its buckets: the text that
    its variants were made of, if it is there. Held against the centre are the bucket's documents of
    other components whose sizes allow a link; centre and bucket are then done with each other.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"))
    company = rows.join(sizes, "key").groupBy("doc").agg(F.sum("size").alias("company"))
    order = F.struct(-F.col("company"), "doc", "component", "n", "m")
    centres = rows.join(company, "doc").groupBy("key").agg(F.min(order).alias("c"))
    centres = saved(centres.select("key", F.col("c.doc").alias("a"), F.col("c.component").alias("ca"), F.col("c.n").alias("na"), F.col("c.m").alias("ma")), "centres")
    met = saved(rows.join(centres, "key").where("doc <> a"), "met")
    fits = (100 * F.col("m") >= percent * F.col("na")) & (100 * F.col("ma") >= percent * F.col("n"))
    stars = met.where(F.col("component") != F.col("ca")).where(fits).groupBy("a", F.col("doc").alias("b")).agg(F.count("*").alias("bands"))
    return stars, met.drop("a", "ca", "na", "ma")


def closed(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The rows without the documents that can't be linked with another component.

    A shingle crosses if documents of several components have it. What a document shares with one of
    another component are crossing shingles, and a link shares ``percent`` of either set at least: with
    fewer crossing shingles a document is done. Others may lose theirs by that, so again while a tenth goes.
    """
    docs = rows.select("doc", "component").distinct()
    shingles = saved(exploded(texts.join(docs, "doc")), "shingles")
    left = saved(docs, "open")
    while True:
        own = shingles.join(left.select("doc"), "doc", "left_semi")
        crossing = saved(own.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h"), "crossing")
        counts = own.join(crossing, "h").groupBy("doc", "t", "n").agg(F.count("*").alias("k"))
        still = saved(counts.where(100 * F.col("k") >= percent * F.col("n")).select("doc").distinct(), "open")
        before, after = left.count(), still.count()
        release(crossing, left)
        left = still
        if not after or after > 0.9 * before:
            release(shingles)
            return undecided(rows.join(left, "doc", "left_semi"))


def exploded(texts: DataFrame) -> DataFrame:
    """(doc, component, t, n, h): a row per shingle; t tells the texts of a doc apart, n is the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch.column(2), lowered=True):
                offset, hashes = shingle_sets(c)
                n = np.diff(offset)
                row = np.repeat(np.arange(len(n)), n)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
                t = (sums[offset[1:]] - sums[offset[:-1]]).view(np.int64)
                place = pa.array(row + c.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(t[row]), pa.array(n[row].astype(np.int64)), pa.array(hashes.view(np.int64))], names=["doc", "component", "t", "n", "h"])

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.select("doc", "component", "text").mapInArrow(run, f"doc {kind}, component {kind}, t long, n long, h long")


def extended(links: DataFrame, labels: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components with more links; both as they are if there are none."""
    more = saved(more, "links")
    if more.isEmpty():
        return links, labels
    links = links.union(more)
    return links, graph.components(links)


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc, n, component) of every row."""
    sets = saved(signatures(docs, key, text), "signatures")
    some = sets.where("n > 0 and doc is not null")
    classes = some.groupBy("f1", "f2").agg(F.min("doc").alias("rep"), F.count("*").alias("k")).where("k > 1")
    classes = saved(classes.drop("k"), "classes")
    named = some.join(classes, ["f1", "f2"], "left").withColumn("rep", F.coalesce("rep", "doc"))
    members = saved(named.select("doc", "n", "rep").union(sets.where("n = 0 or doc is null").select("doc", "n", F.col("doc").alias("rep"))), "members")
    rows = named.where("doc = rep").select("doc", "n", F.explode("keys").alias("key"))
    several = rows.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key")
    met = rows.join(several, "key", "left_semi").groupBy("key", "doc").agg(F.min("n").alias("n"), F.max("n").alias("m"))
    live = saved(met.withColumn("component", F.col("doc")), "buckets")
    ids = live.select("doc").distinct()
    texts = saved(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(ids, "doc", "left_semi"), "texts")
    links = texts.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0)
    labels = links.toDF("node", "component")
    if not live.isEmpty():
        stars, rest = peeled(live, percent)
        stars = saved(stars, "stars")
        # the centre that a document meets most often first: it spares most of the others
        best = stars.groupBy("b").agg(F.max(F.struct("bands", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
        links = saved(confirmed(best, texts, percent), "links")
        labels = graph.components(links)
        for x in "ab":
            stars = stars.join(labels.toDF(x, f"c{x}"), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
        links, labels = extended(links, labels, confirmed(stars.where("ca <> cb").join(best, ["a", "b"], "left_anti"), texts, percent))
        live = saved(undecided(with_components(rest, labels)), "buckets")
    if not live.isEmpty():
        live = saved(closed(live, texts, percent), "buckets")
    if not live.isEmpty():
        links, labels = extended(links, labels, across(live, texts, percent))
    # rows that repeat a doc_id may be in several classes
    twice = members.where("doc is not null").groupBy("doc").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc")
    again = members.join(twice, "doc", "left_semi").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    _, reached = extended(links, labels, again)
    out = members.join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc", "n", F.coalesce("component", "rep").alias("component"))


def across(live: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between components, among the documents of buckets that are still undecided.

    Documents that such buckets connect are a cluster. A cluster is dealt by hash into blocks of about
    ``BLOCK`` documents (fewer if their sets are large), and each pair of blocks is a group of its own.
    A group counts the common shingles of its documents and gives the links that join its components
    first: a forest, so fewer links than documents.
    """
    least = live.groupBy("key").agg(F.min("doc").alias("least"))
    clusters = graph.components(live.join(least, "key").select("least", "doc").distinct(), "least", "doc").toDF("doc", "cluster")
    open_docs = saved(live.groupBy("doc").agg(F.max("m").alias("n"), F.min("component").alias("component")).join(clusters, "doc"), "open")
    sizes = open_docs.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("sets")).where("docs > 1")
    blocks = F.ceil(F.greatest(F.col("docs") / BLOCK, F.col("sets") / BLOCK_SETS)).cast("int")
    own = open_docs.join(sizes.select("cluster", blocks.alias("blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    own = own.join(texts, "doc")
    dealt = own.select("cluster", "doc", "component", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc", "component", "text")

    def run(group: pa.Table) -> pa.Table:
        a, b = block_links(group, percent)
        return pa.table({"a": a, "b": b})

    kind = live.schema["doc"].dataType.simpleString()
    return dealt.groupBy("cluster", "lo", "hi").applyInArrow(run, f"a {kind}, b {kind}")


def block_links(group: pa.Table, percent: int) -> tuple[pa.Array, pa.Array]:
    """Links that join the components of a group's documents, as few as can be."""
    of, rows = sets_of(group.column("text").combine_chunks())
    sets = [of[i] for i in rows]
    n = np.array([len(x) for x in sets], np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1
    column = np.cumsum(shared) - 1
    keep = shared[token]
    doc, token = doc[keep], column[token[keep]]
    order = np.argsort(token, kind="stable")
    doc, token = doc[order], token[order]
    both = np.zeros((len(n), len(n)), np.float32)
    for first in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(token, [first, first + 4096])
        part = np.zeros((len(n), 4096), np.float32)
        part[doc[lo:hi], token[lo:hi] - first] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0)
    _, component = np.unique(group.column("component").to_numpy(zero_copy_only=False), return_inverse=True)
    a, b = [], []
    for i in range(len(n)):
        there = np.flatnonzero(linked[i] & (component != component[i]))
        for c, j in zip(*np.unique(component[there], return_index=True), strict=True):
            a.append(i)
            b.append(int(there[j]))
            component[component == c] = component[i]
    ids = group.column("doc").combine_chunks()
    return ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))


def op10(docs: DataFrame) -> DataFrame:
    out = components_of(docs)
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


def stage(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id.

    Rows without a doc_id all stay; so do all rows that repeat the doc_id that stays.
    """
    gone = components_of(docs).where("doc <> component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
