"""Exact vector search in double precision: with a bounded set of queries, or of every vector among all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators.ranking import top_k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def scaled_cosine(a: Column, b: Column) -> Column:
    """(cos + 1) / 2, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) + 1) / 2))


def truncated(a: Column, size: int) -> Column:
    """The first `size` parts, at length 1."""
    own = F.slice(a, 1, size)
    return F.when(norm(own) > 0, F.transform(own, lambda x: x.cast("double") / norm(own))).otherwise(F.transform(own, lambda x: x.cast("double")))


#: Rows of a block of queries and of items: the likenesses of a block are 32 MB.
QUERIES_A_BLOCK, ITEMS_A_BLOCK = 1024, 4096
#: What is nearer to the last kept likeness than this is kept too: the exact ones are rounded to 6 digits.
SLACK = 2e-6


def _rows_of(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length 1 (0 without a length), and which are whole: of `size` parts, none null."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat, ends = vectors.flatten(), np.cumsum(np.maximum(lengths, 0))
    gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = (lengths == size) & (gaps[ends] == gaps[ends - np.maximum(lengths, 0)])
    out = np.zeros((len(vectors), size))
    if whole.any():
        out[whole] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)[np.repeat(whole, np.maximum(lengths, 0))].reshape(-1, size)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length != 0), whole


def _likely(batches: Iterator[pa.RecordBatch], asked: pa.Table, vector: str, same: str | None, k: int) -> Iterator[pa.RecordBatch]:
    """Queries and items beside each other: each query's k + 1 best of the blocks so far, and what is as good within SLACK."""
    asked = asked.combine_chunks().to_batches()[0]
    size = max(asked["_q"].value_lengths().fill_null(0).to_pylist())
    queries, known = _rows_of(asked["_q"], size)
    marks = asked["query_label"].to_numpy(zero_copy_only=False) if same else None
    floor = np.full(len(queries), -2.0)
    for batch in batches:
        for start in range(0, batch.num_rows, ITEMS_A_BLOCK):
            block = batch.slice(start, ITEMS_A_BLOCK)
            items, whole = _rows_of(block[vector], size)
            for first in range(0, len(queries), QUERIES_A_BLOCK):
                part = slice(first, first + QUERIES_A_BLOCK)
                # a likeness that is no number stands first, one that is not known last, as in an order by it
                alike = np.nan_to_num(queries[part] @ items.T, nan=4.0)
                alike[~known[part]], alike[:, ~whole] = -2.0, -2.0
                if same:
                    alike[marks[part][:, None] != block[same].to_numpy(zero_copy_only=False)[None, :]] = -3.0
                many = np.flatnonzero((alike >= floor[part][:, None]).sum(axis=1) > k + 1)
                if len(many):
                    floor[first + many] = np.maximum(floor[first + many], np.maximum(np.partition(alike[many], -(k + 1), axis=1)[:, -(k + 1)] - SLACK, -2.0))
                places, rows = np.nonzero(alike >= floor[part][:, None])
                if len(rows):
                    yield pa.RecordBatch.from_arrays([*asked.take(pa.array(places + first)).columns, *block.take(pa.array(rows)).columns], [*asked.schema.names, *block.schema.names])


def nearest_vectors(queries: DataFrame, items: DataFrame, k: int, query_id: str, item_id: str, vector: str, same: str | None = None) -> DataFrame:
    """For each query the k items of largest cosine (ties to the smaller id). The queries are the stated,
    bounded side: a few rows that meet every item; the others are never paired with each other.

    Tasks multiply blocks of items with the queries and keep what may be among the k best; only those pairs
    are scored. Of items with the same vector the k + 1 smallest ids stand for all. same: the label, which
    must be equal then. Vectors of another size than the longest query's have no likeness.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("_q"), *(["label"] if "label" in queries.columns else [])).withColumnRenamed("label", "query_label")
    copies = Window.partitionBy(vector, *([same] if same else [])).orderBy(item_id)
    own = items.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy")
    asked = q.toArrow()
    if asked.num_rows == 0:
        pairs = q.join(items.limit(0))
    else:
        held = items.sparkSession.sparkContext.broadcast(asked)
        pairs = own.mapInArrow(lambda batches: _likely(batches, held.value, vector, same, k), T.StructType([*q.schema, *own.schema]))
    scored = pairs.where(F.col("query_id") != F.col(item_id)).withColumn("score", F.round(cosine(F.col("_q"), F.col(vector)), 6))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc(item_id)], k).drop("_q", vector)


#: Vectors of a block when every one is a query: 32 MB of double precision at 64 parts.
VECTORS_A_BLOCK = 65_536
#: How many tasks the blocks should make for each core.
TASKS_A_CORE = 3


def _best_of_blocks(asked: pa.Table, items: pa.Table, vector: str, item_id: str, k: int, size: int) -> pa.Table:
    """For each query of a block its k best items of another block, and what is as good within SLACK, with their likeness."""
    items = items.sort_by(item_id)
    queries, known = _rows_of(asked["_q"].combine_chunks(), size)
    rows, whole = _rows_of(items[vector].combine_chunks(), size)
    # what has no likeness comes last, by its number: the k smallest stand for all
    held = np.concatenate([np.flatnonzero(whole), np.flatnonzero(~whole)[:k]])
    first = np.arange(min(k, len(rows)))
    places, others, scores, blank = [], [], [], []
    for start in range(0, len(queries), QUERIES_A_BLOCK):
        part = np.arange(start, min(start + QUERIES_A_BLOCK, len(queries)))
        blind = part[~known[part]]
        places.append(np.repeat(blind, len(first)))
        others.append(np.tile(first, len(blind)))
        blank.append(np.ones(len(blind) * len(first), dtype=bool))
        scores.append(np.zeros(len(blind) * len(first)))
        part = part[known[part]]
        floor, found = np.full(len(part), -2.0), []
        for at in range(0, len(held) if len(part) else 0, ITEMS_A_BLOCK):
            few = held[at : at + ITEMS_A_BLOCK]
            likeness = queries[part] @ rows[few].T
            alike = np.nan_to_num(likeness, nan=4.0)
            alike[:, ~whole[few]] = -2.0
            many = np.flatnonzero((alike >= floor[:, None]).sum(axis=1) > k)
            if len(many):
                floor[many] = np.maximum(floor[many], np.maximum(np.partition(alike[many], -k, axis=1)[:, -k] - SLACK, -2.0))
            a, b = np.nonzero(alike >= floor[:, None])
            found.append((a, few[b], alike[a, b], likeness[a, b]))
        for a, b, alike, likeness in found:
            kept = alike >= floor[a]
            places.append(part[a[kept]])
            others.append(b[kept])
            scores.append(likeness[kept])
            blank.append(~whole[b[kept]])
    none = np.zeros(0, dtype=np.int64)
    places, others = (pa.array(np.concatenate([none, *x])) for x in (places, others))
    likeness = pa.array(np.concatenate([[], *scores]), mask=np.concatenate([np.zeros(0, dtype=bool), *blank]))
    columns = [asked["like"].take(places), *(items[c].take(others) for c in items.schema.names if c not in ("_a", "_b", vector)), likeness]
    return pa.Table.from_arrays(columns, ["like", *(c for c in items.schema.names if c not in ("_a", "_b", vector)), "score"])


def nearest_of_each(items: DataFrame, k: int, item_id: str, vector: str) -> DataFrame:
    """Each item with the k others of largest cosine (ties to the smaller id): query_id, its label as query_label, rank, the item, score.

    All pairs of different vectors: they are dealt into blocks, and a task multiplies two blocks and keeps what
    may be among the best of each row, so a task holds two blocks and no task or driver holds all. Items of the same
    vector are one query; of them the k + 1 smallest ids stand for all, and each leaves itself out. A vector
    of another size than the longest, or with a null part, has no likeness and comes last, by its id.
    """
    spark, same = items.sparkSession, Window.partitionBy(vector)
    told = items.where(F.col(item_id).isNotNull()).withColumns({"like": F.min(item_id).over(same), "_copy": F.row_number().over(same.orderBy(item_id))})
    kinds = told.where("_copy = 1").select("like", F.col(vector).alias("_q"))
    n, size = kinds.agg(F.count("*"), F.coalesce(F.max(F.size("_q")), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(-(-n // VECTORS_A_BLOCK), min(int((TASKS_A_CORE * cores) ** 0.5), -(-n // QUERIES_A_BLOCK)), 1)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = kinds.select(block("like").alias("_a"), each.alias("_b"), "like", "_q").repartition(blocks * blocks, "_a", "_b")
    right = told.where(F.col("_copy") <= k + 1).select(each.alias("_a"), block(item_id).alias("_b"), *items.columns).repartition(blocks * blocks, "_a", "_b")
    shown = [c for c in items.columns if c != vector]
    schema = T.StructType([T.StructField("like", items.schema[item_id].dataType), *(items.schema[c] for c in shown), T.StructField("score", T.DoubleType())])
    found = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(lambda a, b: _best_of_blocks(a, b, vector, item_id, k + 1, size), schema)
    best = top_k(found.withColumn("score", F.round("score", 6)), ["like"], [F.desc("score"), F.asc(item_id)], k + 1)
    lists = best.groupBy("like").agg(F.array_sort(F.collect_list(F.struct("rank", *shown, "score"))).alias("best"))
    asked = told.select("like", F.col(item_id).alias("query_id"), *([F.col("label").alias("query_label")] if "label" in items.columns else []))
    others = F.slice(F.filter("best", lambda x: x[item_id] != F.col("query_id")), 1, k)
    met = asked.join(lists, "like").select(*asked.columns[1:], F.posexplode(others).alias("_at", "x"))
    return met.select(*asked.columns[1:], (F.col("_at") + 1).cast("long").alias("rank"), *(f"x.{c}" for c in shown), "x.score")
