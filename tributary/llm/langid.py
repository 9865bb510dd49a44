"""Language ID by Bayesian evidence fusion.

For each text and language the log posterior adds up
* the text: naive Bayes over hashed byte trigrams, trained by grouped aggregation over all labelled
  documents, and tempered to the weight of ``TRIGRAMS`` trigrams, since trigrams aren't independent;
* the language declared in the markup, and the suffix of the address: log P(value | language), from
  counts of the text posteriors over all rows, smoothed;
* the host: a prior smoothed hierarchically, host to site to all rows, by grouped aggregation of the
  text posteriors. A row's own share is taken out of these counts, so no text is counted twice.

Counts come from aggregates that combine before the shuffle; their tables have a row per host, site,
suffix or declared value and are joined back to narrow rows (the texts are read once to train and once
to score). Only the trigram table (languages x ``BUCKETS``) and the list of languages go to the driver.

Defined cases: a null or empty text, url or declaration is no evidence; a row without any evidence gets
the overall prior; no labelled documents: no languages, lang is null and confidence 0; repeated rows are
judged each on its own; ties go to the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import words as W
from tributary.llm.shared import saved

BUCKETS = 1 << 15
TRIGRAMS = 120.0
HOST_WEIGHT = 5.0
SMOOTH = 1.0


def _tables() -> np.ndarray:
    own = np.random.default_rng(W.SEED).integers(0, BUCKETS, (3, 256)).astype(np.uint16)
    own[:, ord("A") : ord("Z") + 1] = own[:, ord("a") : ord("z") + 1]
    return own


def trigrams(column: pa.Array, size: int = W.CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """first row, bounds of each row's trigrams, and their buckets, some megabytes at a time.
    Each text is followed by two spaces, so that every byte begins a trigram."""
    t = _tables()
    offsets, data = W.buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        bounds = offsets[i : j + 1] - offsets[i]
        padded = np.full(int(bounds[-1]) + 2 * (j - i), 32, np.uint8)
        at = np.arange(int(bounds[-1])) + 2 * np.repeat(np.arange(j - i), np.diff(bounds))
        padded[at] = data[offsets[i] : offsets[j]]
        yield i, bounds, (t[0][padded[at]] ^ t[1][padded[at + 1]] ^ t[2][padded[at + 2]]) if len(at) else np.zeros(0, np.uint16)
        i = j


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log P(bucket | language) smoothed; over all labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1).dictionary_encode()
            place, names = codes.indices.to_numpy(), codes.dictionary
            counts = np.zeros((len(names), BUCKETS), np.int64)
            for first, bounds, own in trigrams(batch.column(0)):
                where = np.repeat(place[first : first + len(bounds) - 1], np.diff(bounds))
                counts += np.bincount(where * BUCKETS + own, minlength=counts.size).reshape(counts.shape)
            k, b = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(k)), pa.array(b.astype(np.int32)), pa.array(counts[k, b])], names=["lang", "bucket", "n"])

    rows = labelled.where(F.col(lang).isNotNull()).select(text, F.col(lang)).mapInArrow(run, "lang string, bucket int, n long")
    table = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    place = {x: i for i, x in enumerate(langs)}
    counts[[place[x] for x in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return langs, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)) if langs else counts


def evidence(rows: DataFrame, langs: list[str], log_p: np.ndarray, text: str = "text") -> DataFrame:
    """rows (without the text) with ``ll``, the tempered log likelihood of each language, and
    ``post``, the posterior from the text alone under equal priors; both empty of meaning, zero, without a text."""
    model = rows.sparkSession.sparkContext.broadcast(log_p.astype(np.float32))
    others = [f for f in rows.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            ll = np.zeros((batch.num_rows, len(langs)))
            seen = np.zeros(batch.num_rows, bool)
            for first, bounds, own in trigrams(batch.column(text)):
                n = np.diff(bounds)
                weight = np.minimum(1.0, TRIGRAMS / np.maximum(n, 1))
                seen[first : first + len(n)] = n > 0
                for k in range(len(langs)):
                    sums = np.concatenate([[0.0], np.cumsum(p[k][own], dtype=np.float64)])
                    ll[first : first + len(n), k] = (sums[bounds[1:]] - sums[bounds[:-1]]) * weight
            post = np.exp(ll - ll.max(axis=1, keepdims=True)) if langs else ll
            post = post / post.sum(axis=1, keepdims=True) * seen[:, None] if langs else post
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(langs))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (ll, post)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), *lists], names=[*(f.name for f in others), "ll", "post"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "ll array<double>, post array<double>"])
    return rows.select(*(f.name for f in others), text).mapInArrow(run, kinds)


def counted(rows: DataFrame, by: str, size: int) -> DataFrame:
    """(by, n_by array): the text posteriors summed for each value."""
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*(F.sum(F.col("post")[i]) for i in range(size))).alias(f"n_{by}"))


def fused(rows: DataFrame, langs: list[str]) -> DataFrame:
    """rows of `evidence` with host, site, suffix and declared, judged: lang, confidence and text_lang."""
    size = len(langs)
    if not size:
        return rows.select("*", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    every = rows.agg(*(F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)) for i in range(size))).first()
    total = np.array(list(every), float)
    prior = (total + SMOOTH) / (total.sum() + SMOOTH * size)
    values = {by: counted(rows, by, size) for by in ("declared", "suffix")}
    kinds = {by: df.count() for by, df in values.items()}
    for df in (*values.values(), counted(rows, "site", size), counted(rows, "host", size)):
        rows = rows.join(saved(df, "counts"), df.columns[0], "left")

    def less(by: str, i: int) -> Column:
        """What the other rows with this value say."""
        return F.coalesce(F.greatest(F.col(f"n_{by}")[i] - F.col("post")[i], F.lit(0.0)), F.lit(0.0))

    def share(by: str, i: int, above: Column) -> Column:
        all_ = reduce(lambda a, b: a + b, (less(by, j) for j in range(size)))
        return (less(by, i) + HOST_WEIGHT * above) / (all_ + HOST_WEIGHT)

    def likelihood(by: str, i: int) -> Column:
        p = (less(by, i) + SMOOTH) / F.lit(float(total[i]) + SMOOTH * (kinds[by] + 1))
        return F.when(F.col(by).isNull(), F.lit(0.0)).otherwise(F.log(p))

    logs = []
    for i in range(size):
        host = share("host", i, share("site", i, F.lit(float(prior[i]))))
        logs.append(F.col("ll")[i] + likelihood("declared", i) + likelihood("suffix", i) + F.log(host))
    rows = rows.withColumn("_logs", F.array(*logs))
    best = F.array_max("_logs")
    names = F.array(*map(F.lit, langs))
    return rows.select(
        *(c for c in rows.columns if c not in ("_logs", "n_host", "n_site", "n_suffix", "n_declared")),
        F.element_at(names, F.array_position("_logs", best).cast("int")).alias("lang"),
        (1 / F.aggregate("_logs", F.lit(0.0), lambda s, x: s + F.exp(x - best))).alias("confidence"),
        F.when(F.array_max("post") > 0, F.element_at(names, F.array_position("post", F.array_max("post")).cast("int"))).alias("text_lang"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, host, site, suffix and declared of each page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.nullif(host, F.lit(""))
    parts = F.split(host, r"\.")
    site = F.concat_ws(".", F.slice(parts, -F.least(F.size(parts), F.lit(2)), 2))
    declared = F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]+)""", 1))
    return pages.select(
        F.col("page_id"), text.alias("text"), host.alias("host"), F.when(host.isNotNull(), site).alias("site"),
        F.when(host.isNotNull(), F.element_at(parts, -1)).alias("suffix"), F.nullif(declared, F.lit("")).alias("declared"),
    )


def identify(spark: SparkSession, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Both tables judged by one model: documents (their source is their host) and pages."""
    langs, log_p = train(documents)
    null = F.lit(None)
    docs = documents.select(F.col("doc_id"), null.cast("long").alias("page_id"), "text", F.concat(F.lit("source "), F.col("source")).alias("host"), null.cast("string").alias("site"), null.cast("string").alias("suffix"), null.cast("string").alias("declared"))
    web = page_evidence(pages).select(null.cast("long").alias("doc_id"), "page_id", "text", "host", "site", "suffix", "declared")
    rows = saved(evidence(docs.union(web), langs, log_p), "evidence")
    return fused(rows, langs).select("doc_id", "page_id", "declared", "suffix", "host", "text_lang", "lang", "confidence")


def op1(spark: SparkSession, documents: DataFrame, pages: DataFrame) -> DataFrame:
    return identify(spark, documents.select("doc_id", "text", "lang", "source"), pages.select("page_id", "url", "html"))
