"""Full-text search over an inverted index: all terms of a query, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))


def index(docs: DataFrame, key: str, text: str, asked: DataFrame | None = None) -> DataFrame:
    """(term, doc, tf, length): the posting lists of a table; tf is how often the term stands in the text.

    asked: term; the lists of other terms are not made then.
    """
    spread = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), terms(F.col(text)).alias("ts")).select("doc", F.size("ts").alias("length"), F.explode("ts").alias("term"))
    if asked is not None:
        spread = spread.join(asked.select("term").distinct(), "term", "left_semi")
    return spread.groupBy("term", "doc").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def search(postings: DataFrame, queries: DataFrame, n_docs: int | Column, k: int) -> DataFrame:
    """(query, doc, score, rank): the k best documents that have every term of a query.

    queries: query, text. A document's score is the sum over the terms of (1 + ln tf) * ln(1 + n_docs / df).
    The posting list of a query's rarest term gives the candidates; the other terms only look those up, so a
    frequent term's list is never joined as a whole to a query that has a rarer one. A query without terms, or
    with one that no document has, finds nothing; ties go to the smaller doc.
    """
    asked = queries.where("query IS NOT NULL").select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    df = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # as wide as the lists below, so they are made once
    known = asked.join(df, "term", "left")
    each = Window.partitionBy("query")
    known = known.withColumns({"n": F.count("*").over(each), "place": F.row_number().over(each.orderBy(F.col("df").asc_nulls_first(), "term")), "missing": F.count_if(F.col("df").isNull()).over(each)}).where("missing = 0")
    part = (1 + F.ln("tf")) * F.ln(1 + F.lit(n_docs) / F.col("df"))
    found = known.where("place = 1").join(postings, "term").select("query", "doc", "n", part.alias("part"))
    rest = found.select("query", "doc").join(known.where("place > 1").select("query", "term", "df"), "query").join(postings, ["term", "doc"]).groupBy("query", "doc").agg(F.count("*").alias("m"), F.sum(part).alias("more"))
    whole = found.join(rest, ["query", "doc"], "left").where(F.col("n") == 1 + F.coalesce("m", F.lit(0)))
    score = F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 6)
    # the limit on the rank reaches each task before the shuffle
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return whole.select("query", "doc", score.alias("score")).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
