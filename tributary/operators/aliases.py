"""The best name of a concept for a label: a similarity join of labels with the names of concepts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.labels import normalize_label, tokens

#: Names that say nothing of a concept.
GENERIC = ("total", "subtotal", "other", "others", "amount", "balance", "net")
#: Different labels that are sent to the names at once.
LABELS_AT_ONCE = 20_000


def names_of(concepts: DataFrame) -> DataFrame:
    """(concept, name, source, place): labels, then aliases, normalised, in order, without generic ones.

    concepts: concept, labels, aliases (arrays).
    """
    none = F.array().cast("array<string>")
    listed = lambda c, source: F.transform(F.coalesce(c, none), lambda x: F.named_struct(F.lit("name"), normalize_label(x), F.lit("source"), F.lit(source)))
    rows = concepts.where("concept IS NOT NULL").select("concept", F.posexplode(F.concat(listed(F.col("labels"), "label"), listed(F.col("aliases"), "alias"))).alias("place", "x"))
    return rows.select("concept", "place", "x.name", "x.source").where(~F.col("name").isin("", *GENERIC))


def best_names(labels: DataFrame, concepts: DataFrame, least: float) -> DataFrame:
    """(label_id, concept, name, source, reason, ratio): for every label and concept with a name alike from `least` on, the best.

    labels: label_id, label. Likeness is the share of words in common, 1 for equal texts. A label of n words
    is met by its n - ceil(least * n) + 1 rarest words, and only by names whose length leaves enough to
    share from that word on; every pair is decided on its whole sets where it meets. Labels are the smaller
    side: of them LABELS_AT_ONCE are broadcast at a time, whatever their number, and names go past them and are
    not moved, only what is alike is. Of names as good the first of the concept stands. Generic names match
    nothing; labels without words have no row.
    """
    mine = labels.where("label_id IS NOT NULL").select("label_id", normalize_label(F.col("label")).alias("name")).where("name <> ''")
    times = -(-mine.select("name").distinct().count() // LABELS_AT_ONCE) or 1
    theirs = names_of(concepts).select("concept", "place", "source", F.col("name").alias("other")).withColumn("theirs", tokens(F.col("other"))).withColumn("m", F.size("theirs"))
    spread = theirs.select("*", F.explode("theirs").alias("w"))
    at = F.pmod(F.xxhash64("name"), F.lit(times))
    rows = reduce(DataFrame.unionByName, (_alike(mine.where(at == i) if times > 1 else mine, spread, least) for i in range(times)))
    best = Window.partitionBy("label_id", "concept").orderBy(F.desc("ratio"), "place")
    reason = F.when(F.col("name") == F.col("other"), F.concat(F.lit("exact_"), "source", F.lit("_match"))).otherwise("shared_words")
    out = rows.withColumn("_place", F.row_number().over(best)).where("_place = 1")
    return out.select("label_id", "concept", F.col("other").alias("name"), "source", reason.alias("reason"), F.round("ratio", 6).alias("ratio"))


def _alike(mine: DataFrame, spread: DataFrame, least: float) -> DataFrame:
    """Labels, few enough to be broadcast, beside the names that are alike. spread: names, once for each of their words."""
    sets = mine.select("name").distinct().withColumn("words", tokens(F.col("name"))).where(F.size("words") > 0).withColumn("n", F.size("words"))
    mine_words = sets.select("*", F.explode("words").alias("w"))
    seen = spread.select("w").join(F.broadcast(mine_words.select("w").distinct()), "w").groupBy("w").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("name").orderBy(F.coalesce("df", F.lit(0)), "w")
    take = F.col("n") - F.ceil(F.col("n") * F.lit(least).cast("decimal(9,6)")) + 1
    prefix = mine_words.join(F.broadcast(seen), "w", "left").withColumn("at", F.row_number().over(rarest)).where((F.col("at") <= take) & F.col("df").isNotNull()).select("name", "words", "n", "at", "w")
    # what two sets of n and m words share is least / (1 + least) of both at least, and no word of the label before `at` is in it
    near: Column = (F.col("m") >= F.lit(least) * F.col("n")) & (F.col("n") >= F.lit(least) * F.col("m")) & (F.col("n") - F.col("at") + 1 >= F.lit(least / (1 + least) - 1e-9) * (F.col("n") + F.col("m")))
    both = F.size(F.array_intersect("words", "theirs"))
    ratio = F.when(F.col("name") == F.col("other"), 1.0).otherwise(both / (F.col("n") + F.col("m") - both))
    alike = spread.join(F.broadcast(prefix), "w").where(near).select("name", "concept", "other", "source", "place", ratio.alias("ratio")).where(F.col("ratio") >= least)
    return alike.join(F.broadcast(mine), "name")


def canonical_names(labels: DataFrame, known: DataFrame, longest: int = 8) -> DataFrame:
    """(label_id, name, canonical): what an alias stands for: the whole label's, else of its longest alias, else the label.

    labels: label_id, label. known: alias, canonical. An alias inside a label is one of its runs of up to
    `longest` words, so both meet by equality, however long the table of aliases; of runs as long the first
    stands, of two canonical names of one alias the smaller. An alias of more words than that matches whole
    labels only.
    """
    table = known.select(normalize_label(F.col("alias")).alias("run"), "canonical").where("run <> ''").groupBy("run").agg(F.min("canonical").alias("canonical"))
    mine = labels.select("label_id", normalize_label(F.col("label")).alias("name"))
    ws = F.split("name", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size(ws), F.lit(longest))), lambda n: F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.named_struct(F.lit("run"), F.array_join(F.slice(ws, i, n), " "), F.lit("at"), i, F.lit("n"), n))))
    whole = F.array(F.named_struct(F.lit("run"), F.col("name"), F.lit("at"), F.lit(1), F.lit("n"), F.size(ws)))
    spread = mine.select("name").distinct().where("name <> ''").select("name", F.explode(F.array_distinct(F.concat(runs, whole))).alias("r")).select("name", "r.*")
    found = spread.join(table, "run").groupBy("name").agg(F.max_by("canonical", F.struct("n", -F.col("at"))).alias("canonical"))
    return mine.join(found, "name", "left").select("label_id", "name", F.coalesce("canonical", "name").alias("canonical"))


def synonym_overlap(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """pairs (with left, right) and ``overlap``: half a point for each group of synonyms that both sides name, at most 1.

    groups: group, phrase; a phrase of one or more words names its group where it stands in a label.
    """
    sides = pairs.select(F.col("left").alias("label")).union(pairs.select(F.col("right").alias("label"))).where("label IS NOT NULL").distinct()
    phrases = groups.select("group", normalize_label(F.col("phrase")).alias("run")).where("run <> ''")
    ws = F.split(normalize_label(F.col("label")), " ")
    longest = 6
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size(ws), F.lit(longest))), lambda n: F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))))
    named = sides.select("label", F.explode(F.array_distinct(runs)).alias("run")).join(phrases, "run").groupBy("label").agg(F.collect_set("group").alias("named"))
    a, b = named.select(F.col("label").alias("left"), F.col("named").alias("_a")), named.select(F.col("label").alias("right"), F.col("named").alias("_b"))
    n = F.coalesce(F.size(F.array_intersect("_a", "_b")), F.lit(0))
    met = pairs.join(a, "left", "left").join(b, "right", "left")
    return met.withColumn("overlap", F.least(F.lit(1.0), F.when(F.col("_a").isNull() | F.col("_b").isNull(), 0).otherwise(n) / 2)).select(*pairs.columns, "overlap")
