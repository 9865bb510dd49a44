"""Keys of JSON at any depth, and a hash that doesn't depend on their order, by Spark's VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of JSON that one pass opens.
LEVELS = 6


def _inner(level: DataFrame) -> DataFrame:
    """What values marked open contain, marked so; others stay. An open value alone has no row left."""
    return level.sparkSession.sql(
        """SELECT own AS key, CASE WHEN e.pos IS NULL THEN above WHEN e.key IS NULL THEN above || '[' || e.pos || ']' ELSE above || '.' || e.key END AS path,
         CASE WHEN e.pos IS NULL THEN called ELSE e.key END AS name, CASE WHEN e.pos IS NULL THEN outside ELSE e.value END AS v, e.pos IS NOT NULL AS open
         FROM {view} w, LATERAL variant_explode_outer(CASE WHEN w.open THEN w.outside END) e WHERE NOT w.open OR e.pos IS NOT NULL""",
        view=level.select(F.col("key").alias("own"), F.col("path").alias("above"), F.col("name").alias("called"), F.col("v").alias("outside"), "open"),
    )


def paths(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, name, kind, value): every value of a JSON text, objects and arrays too.

    path: $.name and [place] from the root; kind: object, array or the scalar's type; value: JSON of a
    scalar, null of the others. ``LEVELS`` levels are opened in one pass over the texts; one more pass
    tells if there are deeper ones, which are opened likewise. Texts that are no JSON, null ones and rows
    without a key have no paths.
    """
    level = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.expr(f"try_parse_json(`{text}`)").alias("v"), F.lit(True).alias("open"))
    levels = []
    while True:
        for _ in range(LEVELS):
            # a value stays, and is opened beside that
            level = _inner(level.withColumn("open", F.explode(F.when(F.col("open"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))))
        levels.append(level.where("v IS NOT NULL"))
        level = _inner(level.where("open"))
        if not level.agg(F.count("*")).first()[0]:
            break
    kind = F.expr("regexp_extract(schema_of_variant(v), '^([A-Za-z]+)', 1)")
    found = reduce(DataFrame.unionByName, levels).withColumn("kind", kind)
    return found.select("key", "path", "name", F.lower("kind").alias("kind"), F.when(~F.col("kind").isin("OBJECT", "ARRAY"), F.to_json("v")).alias("value"))


def hashes(found: DataFrame) -> DataFrame:
    """(key, n_values, hash): SHA-256 of the scalars and empty containers by path, whatever the order of keys. found: from ``paths``."""
    inner = F.col("kind").isin("object", "array")
    lines = F.sort_array(F.collect_list(F.when(~inner, F.concat("path", F.lit("="), "value"))))
    shapes = F.sort_array(F.collect_list(F.when(inner, F.concat("path", F.lit(":"), "kind"))))
    return found.groupBy("key").agg(F.count_if(~inner).alias("n_values"), F.sha2(F.array_join(F.concat(shapes, lines), "\n"), 256).alias("hash"))


def with_names(found: DataFrame, names: list[str]) -> DataFrame:
    """(key, path) of values under one of these names, at any depth."""
    return found.where(F.lower("name").isin(*(n.lower() for n in names))).select("key", "path")
