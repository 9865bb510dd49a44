"""Tables and files: explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The extraction candidate, the main row of the engine.
CANDIDATE = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("case_id", "source_pdf")),
    T.StructField("page_number", T.IntegerType()),
    *(T.StructField(c, T.StringType()) for c in ("extraction_method", "row_type", "statement_section", "label", "value", "previous_value", "text")),
    *(T.StructField(c, T.IntegerType()) for c in ("current_year", "prior_year")),
    T.StructField("source_snippet", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("provenance", T.MapType(T.StringType(), T.StringType())),
])

REPORT = T.StructType([
    T.StructField("run_metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("case_reports", T.ArrayType(T.StructType([
        *(T.StructField(c, T.StringType()) for c in ("case_id", "source_pdf", "status")),
        T.StructField("pages_analyzed", T.IntegerType()),
        T.StructField("candidate_count", T.IntegerType()),
        T.StructField("candidates", T.ArrayType(CANDIDATE)),
    ]))),
    T.StructField("_corrupt_record", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """JSON reports, a file each; broken ones keep their text in _corrupt_record."""
    return spark.read.schema(REPORT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def flatten_candidates(reports: DataFrame) -> DataFrame:
    """A row per candidate, with its case, place and stable id."""
    cases = reports.select(F.posexplode("case_reports").alias("case_index", "case"))
    rows = cases.select("case_index", "case.case_id", F.posexplode("case.candidates").alias("candidate_index", "c"))
    rows = rows.select("case_index", "candidate_index", F.coalesce("c.case_id", "case_id").alias("case_id"), *(f"c.{f.name}" for f in CANDIDATE if f.name != "case_id"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    year = lambda c: F.when(F.col(c).between(1900, 2100), F.col(c))
    return rows.withColumns({
        "confidence": conf,
        "current_year": year("current_year"),
        "prior_year": year("prior_year"),
        "source_snippet": F.substring("source_snippet", 1, 1000),
        "candidate_id": F.concat_ws(":", "case_id", F.lit("candidate"), "case_index", "candidate_index"),
    })


def observations(candidates: DataFrame) -> DataFrame:
    """Current and prior values as rows of their own; the prior year is the current less one if unknown."""
    prior = F.coalesce("prior_year", F.col("current_year") - 1)
    both = F.array(
        F.struct(F.lit("current").alias("value_role"), F.col("value").alias("v"), F.col("current_year").alias("y")),
        F.struct(F.lit("prior").alias("value_role"), F.col("previous_value").alias("v"), prior.alias("y")),
    )
    numeric = F.col("row_type").isin("numeric_fact", "comparative_numeric_fact", "subtotal_or_total")
    rows = candidates.where(numeric).select("*", F.inline(both)).drop("value", "previous_value")
    return rows.withColumnsRenamed({"v": "pdf_value", "y": "expected_year"}).where(F.trim(F.coalesce("pdf_value", F.lit(""))) != "")


def code_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV of filename and new_code; codes of six digits are valid."""
    df = spark.read.schema("filename string, new_code string").option("header", True).csv(path)
    return df.withColumn("valid", F.coalesce(F.col("new_code").rlike(r"^\d{6}$"), F.lit(False)))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
