"""The session's shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch, beyond one row: batches of long texts then take bounded memory outside the heap.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, or fewer where the session says so."""
    own = spark.conf.get(_BATCH).lower().removesuffix("b")
    if not own.isdigit() or int(own) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or what was given to ``setCheckpointDir``."""
    bounded(spark)
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    # one machine only: driver and executors share the folder
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what follows survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove saved tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows with the largest n, as many as fit in `limit` without parting equal bins of n.

    The least n comes from a histogram of its logarithm (a few thousand rows at most), so nothing is
    sorted in one task. Small n have a bin each.
    """
    level = F.floor(F.log2(F.col(n)) * 64)
    room, least = limit, None
    for r in sorted(counts.groupBy(level.alias("b")).count().collect(), key=lambda r: -r["b"]):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["b"]
    return counts.where(level >= least) if least is not None else counts.limit(0)


def aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns of these names put aside under others, and how to name them back."""
    taken = [*docs.columns, *names]
    new = {c: f"_aside{'_' * max(map(len, taken))}{k}" for k, c in enumerate(docs.columns) if c in names}
    return docs.withColumnsRenamed(new), {v: k for k, v in new.items()}
