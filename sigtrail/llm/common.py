"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D].
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="sigtrail-"))
    return _own_folder[0]


def durable(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of texts that go to a Python worker at once: with long texts, thousands would fill its memory.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS, if it is larger. It is read when a query runs, so it stays lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """df as a table in the shared folder, in buckets by key: later joins on key don't shuffle it again."""
    spark = df.sparkSession
    n, name = partitions(spark), f"{label}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(values: list, budget: int):
    """Runs of values whose lengths together stay within budget; a longer value stands alone."""
    begin = total = 0
    for k, value in enumerate(values):
        if k > begin and total + len(value) > budget:
            yield begin, values[begin:k]
            begin, total = k, 0
        total += len(value)
    if begin < len(values):
        yield begin, values[begin:]
