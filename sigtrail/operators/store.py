"""Append-only logs, latest views, and swaps of derived tables, in place of updates in place."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sigtrail-"))
    return _own[0]


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of texts that go to a Python worker at once: with the default of 10,000, a worker's memory grows with the texts.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS, if it is larger. It is read when a query runs, so it stays lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def latest(log: DataFrame, keys: list[str], order: list[Column], keep_old: list[str] | None = None) -> DataFrame:
    """The last row of each key; columns in keep_old fall back to the last value that wasn't null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    to_last = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in keep_old or []:
        log = log.withColumn(c, F.last(c, ignorenulls=True).over(to_last))
    newest = Window.partitionBy(*keys).orderBy(*(_flipped(o) for o in order))
    return log.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def _flipped(c: Column) -> Column:
    return c.desc()


def nth_newest(log: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key, with their rank."""
    return log.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def merge_links(links: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row for each key: the newest value that isn't null."""
    return links.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value), F.max(order).alias(order))


def report_identity(reports: DataFrame, content: str, title: str, created: str, report: str) -> DataFrame:
    """reports with canon: the oldest report with the same content hash, else with the same normalised title, else itself."""
    oldest = lambda key, name: reports.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(report, F.struct(created, report)).alias(name))
    exact, logical = oldest(content, "_exact"), oldest(title, "_logical")
    out = reports.join(exact, content, "left").join(logical, title, "left")
    return out.withColumn("canon", F.when(F.col("_exact") != F.col(report), F.col("_exact")).otherwise(F.coalesce("_logical", "_exact", report))).drop("_exact", "_logical")


def append_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys aren't there yet."""
    return rows.dropDuplicates(keys).join(existing, keys, "left_anti")


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows and digest of a table: two sums over the rows' hashes, the same in any order and any partitioning."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys))
    part = lambda at: F.conv(F.substring(F.sha2(text, 256), at, 12), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part(1)).alias("a"), F.sum(part(13)).alias("b"))
    return sums.select("n_rows", F.sha2(F.concat_ws(":", "n_rows", F.coalesce("a", F.lit(0).cast("decimal(38,0)")), F.coalesce("b", F.lit(0).cast("decimal(38,0)"))), 256).alias("digest"))


class StaleInput(RuntimeError):
    """The input changed while a derived table was made."""


def swap(df: DataFrame, folder: str, name: str, expected: str, now) -> str:
    """Write df as a new version of name; it becomes current only if the input's fingerprint is still the expected one.

    The pointer is one small JSON file written through Spark, so that the folder may be on any store.
    """
    spark = df.sparkSession
    version = f"{folder}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(version)
    if now() != expected:
        raise StaleInput(name)
    spark.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}/_current")
    return version


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    pointer = json.loads(spark.read.text(f"{folder}/{name}/_current").first()[0])
    return spark.read.parquet(pointer["version"])
