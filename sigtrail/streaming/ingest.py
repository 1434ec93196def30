"""Incremental ingest with Structured Streaming: landed rows become an append-only log; views read the latest.

An extension in form (the reference ingests a file per request), not in meaning: the same keep-old and late-binding rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.operators import reclustering, rules
from sigtrail.operators import similarity as M
from sigtrail.operators.store import latest


def ingest(spark: SparkSession, landing: str, log: str, checkpoint: str, schema: str = "artifact string, family string, text string, arrived long") -> None:
    """Scan what has landed since the last run and append it to the log; a batch that is run again leaves no second copy.

    Each batch writes its own folder, so that a retry overwrites just what the failed attempt left.
    """
    source = spark.readStream.schema(schema).parquet(landing)

    def batch(rows: DataFrame, number: int) -> None:
        facts = rules.scan_rules(rows).groupBy("artifact").agg(F.count(F.lit(1)).alias("n_evidence"), F.min("value").alias("first_value"))
        out = rows.select("artifact", "family", "arrived").join(facts, "artifact", "left").withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{log}/batch={number}")

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def follow_clusters(spark: SparkSession, landing: str, folder: str, checkpoint: str, schema: str = "artifact string, kind string, value string") -> None:
    """Take in landed evidence since the last run, all of an artifact's in one batch, and cluster again what it touches.

    An artifact whose evidence holds no fact is in no cluster. reclustering.current_clusters gives the clusters.
    """
    source = spark.readStream.schema(schema).parquet(landing)

    def batch(rows: DataFrame, number: int) -> None:
        facts = rows.select("artifact").distinct().join(M.tool_facts(rows), "artifact", "left")
        reclustering.add_batch(facts, folder, number)

    source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def samples(spark: SparkSession, log: str) -> DataFrame:
    """The latest row of each artifact; a family that a later row lacks stays."""
    return latest(spark.read.parquet(log), ["artifact"], [F.col("arrived"), F.col("batch")], ["family"])


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window, with a watermark: an extension, for streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
