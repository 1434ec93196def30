"""Document blocks: lines, sections, duplicates, clusters of hits, and blocks given to their nearest event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lines(text: str) -> Column:
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_blocks(docs: DataFrame, key: str = "artifact", text: str = "text") -> DataFrame:
    """key, index, text, text_sha256: one block for each line that isn't blank, numbered from 0."""
    rows = docs.select(key, F.posexplode(_lines(text)).alias("index", "text"))
    return rows.withColumn("text_sha256", F.sha2("text", 256))


def sectioned_lines(docs: DataFrame, heading: Callable[[Column], Column], key: str = "artifact", text: str = "text") -> DataFrame:
    """key, index, text, section: `line_blocks` with the last heading at or before each, found within a document's row: nothing is shuffled."""
    rows = docs.select(key, _lines(text).alias("_l"))
    opens = F.filter(F.transform("_l", lambda x, k: F.when((k == 0) | heading(x), k)), lambda k: k.isNotNull())
    part = lambda b, k: F.struct(b.alias("_b"), F.when(heading(F.get("_l", b)), F.get("_l", b)).alias("section"), F.slice("_l", b + 1, F.coalesce(F.get("_o", k + 1), F.size("_l")) - b).alias("_p"))
    parts = rows.withColumn("_o", opens).select(key, F.inline(F.transform("_o", part)))
    return parts.select(key, "_b", "section", F.posexplode("_p").alias("_n", "text")).select(key, (F.col("_b") + F.col("_n")).alias("index"), "text", "section")


def with_sections(blocks: DataFrame, key: str, heading) -> DataFrame:
    """blocks with the last heading at or before each."""
    upto = Window.partitionBy(key).orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("section", F.last(F.when(heading, F.col("text")), ignorenulls=True).over(upto))


def without_adjacent_repeats(blocks: DataFrame, key: str) -> DataFrame:
    """blocks whose text differs from that of the block before."""
    before = F.lag("text").over(Window.partitionBy(key).orderBy("index"))
    return blocks.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("text"))).drop("_b")


def hit_clusters(hits: DataFrame, key: str, gap: int = 3) -> DataFrame:
    """key, cluster, first, last, n: hits at most gap apart are one cluster."""
    w = Window.partitionBy(key).orderBy("index")
    new = F.coalesce((F.col("index") - F.lag("index").over(w) > gap).cast("int"), F.lit(0))
    marked = hits.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w))
    return marked.groupBy(key, "cluster").agg(F.min("index").alias("first"), F.max("index").alias("last"), F.count(F.lit(1)).alias("n"))


def cluster_context(clusters: DataFrame, blocks: DataFrame, key: str, left: int = 1, right: int = 3, alone: int = 1) -> DataFrame:
    """The blocks around clusters: left and right of a cluster of several hits, alone on either side of a single one."""
    reach = clusters.select(key, F.explode(F.sequence(F.col("first") - left, F.col("last") + F.when(F.col("n") > 1, right).otherwise(alone))).alias("index")).distinct()
    return blocks.join(reach, [key, "index"], "left_semi")


def nearest_anchor(blocks: DataFrame, anchors: DataFrame, key: str, limit: int = 15) -> DataFrame:
    """key, index, event, distance: blocks given to the event with the nearest anchor, if it is the only nearest one in reach.

    anchors: key, event, index. An anchor reaches limit blocks to either side, so the join is on (key, index).
    """
    reach = anchors.select(key, "event", F.col("index").alias("at"), F.explode(F.sequence(F.col("index") - limit, F.col("index") + limit)).alias("index"))
    distances = blocks.select(key, "index").join(reach, [key, "index"]).groupBy(key, "index", "event").agg(F.min(F.abs(F.col("index") - F.col("at"))).alias("distance"))
    best = distances.groupBy(key, "index").agg(F.min(F.struct("distance", "event")).alias("b"), F.sort_array(F.collect_list("distance")).alias("d"))
    only = F.coalesce(F.get("d", F.lit(1)) > F.get("d", F.lit(0)), F.lit(True))
    return best.filter(only).select(key, "index", F.col("b.event").alias("event"), F.col("b.distance").alias("distance"))


def quote_holds(quotes: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """quotes with status: ok, missing_block, or not_in_block, by whether the excerpt is part of its block."""
    b = blocks.select(*keys, F.col("text").alias("_text"))
    status = F.when(F.col("_text").isNull(), "missing_block").when(F.instr(F.col("_text"), F.col("excerpt")) > 0, "ok").otherwise("not_in_block")
    return quotes.join(b, keys, "left").withColumn("status", status).drop("_text")
