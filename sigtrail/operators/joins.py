"""Join patterns: ranges, neighbourhoods, priorities, disjunctions and unique names, as plans of equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, bucket: int = 64) -> DataFrame:
    """Points within spans (both ends included) of the same key.

    A span is a row for each bucket of positions that it touches, so that the join is on (key, bucket) and its work follows the
    matches, not the product.
    """
    p = points.withColumn("_b", F.floor(F.col(point) / bucket))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return p.join(s, [key, "_b"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("_b")


def smallest_span(matches: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Of the spans around each point the shortest, then the least tie."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(end) - F.col(start), tie))
    return matches.withColumn("_n", best).filter("_n = 1").drop("_n")


def neighborhood(hits: DataFrame, blocks: DataFrame, key: str, index: str, radius: int) -> DataFrame:
    """The blocks at most radius away from a hit of the same key, each once."""
    near = hits.select(key, F.explode(F.sequence(F.col(index) - radius, F.col(index) + radius)).alias(index)).distinct()
    return blocks.join(near, [key, index], "left_semi")


def by_priority(candidates: list[tuple[str, float, DataFrame]], key: list[str], tie: str) -> DataFrame:
    """For each key the match of the first method that has one: method and confidence are added. Ties go to the least tie."""
    parts = [df.withColumn("method", F.lit(m)).withColumn("confidence", F.lit(c)).withColumn("_p", F.lit(k)) for k, (m, c, df) in enumerate(candidates)]
    best = F.row_number().over(Window.partitionBy(*key).orderBy("_p", tie))
    return reduce(DataFrame.unionByName, parts).withColumn("_n", best).filter("_n = 1").drop("_n", "_p")


def unique_match(left: DataFrame, right: DataFrame, key: str, name: str, target: str) -> DataFrame:
    """left with the target that its name has in right, where there is exactly one."""
    only = right.groupBy(key, name).agg(F.count(F.lit(1)).alias("_n"), F.min(target).alias(target)).filter("_n = 1").drop("_n")
    return left.join(only, [key, name], "left")


def any_of(rows: DataFrame, key: str, sides: list[DataFrame]) -> DataFrame:
    """Rows that match any of the sides on key: a disjunction of joins as a union of keys and one semi-join."""
    keys = reduce(DataFrame.unionByName, [s.select(key) for s in sides]).distinct()
    return rows.join(keys, key, "left_semi")


def other_end(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected edges as (node, other): both directions."""
    rest = [c for c in edges.columns if c not in (a, b)]
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest)
    return one.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def set_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys with change: added or missing."""
    added = new.select(*keys).distinct().join(old, keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.select(*keys).distinct().join(new, keys, "left_anti").withColumn("change", F.lit("missing")))


def frontier(edges: DataFrame, start: DataFrame, rounds: int, per_round: int, order: list[Column] | None = None) -> DataFrame:
    """node, hop: the nodes reached from start over (src, dst) in at most rounds hops, at most per_round new ones for each root.

    start: root, node. The loop's state is cut by a written table each round; only a count comes to the driver.
    """
    from sigtrail.operators.store import written

    seen = start.select("root", "node").distinct().withColumn("hop", F.lit(0))
    edge = edges.select(F.col("src").alias("node"), "dst").distinct()
    last = seen
    for hop in range(1, rounds + 1):
        found = last.join(edge, "node").select("root", F.col("dst").alias("node")).distinct().join(seen, ["root", "node"], "left_anti")
        first = Window.partitionBy("root").orderBy(*(order or [F.col("node")]))
        last = written(found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_round).drop("_n").withColumn("hop", F.lit(hop)), "frontier")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen
