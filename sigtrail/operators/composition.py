"""Prompts put together from verified components: the smallest unit around a line, and the ordered components of each call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions are below 2 to this power.
LEVELS = 40
# What a component must be, and how a composition is named.
BINDING, ROLE = "relation_verified", "application"
PREFIX, DIGITS = "prompt-composition:", 20


def span_blocks(start: Column, end: Column) -> Column:
    """Blocks (level, block) of 2^level positions that make up [start, end] without overlap: two of a level at most."""
    levels = F.sequence(F.lit(0), F.lit(LEVELS))

    def of_level(k: Column) -> Column:
        size = F.pow(F.lit(2), k)
        first, last = F.ceil(start / size).cast("long"), F.floor((end + 1) / size).cast("long")
        some = first < last
        left, right = F.when(some & (first % 2 == 1), first), F.when(some & (last % 2 == 1), last - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda b: F.struct(k.alias("level"), b.alias("block")))

    return F.flatten(F.transform(levels, of_level))


def smallest_enclosing(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, ties: list[Column | str], value: str, name: str) -> DataFrame:
    """points with name: the value of the shortest span of the same keys around the point (both ends in), by ties among equals.

    Spans may be nested or overlap in any way. Each is cut into aligned blocks, of which two of a size at most are needed, and only
    the best span of each block is kept; a point asks the blocks that it lies in, one of each size, up to the size that the last end
    of its keys allows. So nothing follows the number of spans around a point, and no key or block is sent whole to one task but
    for its partial minimum. The joins are merge joins: blocks of many short keys compress so well that they would pass for small
    tables and be gathered on the driver. Null points and points
    outside all spans give null; spans with a null or negative end, or that end before they start, take no part. Rows that repeat stay.
    """
    rank = F.struct((F.col(end) - F.col(start)).alias("length"), *(F.struct(F.col(t) if isinstance(t, str) else t).alias(f"tie{n}") for n, t in enumerate(ties)), F.col(value).alias("value"))
    usable = spans.filter((F.col(start) >= 0) & (F.col(start) <= F.col(end)))
    blocks = usable.select(*keys, rank.alias("_rank"), F.inline(span_blocks(F.col(start).cast("long"), F.col(end).cast("long"))))
    best = blocks.groupBy(*keys, "level", "block").agg(F.min("_rank").alias("_rank"))
    asked = points.select(*keys, F.col(point).alias("_point")).filter("_point >= 0").distinct()
    reach = usable.groupBy(*keys).agg(F.max(F.col(end).cast("long")).alias("_last"))
    asked = asked.join(reach.hint("merge"), keys).filter(F.col("_point") <= F.col("_last"))
    top = F.least(F.length(F.bin(F.col("_last") + 1)) - 1, F.lit(LEVELS))  # 2^top positions are the most that a block may have
    asked = asked.select(*keys, "_point", "_last", F.explode(F.sequence(F.lit(0), top)).alias("level")).withColumn("block", F.floor(F.col("_point") / F.pow(F.lit(2), F.col("level"))).cast("long"))
    asked = asked.filter((F.col("block") + 1) * F.pow(F.lit(2), F.col("level")) <= F.col("_last") + 1).drop("_last")
    found = asked.join(best.hint("merge"), [*keys, "level", "block"]).groupBy(*keys, "_point").agg(F.min("_rank")["value"].alias(name))
    renamed = found.select(*(F.col(k).alias(f"_{k}") for k in keys), "_point", name)
    on = F.col(point) == F.col("_point")
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return points.join(renamed.hint("merge"), on, "left").drop("_point", *(f"_{k}" for k in keys))


def prompt_components(records: DataFrame, sites: DataFrame, units: DataFrame) -> DataFrame:
    """artifact, composition_id, unit, call_line, callee, nth (from 1), record, source_unit, text, text_hash, line, end_line.

    records: artifact, record, role, call_binding, text, text_hash, line, end_line; sites: artifact, record, call_line, callee;
    units: artifact, unit, kind, start_line, end_line. Verified application components go to the smallest unit around each of
    their calls (a module's own code last among equals, then the least name); calls outside all units are left out. One call
    (unit, line, callee) is a composition with its components in order of source. A component outside all units, or without a
    line, counts as of the call's unit. Null callees are "unknown". What a call makes of them at run time isn't claimed.
    """
    is_module = F.col("kind").eqNullSafe("module_init")
    inside = lambda df, line, name: smallest_enclosing(df, units, ["artifact"], line, "start_line", "end_line", [is_module, "unit"], "unit", name)
    kept = records.filter((F.col("call_binding") == BINDING) & (F.col("role") == ROLE)).select("artifact", "record", "text", "text_hash", "line", F.col("end_line").alias("last_line"))
    kept = inside(kept, "line", "own_unit")
    calls = inside(sites.select("artifact", "record", "call_line", F.coalesce("callee", F.lit("unknown")).alias("callee")), "call_line", "unit").filter("unit is not null")
    rows = kept.join(calls, ["artifact", "record"]).withColumn("source_unit", F.coalesce("own_unit", "unit")).drop("own_unit")
    text = lambda c: F.regexp_extract(F.to_json(F.array(F.col(c))), r"^\[([\s\S]*)\]$", 1)
    seed = F.concat(F.lit("["), text("unit"), F.lit(", "), F.col("call_line").cast("string"), F.lit(", "), text("callee"), F.lit("]"))
    rows = rows.withColumn("composition_id", F.concat(F.lit(PREFIX), F.left(F.sha2(seed, 256), F.lit(DIGITS))))
    order = [F.coalesce("line", F.lit(0)), F.coalesce("last_line", F.lit(0)), F.coalesce("text_hash", F.lit("")), F.col("record")]
    nth = F.row_number().over(Window.partitionBy("artifact", "unit", "call_line", "callee").orderBy(*order))
    return rows.withColumn("nth", nth).withColumnRenamed("last_line", "end_line")


def prompt_compositions(components: DataFrame) -> DataFrame:
    """artifact, composition_id, unit, call_line, callee, n_components, static_reconstruction, source_units (in order, each once).

    Only the components of one call meet in a row: it is the text that is asked for.
    """
    parts = F.sort_array(F.collect_list(F.struct("nth", F.coalesce("text", F.lit("")).alias("text"), "source_unit")))
    rows = components.groupBy("artifact", "composition_id", "unit", "call_line", "callee").agg(parts.alias("parts"))
    return rows.select(
        "artifact", "composition_id", "unit", "call_line", "callee", F.size("parts").cast("long").alias("n_components"),
        F.array_join(F.col("parts.text"), "").alias("static_reconstruction"), F.array_distinct(F.col("parts.source_unit")).alias("source_units"),
    )


def record_links(components: DataFrame) -> DataFrame:
    """artifact, record, composition_ids (sorted, each once): the compositions that each component is in."""
    return components.groupBy("artifact", "record").agg(F.sort_array(F.collect_set("composition_id")).alias("composition_ids"))
