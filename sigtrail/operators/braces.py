"""Methods and strings of sources in languages with braces: a file of one slice is read whole, a larger one by a segmented scan of many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.functions import braces as B
from sigtrail.operators.composition import smallest_enclosing
from sigtrail.operators.store import written

#: Characters of a slice; results are the same at any size.
SLICE_CHARS = 65_536
#: Buckets of artifacts, which tell those that have several rows.
BUCKETS = 4096
KEYS = ["artifact", "content"]


def distinct_texts(sources: DataFrame) -> DataFrame:
    """artifact, content (SHA-256 of the text), text: each source once. Null texts are empty.

    Only texts of artifacts that have several rows may repeat, so only these are shuffled, with those that share a bucket with one.
    """
    bucket = F.pmod(F.xxhash64("artifact"), F.lit(BUCKETS))
    several = sources.groupBy("artifact").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(bucket.cast("int").alias("bucket")).distinct()
    several = [r.bucket for r in several.collect()]  # BUCKETS numbers at most
    base = sources.select("artifact", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.sha2("text", 256)).select(*KEYS, "text")
    return base.filter(~bucket.isin(several)).unionByName(base.filter(bucket.isin(several)).dropDuplicates(KEYS)) if several else base


def source_units(texts: DataFrame) -> DataFrame:
    """The units (as of `brace_units`) of texts that are read whole: their tokens stay in one task."""
    return texts.mapInArrow(B.unit_reader(KEYS), f"artifact {texts.schema['artifact'].dataType.simpleString()}, content string, {B.UNIT}")


def source_slices(texts: DataFrame, size: int = SLICE_CHARS) -> DataFrame:
    """artifact, content, n, start, line, slice, ends (state after, by state before)."""
    return texts.mapInArrow(B.slicer(KEYS, size), f"artifact {texts.schema['artifact'].dataType.simpleString()}, content string, {B.SLICE}")


def source_tokens(slices: DataFrame) -> DataFrame:
    """artifact, content, n, kind, pos, line, begin, name, value: braces and quoted parts of each slice, read in its own state.

    The states of a file's slices come from their maps alone, four numbers a slice; files of one slice need none.
    """
    kind = slices.schema["artifact"].dataType.simpleString()
    several = slices.select(*KEYS, "n", "ends").join(slices.filter("n = 1").select(*KEYS).hint("merge"), KEYS, "left_semi")
    states = several.groupBy(*KEYS).applyInPandas(B.entry_states(KEYS), f"artifact {kind}, content string, n long, state int")
    known = slices.drop("ends").join(states.hint("merge"), [*KEYS, "n"], "left").withColumn("state", F.coalesce("state", F.lit(B.CODE)))
    return known.mapInArrow(B.reader(KEYS), f"artifact {kind}, content string, {B.TOKEN}")


def matched_braces(tokens: DataFrame) -> DataFrame:
    """The opening braces with close, close_line and close_n of their partners; those without one are left out.

    Depth is the sum of the slices before and a running sum within the slice. At each depth, braces open and close in turn.
    """
    rows = tokens.filter("kind in ('{', '}')").withColumn("d", F.when(F.col("kind") == "{", 1).otherwise(-1))
    sums = rows.groupBy(*KEYS, "n").agg(F.sum("d").alias("d"))
    before = F.coalesce(F.sum("d").over(Window.partitionBy(*KEYS).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.select(*KEYS, "n", before.alias("before")).hint("merge"), [*KEYS, "n"])
    depth = F.col("before") + F.sum("d").over(Window.partitionBy(*KEYS, "n").orderBy("pos"))
    rows = rows.withColumn("depth", depth).withColumn("depth", F.when(F.col("d") == 1, F.col("depth")).otherwise(F.col("depth") + 1))
    level = Window.partitionBy(*KEYS, "depth").orderBy("pos")
    after = lambda c: F.lead(c).over(level)
    rows = rows.select("*", after("d").alias("next_d"), after("pos").alias("close"), after("line").alias("close_line"), after("n").alias("close_n"))
    return rows.filter("d = 1 and next_d = -1").drop("d", "next_d", "before", "kind", "value")


def strings(tokens: DataFrame) -> DataFrame:
    """artifact, content, start, line, value: the double-quoted strings in code, put together where they run over slices."""
    whole = tokens.filter("kind = 'string'").select(*KEYS, F.col("pos").alias("start"), "line", "value")
    parts = tokens.filter("kind in ('head', 'middle', 'tail')")
    begun = F.sum(F.when(F.col("kind") == "head", 1).otherwise(0)).over(Window.partitionBy(*KEYS).orderBy("pos"))
    parts = parts.withColumn("nth", begun).groupBy(*KEYS, "nth").agg(
        F.min("pos").alias("start"), F.min("line").alias("line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]), "").alias("value"),
        F.max((F.col("kind") == "tail").cast("int")).alias("ended"),
    )
    return whole.unionByName(parts.filter("ended = 1").drop("nth", "ended"))


def brace_units(sources: DataFrame, size: int = SLICE_CHARS) -> DataFrame:
    """artifact, content, kind, symbol, start, start_line, end_line, n_chars, text, owner: the units of each source.

    A source of one slice's size is read whole; what follows is for longer ones, whose slices are read by many tasks.
    No join gathers a side on the driver: numbers of units follow the sources, however well they compress.

    kind is method (from its line's start to its closing brace), string (not empty, in a method: owner is where the smallest one
    starts), class_structure (what is outside all methods, if anything; without text) or class (a source without methods, whole).
    Offsets and lengths are in code points, lines from 1. Braces and quotes count only in code; methods may be nested. An
    unclosed brace makes no method. Null texts are empty; rows that repeat (artifact and text) count once, and one artifact may
    have several texts. Null artifacts are left out. An empty table gives no rows.
    """
    each = distinct_texts(sources.filter("artifact is not null"))
    slices = written(source_slices(each.filter(F.length("text") > size), size), "source-slices")
    tokens = written(source_tokens(slices), "source-tokens")
    found = matched_braces(tokens).filter("name is not null").select(
        *KEYS, F.col("name").alias("symbol"), F.col("begin").alias("start"), F.col("close").alias("last"), F.col("line").alias("start_line"), F.col("close_line").alias("end_line"), "n", "close_n"
    )
    methods = written(found, "source-methods")
    cut = F.substring("slice", F.greatest(F.col("m_start") - F.col("start"), F.lit(0)).cast("int") + 1, (F.least(F.col("m_last") - F.col("start") + 1, F.length("slice")) - F.greatest(F.col("m_start") - F.col("start"), F.lit(0))).cast("int"))
    pieces = methods.select(*KEYS, F.col("start").alias("m_start"), F.col("last").alias("m_last"), F.explode(F.sequence("n", "close_n")).alias("n")).hint("merge").join(slices.select(*KEYS, "n", "start", "slice"), [*KEYS, "n"])
    pieces = pieces.select(*KEYS, "n", "m_start", cut.alias("text"))  # before they are grouped, so that no whole slice goes with each method
    texts = pieces.groupBy(*KEYS, F.col("m_start").alias("start")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]), "").alias("text"))
    none = F.lit(None)
    own = methods.join(texts.hint("merge"), [*KEYS, "start"]).select(
        *KEYS, F.lit("method").alias("kind"), "symbol", "start", "start_line", "end_line", (F.col("last") - F.col("start") + 1).alias("n_chars"), "text", none.cast("long").alias("owner")
    )
    said = smallest_enclosing(strings(tokens).filter("value <> ''"), methods.select(*KEYS, F.col("start").alias("m"), "last"), KEYS, "start", "m", "last", ["m"], "m", "owner").filter("owner is not null")
    said = said.select(*KEYS, F.lit("string").alias("kind"), none.cast("string").alias("symbol"), "start", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.length("value").cast("long").alias("n_chars"), "value", "owner")
    reach = F.max("last").over(Window.partitionBy(*KEYS).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    outer = methods.withColumn("reach", reach).filter("reach is null or start > reach").groupBy(*KEYS).agg(F.sum(F.col("last") - F.col("start") + 1).alias("inside"))
    sizes = slices.select(*KEYS, "n", F.length("slice").alias("size"), (F.col("line") + F.length(F.regexp_replace("slice", "[^\n]", ""))).alias("line"))
    files = sizes.groupBy(*KEYS).agg(F.sum("size").alias("size"), F.max(F.struct("n", "line"))["line"].alias("end_line")).join(outer.hint("merge"), KEYS, "left")
    rest = files.filter("inside is null or inside < size").select(
        *KEYS, F.when(F.col("inside").isNull(), "class").otherwise("class_structure").alias("kind"), none.cast("string").alias("symbol"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("start_line"),
        F.col("end_line"), (F.col("size") - F.coalesce("inside", F.lit(0))).alias("n_chars"), none.cast("string").alias("text"), none.cast("long").alias("owner"),
    )
    return own.unionByName(said.withColumnRenamed("value", "text")).unionByName(rest).unionByName(source_units(each.filter(F.length("text") <= size)))
