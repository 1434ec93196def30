"""Texts of blocks halved until every part fits a budget, with overlaps, and a proof that each block is covered whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.operators.store import written

# Least text that is split, share of a part above which a block is cut, and bounds of the overlap.
LEAST, OWN_SHARE = 256, 0.6
OVERLAP, OVERLAP_PART = 500, 8
PART = ["key", "path"]
#: Blocks of a part are this far apart in seq, so that overlaps fit between them.
STEP = 2
#: Blocks of a key that are one row (some 30 bytes each), and levels of halving between two tables.
LARGEST, LEVELS = 20_000, 4


def _halved(parts: DataFrame) -> DataFrame:
    """parts (key, path, seq, block, begin, end) with each path in two: path + L and path + R, and the overlaps of both.

    A part is halved at the middle of its characters: in the block that holds it if that is most of the part, else at the nearer
    end of that block. Only places are handled, no texts.
    """
    along = Window.partitionBy(*PART).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parts.withColumn("length", F.col("end") - F.col("begin")).withColumn("reach", F.sum("length").over(along))
    rows = rows.withColumn("total", F.sum("length").over(Window.partitionBy(*PART))).withColumn("middle", F.floor(F.col("total") / 2))
    at = F.min(F.when(F.col("reach") >= F.col("middle"), F.struct("seq", "length", "reach"))).over(Window.partitionBy(*PART))
    rows = rows.withColumn("at", at).withColumn("before", F.col("at.reach") - F.col("at.length"))
    cut = F.col("at.length") > OWN_SHARE * F.col("total")
    nearer = (F.col("before") > 0) & (F.col("middle") - F.col("before") < F.col("at.reach") - F.col("middle"))
    place = F.when(cut, F.col("middle")).when(nearer, F.col("before")).otherwise(F.col("at.reach"))
    rows = rows.withColumn("place", place).withColumn("from", F.col("reach") - F.col("length"))
    # A block goes left by where it begins; one of no length at the place goes with the block that the place is the end of.
    last_left = F.when(cut, F.col("at.seq")).when(nearer, F.col("at.seq") - STEP).otherwise(F.col("at.seq"))
    first_right = F.when(cut, F.col("at.seq")).otherwise(last_left + STEP)
    split_at = F.col("begin") + F.col("place") - F.col("from")
    is_cut = cut & (F.col("seq") == F.col("at.seq"))
    left = rows.filter(F.col("seq") <= last_left).withColumn("end", F.when(is_cut, split_at).otherwise(F.col("end")))
    right = rows.filter(F.col("seq") >= first_right).withColumn("begin", F.when(is_cut, split_at).otherwise(F.col("begin")))
    shared = F.least(F.lit(OVERLAP), F.floor(F.col("place") / OVERLAP_PART), F.floor((F.col("total") - F.col("place")) / OVERLAP_PART))
    head = right.filter((F.col("seq") == first_right) & (shared > 0)).withColumn("end", F.least(F.col("end"), F.col("begin") + shared))
    tail = left.filter((F.col("seq") == last_left) & (shared > 0)).withColumn("begin", F.greatest(F.col("begin"), F.col("end") - shared))

    def side(df: DataFrame, name: str, seq) -> DataFrame:
        return df.select("key", F.concat("path", F.lit(name)).alias("path"), seq.alias("seq"), "block", "begin", "end")

    seq = F.col("seq")
    return side(left, "L", seq).unionByName(side(head, "L", seq + 1)).unionByName(side(right, "R", seq)).unionByName(side(tail, "R", seq - 1))


def _level(parts: DataFrame, budget: int, keep: list[str]) -> DataFrame:
    """parts (key, path, begin, runs) with each that is too long in two, as _halved does it, within the row.

    A part is one stretch of its key's characters that begins at begin; runs: block, start (where the block begins) and until,
    so a run begins where the one before it ends.
    """
    runs, begin, at, place = F.col("runs"), F.col("begin"), F.col("at"), F.col("place")
    until = lambda k: F.when(k > 0, F.try_element_at(runs, k)["until"]).otherwise(begin)
    rows = parts.select(*keep, "path", "begin", "runs", (F.try_element_at(runs, F.lit(-1))["until"] - begin).alias("total"))
    rows = rows.withColumn("over", _over(F.col("total"), budget)).withColumn("middle", F.floor(F.col("total") / 2))
    rows = rows.withColumn("at", F.when(F.col("over"), F.size(F.filter(runs, lambda x: x["until"] - begin < F.col("middle"))) + 1))
    rows = rows.withColumn("before", until(at - 1) - begin).withColumn("reach", until(at) - begin)
    rows = rows.withColumn("cut", F.col("reach") - F.col("before") > OWN_SHARE * F.col("total"))
    nearer = (F.col("before") > 0) & (F.col("middle") - F.col("before") < F.col("reach") - F.col("middle"))
    rows = rows.withColumn("nearer", nearer & ~F.col("cut"))
    rows = rows.withColumn("place", F.when(F.col("cut"), F.col("middle")).when(F.col("nearer"), F.col("before")).otherwise(F.col("reach")))
    rows = rows.withColumn("last", F.when(F.col("nearer"), at - 1).otherwise(at)).withColumn("next", F.when(F.col("cut"), at).otherwise(F.col("last") + 1))
    rows = rows.withColumn("shared", F.least(F.lit(OVERLAP), F.floor(place / OVERLAP_PART), F.floor((F.col("total") - place) / OVERLAP_PART)))
    of = lambda k, end: F.array(F.struct(F.try_element_at(runs, k)["block"].alias("block"), F.try_element_at(runs, k)["start"].alias("start"), end.alias("until")))
    none, some, border = F.slice(runs, 1, 0), F.col("shared") > 0, begin + place
    head = F.when(some, of(F.col("next"), F.least(until(F.col("next")), border + F.col("shared")))).otherwise(none)
    tail = F.when(some, of(F.col("last"), border)).otherwise(none)
    left = F.concat(F.slice(runs, F.lit(1), F.col("last") - 1), of(F.col("last"), border), head)
    right = F.concat(tail, F.slice(runs, F.col("next"), F.greatest(F.size(runs) - F.col("next") + 1, F.lit(0))))
    side = lambda name, start, those: F.struct(F.concat("path", F.lit(name)).alias("path"), start.alias("begin"), those.alias("runs"))
    two = F.array(side("L", begin, left), side("R", F.greatest(until(F.col("last") - 1), border - F.col("shared")), right))
    return rows.select(*keep, F.inline(F.when(F.col("over"), two).otherwise(F.array(side("", begin, runs)))))


def _over(total: Column, budget: int) -> Column:
    return (total > budget) & (total >= LEAST)


def halve(blocks: DataFrame, budget: int, key: str = "artifact", order: str = "block", text: str = "text", largest: int = LARGEST) -> DataFrame:
    """key, path, seq, block, begin, end, fits: the runs of characters of each part of each key's blocks, in order of seq.

    Parts of at most budget characters stay, others are halved; path says how (L and R). fits is false for parts above the budget
    that are too short to be halved (under 256 characters). Only places are handled, no texts. A key of at most `largest` blocks
    is one row with its runs, halved without a shuffle LEVELS times before what is still too long is written and read again;
    longer keys are halved by windows, with the same parts. A part shrinks by a sixth at least, so levels follow the logarithm of
    the longest text. Null texts count as empty. (key, order) must tell blocks apart; rows with a null in either are left out. An
    empty table gives no rows.
    """
    size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    base = blocks.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("block"), size.alias("size"))
    along = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = base.withColumn("until", F.sum("size").over(along)).withColumn("nth", F.count(F.lit(1)).over(along))
    run = F.when(F.col("nth") <= largest, F.struct("block", (F.col("until") - F.col("size")).alias("start"), "until"))
    keys = written(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(run)).alias("runs")), "halves")
    done, todo = [], keys.filter(F.col("n") <= largest).select("key", F.lit("").alias("path"), F.lit(0).cast("long").alias("begin"), "runs")
    while True:
        for _ in range(LEVELS):
            todo = _level(todo, budget, ["key"])
        sized = written(todo.withColumn("total", F.element_at("runs", -1)["until"] - F.col("begin")), "halves")
        begin = lambda i: F.when(i > 0, F.try_element_at("runs", i)["until"]).otherwise(F.col("begin"))
        shown = F.transform("runs", lambda x, i: F.struct(((i + 1) * STEP).cast("long").alias("seq"), x["block"].alias("block"), (begin(i) - x["start"]).alias("begin"), (x["until"] - x["start"]).alias("end")))
        done.append(sized.filter(~_over(F.col("total"), budget)).select("key", "path", (F.col("total") <= budget).alias("fits"), shown.alias("shown")).select("key", "path", F.inline("shown"), "fits"))
        todo = sized.filter(_over(F.col("total"), budget)).drop("total")
        if todo.isEmpty():
            break
    long = keys.filter(F.col("n") > largest).select("key")
    if not long.isEmpty():
        done.append(_halved_by_windows(base.join(long, "key", "left_semi"), budget))
    return reduce(DataFrame.unionByName, done).withColumnRenamed("key", key).withColumnRenamed("block", order)


def _halved_by_windows(base: DataFrame, budget: int) -> DataFrame:
    """What halve gives, of (key, block, size): each round reads only what is still too long, and writes it."""
    numbered = F.row_number().over(Window.partitionBy("key").orderBy("block"))
    parts = base.select("key", F.lit("").alias("path"), (numbered * STEP).cast("long").alias("seq"), "block", F.lit(0).cast("long").alias("begin"), F.col("size").alias("end"))
    done = None
    while True:
        total = F.sum(F.col("end") - F.col("begin")).over(Window.partitionBy(*PART))
        sized = written(parts.withColumn("total", total), "halves")
        over = _over(F.col("total"), budget)
        kept = sized.filter(~over).withColumn("fits", F.col("total") <= budget).drop("total")
        done = kept if done is None else done.unionByName(kept)
        todo = sized.filter(over).drop("total")
        if todo.isEmpty():
            return done
        # Places between the blocks stay free for the overlaps of the next round.
        parts = _halved(todo).withColumn("seq", (F.row_number().over(Window.partitionBy(*PART).orderBy("seq")) * STEP).cast("long"))


def covered_parts(halves: DataFrame, blocks: DataFrame, key: str = "artifact", order: str = "block", text: str = "text") -> DataFrame:
    """key, path, fits, n_chars, n_first, text: each part with its text and how many of its characters no run before it in their block holds.

    A row with a null path for each key has the number of its blocks as n_first and their characters as n_chars, so that the sum
    of all parts' n_first less n_chars tells what is missing. Blocks and runs are dealt by key together, and a run finds its
    block before it in their order: texts are shuffled once.
    """
    known = blocks.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    both = halves.select(key, order, "path", "fits", "seq", "begin", "end").unionByName(known, allowMissingColumns=True).repartition(key)
    along = Window.partitionBy(key, order).orderBy("begin", "end")  # the block itself comes first
    own = F.first("_text").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reach = F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = both.select(key, "path", "fits", "seq", "begin", "end", own.alias("own"), reach.alias("reach")).filter(F.col("own").isNotNull())
    run = F.col("path").isNotNull()
    said = F.substring(F.col("own"), (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    pieces = F.collect_list(F.when(run, F.struct("seq", said.alias("said"))))
    first = F.when(run, F.greatest(F.col("end") - F.greatest("begin", "reach"), F.lit(0))).otherwise(1)
    size = F.when(run, F.col("end") - F.col("begin")).otherwise(F.length("own"))
    made = rows.groupBy(key, "path", "fits").agg(F.sum(size).alias("size"), F.sum(first).alias("n_first"), F.sort_array(pieces).alias("pieces"))
    made = made.select(key, "path", "fits", "size", "n_first", F.when(run, F.array_join(F.transform("pieces", lambda p: p["said"]), "")).alias("text"))
    return made.select(key, "path", "fits", F.when(run, F.length("text").cast("long")).otherwise(F.col("size")).alias("n_chars"), "n_first", "text")


def part_texts(halves: DataFrame, blocks: DataFrame, key: str = "artifact", order: str = "block", text: str = "text") -> DataFrame:
    """key, path, fits, n_chars, text: each part with its text, no longer than the budget where it fits."""
    return covered_parts(halves, blocks, key, order, text).filter(F.col("path").isNotNull()).select(key, "path", "fits", "n_chars", "text")


def coverage(halves: DataFrame, blocks: DataFrame, key: str = "artifact", order: str = "block", text: str = "text") -> DataFrame:
    """key, order, n_chars, n_missing: for each block the characters that no part holds. Blocks and runs are dealt by key together."""
    size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    known = blocks.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order, size.alias("n_chars"))
    both = halves.select(key, order, "begin", "end").unionByName(known, allowMissingColumns=True).repartition(key)
    before = Window.partitionBy(key, order).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = both.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    held = F.sum(F.greatest(F.col("end") - F.greatest("begin", "reach"), F.lit(0)))
    told = runs.groupBy(key, order).agg(F.max("n_chars").alias("n_chars"), held.alias("held")).filter(F.col("n_chars").isNotNull())
    return told.select(key, order, "n_chars", (F.col("n_chars") - F.coalesce("held", F.lit(0))).alias("n_missing"))
