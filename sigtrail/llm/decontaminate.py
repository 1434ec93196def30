"""Benchmark decontamination by template canonicalisation, with DataFrame operations only.

Numbers, names and units become typed placeholders, which keep their values aside. Windows of the templates of the benchmark
are joined by hash with the windows of all documents; on each place where a document may hold an item the values must map
consistently (one value of the item, one value of the document), so that the same question with other parameters is found,
and a text that merely has numbers in the same places is not.

Which words are names can't be seen where a sentence begins or where case was changed. Each text is therefore read in three
ways: all words as they are, in lower case; words with a capital as names; and runs of such words as one name each, so that a
name may become one of another number of words. What is consistent in one of the readings counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtrail.llm.common import durable, table, text_of

WIDTH, PERCENT = 5, 75
#: Windows of the benchmark that are broadcast at most; beyond, they are shuffled.
BROADCAST_WINDOWS = 500_000

# Units of measure that may follow a number, and words that are numbers ("one" is more often something else).
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres dollar dollars cent cents euro euros usd eur gbp percent degree degrees mph kmh"
).split()
NUMBERS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()
MARK = "§"
#: Readings: words as they are, words with a capital as names, runs of words with a capital as one name; both where there is no run.
PLAIN, NAMES, RUNS, BOTH = 0, 1, 2, 3
#: Words besides placeholders that a place shares at least with the item where other names stand: "§s is" says nothing.
LEAST_WORDS = 2
#: Windows on diagonals that are this share of the item's windows apart are of one place in a document.
DRIFT = 0.25


def canonical(text: Column) -> Column:
    """The text in lower case, with numbers as §n, words with a capital as §s and units as §u before their values."""
    named = F.regexp_replace(text, r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}\p{L}*+", f"{MARK}s$0")
    number = rf"[0-9]+(?:[.,:/][0-9]+)*+|(?:{MARK}s|(?<![\p{{L}}\p{{N}}{MARK}]))(?i:{'|'.join(NUMBERS)})(?![\p{{L}}\p{{N}}])"
    counted = F.regexp_replace(named, number, f" {MARK}n$0 ")
    measured = F.regexp_replace(counted, rf"({MARK}n\S+)\s+(?:{MARK}s)?((?i:{'|'.join(UNITS)}))\b", f"$1 {MARK}u$2")
    return F.replace(F.lower(measured), F.lit(f"{MARK}n{MARK}s"), F.lit(f"{MARK}n"))


def words(text: Column, runs: bool = False) -> Column:
    """The words of a text's canonical form; with runs, names that only blanks, hyphens or apostrophes part are one word."""
    form = canonical(F.replace(text, F.lit(MARK), F.lit(" ")))
    if runs:
        form = F.regexp_replace(form, rf"({MARK}s\p{{L}}++)(?:[ \t]+|[-'’])(?={MARK}s)", "$1")
    return F.regexp_extract_all(form, F.lit(rf"{MARK}n[0-9]+(?:[.,:/][0-9]+)*|[\p{{L}}\p{{N}}{MARK}]+"), F.lit(0))


def _value(word: Column, reading: Column) -> Column:
    """The value of a marked word that is a placeholder in the reading; else null."""
    kind = F.substring(word, 2, 1)
    return F.when(kind == "n", F.regexp_replace(word, "[.,:/]", "")).when((kind == "u") | (kind == "s") & (reading != PLAIN), word)


def _windows(base: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """keys, v (each word that is marked, null for others), width, reading, pos, h: the windows of each text in each reading."""
    rows = base.select(*keys, words(F.col("text")).alias("words"), words(F.col("text"), runs=True).alias("runs"))
    marked = lambda w: F.startswith(w, F.lit(MARK))
    name = lambda w: F.startswith(w, F.lit(f"{MARK}s"))
    plain = F.transform("words", lambda w: F.xxhash64(F.when(~marked(w), w).when(name(w), F.substring(w, 3, 1 << 30)).otherwise(F.left(w, F.lit(2)))))
    named = lambda c: F.transform(c, lambda w: F.xxhash64(F.when(marked(w), F.left(w, F.lit(2))).otherwise(w)))
    values = lambda c: F.transform(c, lambda w: F.when(marked(w), w))
    has_run = F.size("words") > F.size("runs")
    rows = rows.select(*keys, F.when(has_run, RUNS).otherwise(BOTH).alias("last"), plain.alias("t0"), F.when(F.exists("words", name), named("words")).alias("t1"), F.when(has_run, named("runs")).alias("t2"),
        values("words").alias("v"), F.when(has_run, values("runs")).alias("v2"))

    def hashes(width: int, t: str, reading: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(t) - width), lambda i: F.xxhash64(F.lit(2 * width + (t != "t0")), *(F.get(t, i + k) for k in range(width))))
        return F.struct(F.lit(width).alias("width"), reading.alias("reading"), F.when(F.size(t) >= width, h).alias("hs"))

    readings = {"t0": F.lit(PLAIN), "t1": F.when(F.col("last") == BOTH, BOTH).otherwise(NAMES), "t2": F.lit(RUNS)}
    each = F.array(*(hashes(width, t, reading) for width in widths for t, reading in readings.items()))
    rows = rows.select(*keys, "v", "v2", F.inline(each)).withColumn("v", F.when(F.col("reading") == RUNS, F.col("v2")).otherwise(F.col("v")))
    return rows.select(*keys, "v", "width", "reading", F.posexplode("hs").alias("pos", "h"))


def benchmark_windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """item_id, h, ireading, ipos, n_words (of the item, as plainly read; as read by runs), islots, iown, and the widths.

    An item with fewer words than width is one window.
    """
    base = benchmark.select(F.col("item_id"), text_of().alias("text")).filter("item_id is not null").distinct()
    sized = base.withColumn("own", F.least(F.size(words(F.col("text"))), F.lit(width))).filter("own > 0")
    widths = sorted(r[0] for r in sized.select("own").distinct().collect()) or [width]  # width values at most
    rows = _windows(sized, ["item_id", "own"], widths).filter("width = own").withColumn("islots", F.slice("v", F.col("pos") + 1, F.col("own")))
    rows = durable(rows.select("item_id", "h", F.col("reading").alias("ireading"), F.col("pos").alias("ipos"), "islots"), "bench-read")
    n = rows.groupBy("item_id").agg(F.countDistinct(F.when(F.col("ireading") != RUNS, F.col("ipos"))).alias("n_plain"), F.countDistinct(F.when(F.col("ireading") == RUNS, F.col("ipos"))).alias("n_runs"))
    return durable(rows.join(n, "item_id").withColumn("n_runs", F.when(F.col("n_runs") > 0, F.col("n_runs")).otherwise(F.col("n_plain"))), "bench-windows"), widths


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), item_id, covered, n_windows, exact: the items that a document holds.

    An item is held if at least percent of its windows occur in the document, at places whose values map consistently; exact
    says that places where all values are the same are enough for that. Windows on near diagonals are of one place (words may
    have been put in or left out); of the hits of one window of the item there, the one on the diagonal with most hits counts.
    A place with other names shares LEAST_WORDS words with the item besides. Windows read by runs are counted on their own.
    """
    bench, widths = benchmark_windows(benchmark, width)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    found = _windows(base, ["doc_id", "th"], widths)
    slots = F.slice("v", F.col("pos") + 1, F.col("width"))
    if bench.count() <= BROADCAST_WINDOWS:
        hits = found.join(F.broadcast(bench), "h").withColumn("slots", slots)  # slots of hits only
    else:
        hits = found.withColumn("slots", slots).drop("v").join(bench, "h")
    shared = F.col("reading").bitwiseAND(F.col("ireading"))  # BOTH meets NAMES, RUNS and itself
    hits = hits.filter((F.col("reading") == F.col("ireading")) | (shared > 0)).withColumn("reading", F.when(shared == BOTH, NAMES).otherwise(shared))
    value = lambda c: F.transform(c, lambda w: _value(w, F.col("reading")))
    pairs = F.filter(F.arrays_zip(value("islots").alias("b"), value("slots").alias("d")), lambda p: p["b"].isNotNull())
    said = F.filter(F.transform("islots", lambda w, k: F.when(_value(w, F.col("reading")).isNull(), F.col("ipos") + k)), lambda x: x.isNotNull())
    item = ["doc_id", "th", "item_id"]
    n_windows = F.when(F.col("reading") == RUNS, F.col("n_runs")).otherwise(F.col("n_plain"))
    hits = hits.select(*item, "reading", "ipos", n_windows.alias("n_windows"), (F.col("pos") - F.col("ipos")).alias("diagonal"), pairs.alias("pairs"), said.alias("said")).repartition(*item)  # all that follows is within an item of a document

    lines = hits.groupBy(*item, "reading", "diagonal").agg(F.max("n_windows").alias("n_windows"), F.collect_set(F.struct("ipos", "pairs", "said")).alias("at"))
    by_diagonal = Window.partitionBy(*item, "reading").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by_diagonal)) > 1 + DRIFT * F.col("n_windows")
    lines = lines.withColumn("place", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(*item, "reading", "place", "ipos").orderBy(F.desc("support"), "diagonal")
    chosen = lines.select(*item, "reading", "place", "n_windows", "diagonal", F.size("at").alias("support"), F.inline("at")).withColumn("nth", F.row_number().over(best)).filter("nth = 1")
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    places = chosen.groupBy(*item, "reading", "place").agg(F.collect_list("ipos").alias("at"), F.max("n_windows").alias("n_windows"), every("pairs").alias("pairs"), F.size(every("said")).alias("said"))
    places = places.withColumn("exact", ~F.exists("pairs", lambda p: ~p["b"].eqNullSafe(p["d"])))
    consistent = places.filter((F.size("pairs") <= F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"])))) & (F.col("exact") | (F.col("reading") == PLAIN) | (F.col("said") >= LEAST_WORDS)))
    covered = lambda c: F.size(every(c))
    read = consistent.groupBy(*item, (F.col("reading") == RUNS).alias("by_runs")).agg(covered("at").alias("covered"), covered(F.when(F.col("exact"), F.col("at"))).alias("same"), F.max("n_windows").alias("n_windows"))
    enough = lambda n: n * 100 >= F.col("n_windows") * percent
    held = read.filter(enough(F.col("covered"))).withColumn("exact", enough(F.greatest("same", F.lit(0))))
    best_read = F.max(F.struct(F.col("exact"), (F.col("covered") / F.col("n_windows")).alias("share"), F.col("covered"), F.col("n_windows")))
    return held.groupBy(*item).agg(best_read.alias("r")).select(*item, "r.covered", "r.n_windows", "r.exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), exact_ids (those with equal values): one row for each row of docs.

    Null and empty texts hold nothing; benchmark rows without an id or a word are left out, an empty benchmark flags nothing.
    Rows that repeat (id and text) get the same answer each. Other columns are not read. An empty table gives no rows.
    Windows are matched by 64-bit hashes. The benchmark is broadcast only after a check of its size.
    """
    held = find_leaks(docs, benchmark, width, percent, id_col, text_col)
    per_doc = held.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("exact"))
    per_doc = per_doc.select(F.col("doc_id").alias("held_id"), F.col("th").alias("held_th"), "items", "exact")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("th"))
    joined = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("th") == F.col("held_th")), "left")
    none = F.array().cast(per_doc.schema["items"].dataType)
    items = F.coalesce("items", none)
    return joined.select("doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.coalesce("exact", none).alias("exact_ids"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE_SQL: dict[str, str] = {}
