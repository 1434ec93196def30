"""Secret scan with a random forest that removes false positives, with DataFrame operations only.

Candidates are long runs of key characters, and whatever is assigned to a word for secrets, of any length. Their features are
length, how usual their character transitions are, how much of them the corpus' own words cover, the kinds of characters, the
parts of the path, and the neighbouring words. The forest is trained from labelled findings; where there are none, from labels
by syntax (how a value is written down), which is no feature. Transitions and words are counted over all words of all documents.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtrail.llm.common import durable, table, text_of

#: Characters that make a run a candidate wherever it is; longer words aren't counted as words.
RUN_CHARS = 20
#: Characters of context on either side, labelled findings that train the forest at most (of each class), its trees.
CONTEXT, TRAINED, TREES, DEPTH = 60, 5_000, 20, 6
#: A word's four-letter part is the corpus' own if words with it occur so often.
OWN_WORDS = 20

# Words before a value that say what it is.
KEY_WORDS = "token|secret|api[_-]?key|apikey|access[_-]?key|private[_-]?key|key|password|passwd|pwd|auth|authorization|bearer|credential|credentials"
HASH_WORDS = "sha|sha1|sha256|md5|commit|checksum|digest|hash|uuid|guid|etag|revision"
#: A run of key characters, or what follows a word for secrets and a colon or equal sign. The first, short tests spare most places the last one.
CANDIDATE = (
    rf"[A-Za-z0-9+/=_\-]{{{RUN_CHARS},}}(?:\.[A-Za-z0-9+/=_\-]+)*"
    rf"|(?<=[:=\s\"'`])(?<=[:=]\s{{0,3}}[\"'`]?)(?<=(?i:{KEY_WORDS})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"'`]?)[^\s\"'`,;]+"
)
#: Slots that path parts and neighbouring words are hashed to.
PATH_SLOTS, WORD_SLOTS = 32, 128
NUMBERS = ["f_length", "f_transition", "f_words", "f_digits", "f_upper", "f_hex"]
FEATURES = [*NUMBERS, "f_path", "f_near"]


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """doc_id, th, path, start (code points before it), value, before, after."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), text_of(text_col).alias("text"))
    base = base.filter(F.col("text").rlike(CANDIDATE)).dropDuplicates(["doc_id", "path", "text"])
    cut = base.select("doc_id", "path", F.xxhash64("text").alias("th"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"), F.split("text", CANDIDATE, -1).alias("gaps"))
    n = F.size("values")
    heads = F.transform(F.slice("gaps", F.lit(1), n), lambda g: F.right(g, F.lit(CONTEXT)))
    tails = F.transform(F.slice("gaps", F.lit(2), n), lambda g: F.left(g, F.lit(CONTEXT)))
    sizes = F.transform(F.slice("gaps", F.lit(1), n), lambda g: F.length(g))
    rows = cut.select("doc_id", "path", "th", F.posexplode(F.arrays_zip(F.col("values"), sizes.alias("sizes"), heads.alias("heads"), tails.alias("tails"))).alias("nth", "x"))
    before = Window.partitionBy("doc_id", "path", "th").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)  # of one document
    start = F.coalesce(F.sum(F.col("x.sizes") + F.length("x.values")).over(before), F.lit(0)) + F.col("x.sizes")
    return rows.select("doc_id", "th", "path", start.cast("long").alias("start"), F.col("x.values").alias("value"), F.col("x.heads").alias("before"), F.col("x.tails").alias("after"))


def word_statistics(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(pair, logp) of neighbouring characters and (part) of four letters, over the words of all documents in lower case."""
    words = docs.select(F.explode(F.split(F.lower(text_of(text_col)), r"[^\p{L}\p{N}]+")).alias("word")).filter(F.length("word").between(2, RUN_CHARS - 1))
    words = durable(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
    pairs = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("head", F.left("pair", F.lit(1)))
    heads = pairs.groupBy("head").agg(F.sum("n").alias("all"))
    logp = pairs.join(heads, "head").select("pair", F.log(F.col("n") / F.col("all")).alias("logp"))
    parts = words.filter(F.length("word") >= 4).select("n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 3), lambda i: F.substring(F.col("word"), i, F.lit(4))))).alias("part"))
    parts = parts.filter(~F.col("part").rlike("[0-9]")).groupBy("part").agg(F.sum("n").alias("n")).filter(F.col("n") >= OWN_WORDS).select("part")
    return logp, parts


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def _slots(parts: Column, n: int) -> Column:
    """Which of n slots the parts are hashed to, as an array of 0 and 1."""
    held = F.transform(parts, lambda w: F.pmod(F.xxhash64(w), F.lit(n)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array_contains(held, k.cast("long")).cast("double"))


def features(found: DataFrame, logp: DataFrame, parts: DataFrame) -> DataFrame:
    """found with the columns FEATURES. Equal values are looked at once, however often they occur."""
    found = found.withColumn("vid", F.md5("value"))  # n-grams go with the digest, not the whole value
    values = durable(found.select("vid", "value").distinct(), "secret-values")
    values = values.withColumn("c", F.split(F.lower("value"), ""))  # by character: a substring counts from the start of the text
    grams = lambda k: F.transform(F.sequence(F.lit(0), F.greatest(F.size("c") - k, F.lit(0))), lambda i: F.concat_ws("", *(F.get("c", i + j) for j in range(k))))
    steps = values.select("vid", F.explode(grams(2)).alias("pair")).join(logp, "pair", "left").groupBy("vid").agg(F.avg(F.coalesce("logp", F.lit(-12.0))).alias("f_transition"))
    pieces = values.select("vid", F.explode(grams(4)).alias("part")).join(parts.withColumn("own", F.lit(1.0)), "part", "left").groupBy("vid").agg(F.avg(F.coalesce("own", F.lit(0.0))).alias("f_words"))
    words = lambda text: F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    before, after = words(F.col("before")), words(F.col("after"))
    near = F.concat(F.slice(F.reverse(before), 1, 4), F.transform(F.slice(after, 1, 2), lambda w: F.concat(F.lit(">"), w)))
    path = F.array_union(F.array_remove(F.split(F.lower(F.coalesce("path", F.lit(""))), r"[/\\._\-]+"), ""), F.array(F.concat(F.lit("."), F.substring_index(F.lower(F.coalesce("path", F.lit(""))), ".", -1))))
    flag = lambda c: c.cast("double")
    return (
        found.join(steps.join(pieces, "vid"), "vid")
        .withColumn("f_length", flag(F.length("value")))
        .withColumn("f_digits", _share(F.col("value"), "[^0-9]"))
        .withColumn("f_upper", _share(F.col("value"), "[^A-Z]"))
        .withColumn("f_hex", flag(F.col("value").rlike("^[0-9a-f]+$")))
        .withColumn("f_path", _slots(path, PATH_SLOTS))
        .withColumn("f_near", _slots(near, WORD_SLOTS))
    )


def weak_labels(found: DataFrame) -> DataFrame:
    """value, before, after -> label, by syntax alone: 1 for a quoted value after a colon or equal sign, 0 for a run in plain text."""
    assigned, quoted = F.col("before").rlike(r"[:=]\s*[\"'`]$"), F.col("after").rlike("^[\"'`]")
    plain = F.col("before").rlike(r"(^|[\p{L}\p{N},.]\s+)$") & F.col("after").rlike(r"^([,.;]?\s|[,.;]?$)")
    return found.withColumn("label", F.when(assigned & quoted, 1.0).when(plain, 0.0))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, start, n_chars, value_sha256, score, is_secret: one row for each candidate of each distinct document.

    labelled: doc_id, start, label (0 or 1) of judged findings; of a finding judged twice the greatest label counts. Without it
    (None), weak_labels judges those it can. At most TRAINED
    findings of each class train the forest, the least by hash of value and place, so that the sample is the same in every run.
    Where a class has no labelled finding, no forest can be trained: the score is the share of the class that there is (0.5
    without any). Values are returned as hashes only. Null and empty texts have no candidates, a null path is a path of its
    own, and rows that repeat (id, path and text) count once. Other columns are not read. An empty table gives no rows.
    """
    found = durable(candidates(docs, id_col, text_col, path_col), "secret-candidates")
    logp, parts = word_statistics(docs, text_col)
    rows = features(found, logp, parts)
    rows = weak_labels(rows) if labelled is None else rows.join(labelled.select("doc_id", "start", F.col("label").cast("double").alias("label")).groupBy("doc_id", "start").agg(F.max("label").alias("label")), ["doc_id", "start"], "left")
    rows = durable(rows.select("doc_id", "th", "start", "value", "label", *FEATURES), "secret-features")
    sample = None
    for label in (0.0, 1.0):
        part = rows.filter(F.col("label") == label).orderBy(F.xxhash64("value", "doc_id", "start"), "doc_id", "start").limit(TRAINED)
        sample = part if sample is None else sample.unionByName(part)
    sample = durable(sample.select("label", *FEATURES), "secret-sample")
    seen = [r[0] for r in sample.select("label").distinct().collect()]
    if len(seen) == 2:
        to_vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        vectors = lambda df: to_vector.transform(df.withColumns({c: array_to_vector(c) for c in ("f_path", "f_near")}))
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7)
        scored = forest.fit(vectors(sample)).transform(vectors(rows)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = rows.withColumn("score", F.lit(float(seen[0]) if seen else 0.5))
    return scored.select(
        "doc_id", "start", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("is_secret")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE_SQL: dict[str, str] = {}
