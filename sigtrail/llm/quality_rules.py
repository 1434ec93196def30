"""Quality rules: counts within a document, and line frequency across the documents of a host.

Normalised lines are hashed, the distinct documents of each (host, line) are counted, lines above the host's limit are taken
out, and documents that this depletes are rejected. Texts are read once: what follows works on ids, counts and line hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrail.llm.common import LOWER, SPACES, UPPER, durable, small_batches, table, text_of

SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: A line is boilerplate of its host if at least MIN_DOCS of the host's texts and MIN_SHARE of them hold it.
MIN_DOCS, MIN_SHARE = 5, 0.05
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.5


def _repeated(text: bytes, width: int = 3) -> int:
    """Words in windows of width words that occur twice or more; windows are told apart exactly."""
    words = text.split()  # bytes split at ASCII white space only
    if len(words) <= width:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    windows, n = ids[: len(ids) - width + 1], len(names)
    for k in range(1, width):
        windows = np.unique(windows * n + ids[k : len(ids) - width + 1 + k], return_inverse=True)[1]
    twice = np.bincount(windows)[windows] > 1
    held = np.zeros(len(ids), bool)
    for k in range(width):
        held[k : k + len(windows)] |= twice
    return int(held.sum())


@F.pandas_udf(T.LongType())
def repeated_words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Words in 3-word windows found twice or more in their text, the first included."""
    for batch in texts:
        yield pd.Series([_repeated(t.encode("utf-8", "surrogatepass")) for t in batch], dtype="int64")


def line_key(line: Column) -> Column:
    """The line in lower case (A-Z), digits as 0, runs of ASCII white space as one space, none at its ends."""
    lowered = F.translate(line, UPPER + "123456789", LOWER + "0" * 9)
    return F.btrim(F.regexp_replace(lowered, SPACE_RUN, " "), F.lit(" "))


def n_words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space."""
    return F.when(F.length(F.btrim(text, F.lit(SPACES))) == 0, F.lit(0)).otherwise(F.size(F.split(F.btrim(text, F.lit(SPACES)), SPACE_RUN, -1))).cast("long")


def document_counts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, host, the counts of each document, th (128 bits of its text's hash) and lines (key hash, words), for each row."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text_of(text_col).alias("text"))
    bare = F.translate("text", SPACES, "")
    filled = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    short = lambda x: F.unhex(F.substring(F.sha2(x, 256), 1, 32))
    return base.select(
        "doc_id", "host", n_words(F.col("text")).alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(filled) - F.size(F.array_distinct(filled))).cast("long").alias("n_dup_lines"), repeated_words("text").alias("n_repeat_words"),
        short(F.col("text")).alias("th"), F.transform(filled, lambda x: F.struct(short(line_key(x)).alias("h"), n_words(x).alias("w"))).alias("lines"),
    )


def common_lines(counted: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, h, n): the lines above the host's limit, over (host, th, lines). Rows of one host with equal texts are one document.

    A line and a document meet in one row before they are counted, so that a line that a third of all rows hold is counted in
    parts. Each host has at most its mean number of lines over min_share.
    """
    held = counted.select("host", "th", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    lines = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    sizes = counted.select(F.col("host").alias("of_host"), "th").distinct().groupBy("of_host").agg(F.count(F.lit(1)).alias("n_texts"))
    return lines.join(sizes, F.col("host").eqNullSafe(F.col("of_host"))).filter(F.col("n") >= F.col("n_texts") * min_share).select("host", "h", "n")


def judge_documents(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, left_share: float = LEFT_SHARE
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_lines, n_left, depleted, kept.

    One row for each row of docs. n_common_lines and n_left: lines that are common on the host, and words outside them. A null
    or empty text has no word and fails the base rules. Rows of a null host are a host. Rows with equal texts on one host count
    as one document and get the same answer, also those that share an id or have none. A line at the limit is common (no ties
    to break). Other columns of docs are not read, so their names can't clash. An empty table gives no rows.
    """
    counted = durable(document_counts(docs, id_col, host_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "quality-counts", "zstd")
    common = durable(common_lines(counted, min_docs, min_share).select(F.col("host").alias("at_host"), F.col("h").alias("common")), "quality-common")
    # Both sides are read from tables and dealt by (host, line): the adaptive skew join splits the rows of a line that many share.
    lines = counted.select("rid", "host", F.explode("lines").alias("line")).select("rid", "host", "line.h", "line.w")
    lost = (
        lines.hint("merge").join(common.hint("merge"), (F.col("h") == F.col("common")) & F.col("host").eqNullSafe(F.col("at_host")))
        .groupBy("rid").agg(F.count(F.lit(1)).alias("n_common_lines"), F.sum("w").alias("lost"))
    )
    out = counted.drop("lines", "th").join(lost, "rid", "left").na.fill(0, ["n_common_lines", "lost"])
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    out = out.withColumn("n_left", F.col("n_words") - F.col("lost")).withColumn("depleted", F.col("n_left") < left_share * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", "n_common_lines", "n_left", "depleted", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op13_quality_rules": op13_quality_rules}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLE_SQL = {
    "op13_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT rid, {_WORDS.format("text")} AS w FROM d)),
windows AS (
  SELECT rid, pos, lead(pos, 2) OVER r IS NOT NULL AS whole, word AS a, lead(word, 1) OVER r AS b, lead(word, 2) OVER r AS c
  FROM words WINDOW r AS (PARTITION BY rid ORDER BY pos)),
twice AS (
  SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows WHERE whole) WHERE n > 1),
repeated AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, source, text, line, len({_WORDS.format("line")}) AS w,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS key
  FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE {_TRIM.format("line")} <> ''),
sizes AS (SELECT source, count(DISTINCT text) AS n_texts FROM d GROUP BY source),
common AS (
  SELECT l.source, l.key, count(DISTINCT l.text) AS n FROM lines l GROUP BY l.source, l.key),
limited AS (
  SELECT c.source, c.key FROM common c JOIN sizes s ON c.source IS NOT DISTINCT FROM s.source WHERE c.n >= {MIN_DOCS} AND c.n >= {MIN_SHARE} * s.n_texts),
lost AS (
  SELECT l.rid, count(*) AS n_common_lines, sum(l.w) AS w FROM lines l JOIN limited c ON l.key = c.key AND l.source IS NOT DISTINCT FROM c.source GROUP BY l.rid),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
counted AS (
  SELECT d.rid, d.doc_id, len({_WORDS.format("text")}) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         coalesce(x.n_common_lines, 0) AS n_common_lines, coalesce(x.w, 0)::BIGINT AS w
  FROM d LEFT JOIN dups u USING (rid) LEFT JOIN repeated r USING (rid) LEFT JOIN lost x USING (rid)),
judged AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed, n_words - w AS n_left, n_words - w < {LEFT_SHARE} * n_words AS depleted FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_lines, n_left, depleted, NOT base_failed AND NOT depleted AS kept FROM judged
""",
}
