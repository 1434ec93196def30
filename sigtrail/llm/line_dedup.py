"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded as hashes of their keys, the distinct documents of each hash are counted, and each document is put
together again by line position. Only hashes, ids and positions are shuffled until the texts meet the positions they lose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.llm.common import LOWER, SPACES, UPPER, durable, table, text_of


def line_key(line):
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that stays), one row for each row of docs.

    A key of at least min_chars code points in at least min_docs documents keeps its lines only in the largest id that holds
    it (all of them, should it repeat there). Documents are distinct ids; rows with a null id count together as one document,
    which is below any other. Null and empty texts have one empty line. Rows that repeat (id and text) get the same answer
    each. Other columns of docs are not read, so their names can't clash. An empty table gives no rows.
    Keys are compared by 128 bits of SHA-256.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    lines = F.split("text", "\n", -1)
    hashed = F.transform(lines, lambda x: F.when(F.length(line_key(x)) >= min_chars, F.unhex(F.substring(F.sha2(line_key(x), 256), 1, 32))))
    long_lines = (
        base.filter(F.length("text") >= min_chars)
        .select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(hashed).alias("pos", "h"))
        .filter("h is not null")
    )
    long_lines = durable(long_lines, "line-dedup")
    holders = long_lines.groupBy("h").agg(
        (F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n"), F.max("doc_id").alias("owner")
    )
    common = durable(holders.filter(F.col("n") >= min_docs).select("h", "owner"), "line-common")
    # Not a broadcast: the common lines grow with the corpus. A hash that a third of all rows hold makes one large partition
    # of long_lines, which the adaptive skew join splits: both sides are read from tables, and only partial lists follow.
    lost = (
        long_lines.hint("merge").join(common.hint("merge"), "h")
        .filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy("doc_id", "th").agg(F.collect_set("pos").alias("lost"))
        .select(F.col("doc_id").alias("lost_id"), F.col("th").alias("lost_th"), "lost")
    )
    all_docs = base.select("doc_id", "text", F.xxhash64("text").alias("th"))
    joined = all_docs.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("th") == F.col("lost_th")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return (
        joined.withColumn("lines", F.when(F.col("lost").isNotNull(), lines))
        .select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("size_lost"), F.col("lost"), kept.alias("kept"))
        .select("doc_id", "n_lines", F.when(F.col("lost").isNull(), F.lit(0).cast("long")).otherwise(F.col("size_lost")).alias("n_dropped"), "kept")
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}

ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, (c.key IS NOT NULL AND k.doc_id <> c.owner) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
