"""A corpus pipeline in five stages: language, exact copies, near copies, benchmark passages, token ids.

Each stage calls one operator on all documents that its predecessor kept and applies the decision. All stages but the last
return the columns of documents. run() writes each stage's rows to the folder in spark.checkpoint.dir and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.llm import decontaminate, exact_dedup, jaccard_join, language_id, piece_codec
from sigtrail.llm.common import durable, table, text_of


def _row_key(docs: DataFrame):
    """A row's id and the hash of its text: rows that share an id are judged apart, equal rows alike. A null id sorts last."""
    nullable = f"struct<no_id: boolean, id: {docs.schema['doc_id'].dataType.simpleString()}, text_hash: bigint>"  # as operators have rows without a key
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("text_hash")).cast(nullable)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key(docs).alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key isn't in gone (doc_id: a row key)."""
    return docs.join(gone.select(F.col("doc_id").alias("gone_key")).distinct(), _row_key(docs) == F.col("gone_key"), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, or no letter in it) go."""
    others = [c for c in docs.columns if c != "doc_id"]
    found = language_id.identify_language(docs, carry=others)
    return found.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays (one without an id only if none has one)."""
    gone = exact_dedup.dedup_exact(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.sha2(text_of(), 256) == F.col("gone_text")), "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the least id stays; of rows that share that id, one."""
    return _without(docs, jaccard_join.shingle_components(_keyed(docs)).filter(F.col("doc_id") != F.col("component_id")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return _without(docs, decontaminate.decontaminate(_keyed(docs), table(spark, sf_dir, "benchmark")).filter("contaminated"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return piece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}

#: SQL can't express the language model, nor the tokenizer: tests hold run() against brute force.
ORACLE_SQL: dict[str, str] = {}
