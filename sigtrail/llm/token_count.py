"""Token counts with overlap resynchronisation.

A text of at most chunk_chars is encoded whole. A longer one is cut into overlapping chunks, which are encoded apart, with
offsets, on as many tasks. Neighbouring chunks are spliced at a position where both have a token boundary that no context
can move: white space after another character. The splitter that comes before merging has no look-behind, so
what follows such a position doesn't depend on what precedes it; its only look-ahead is within white space, so what precedes
doesn't depend on what follows; and no special token holds white space. All this is looked up in the tokenizer: with another
splitter, a normalizer or such tokens, long texts are encoded whole. Where no such boundary lies in an overlap, the
document is done again with a wider one, and at last whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from sigtrail.llm.common import durable, partitions, slices, small_batches, table, text_of

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: The overlap is widened by this factor, WIDENINGS times; then documents are encoded whole.
WIDEN, WIDENINGS = 16, 2
#: Characters encoded in one call, which bounds a worker's memory.
CALL_CHARS = 1_000_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def proven(path: str) -> bool:
    """Whether boundaries at white space are stable: the byte-level splitter, no normalizer, added tokens that leave white space alone."""
    facts = json.loads(_tokenizer(path).to_str())
    splitter = facts.get("pre_tokenizer") or {}
    byte_level = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space", True)
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in facts.get("added_tokens") or [])
    return bool(byte_level and apart and facts.get("normalizer") is None)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            counts: list[int] = []
            for _, texts in slices(batch.column("text").to_pylist(), CALL_CHARS):
                counts += [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def stable_boundaries(text: str, starts: list[int], begin: int, end: int) -> list[tuple[int, int]]:
    """(position, tokens before it) of the boundaries in [begin, end) at ASCII white space after what isn't white space in any sense."""
    found = []
    for count, p in enumerate(starts):
        if begin <= p < end and p > 0 and text[p] in " \t\n\r" and not text[p - 1].isspace():
            found.append((p, count))
    return found


_CHUNKS = pa.schema([("dk", pa.string()), ("chunk", pa.int64()), ("n_chunks", pa.int64()), ("start", pa.int64()), ("overlap", pa.int64()), ("text", pa.string())])
_CHUNKS_DDL = "dk string, chunk long, n_chunks long, start long, overlap long, text string"


def _cut(chunk_chars: int, overlap: int):
    """Texts -> chunks of chunk_chars and the overlap after each; chunk_chars 0: one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dk, text in zip(batch.column("dk").to_pylist(), batch.column("text").to_pylist(), strict=True):
                size = chunk_chars or len(text)
                n = -(-len(text) // size)
                for k in range(n):
                    row = [[dk], [k], [n], [k * size], [overlap], [text[k * size : (k + 1) * size + overlap]]]
                    yield pa.record_batch([pa.array(v, f.type) for v, f in zip(row, _CHUNKS, strict=True)], schema=_CHUNKS)

    return run


_ENCODED = T.StructType(
    [T.StructField("dk", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("chunk", "n_chunks", "n")]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("left_pos", "left_n", "right_pos", "right_n")]
)


def _encode_chunks(path: str, chunk_chars: int):
    """Tokens of each chunk, and its stable boundaries in the overlaps with its neighbours, by position in the document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            at = 0
            for _, texts in slices([r["text"] for r in rows], CALL_CHARS):
                for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                    r, at = rows[at], at + 1
                    starts = [s for s, _ in e.offsets]
                    left = stable_boundaries(text, starts, 0, r["overlap"]) if r["chunk"] else []
                    right = stable_boundaries(text, starts, chunk_chars, len(text)) if r["chunk"] + 1 < r["n_chunks"] else []
                    lists = [[p + r["start"] for p, _ in left], [n for _, n in left], [p + r["start"] for p, _ in right], [n for _, n in right]]
                    out.append([r["dk"], r["chunk"], r["n_chunks"], len(starts), *lists])
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _spliced(encoded: DataFrame) -> DataFrame:
    """dk, n_tokens: null where two neighbours have no common stable boundary."""
    w = Window.partitionBy("dk").orderBy("chunk")
    at = F.array_min(F.array_intersect("right_pos", F.lead("left_pos").over(w)))
    nth = lambda values, positions: F.element_at(values, F.array_position(positions, F.col("at")).cast("int"))
    rows = encoded.select("*", at.alias("at"), F.lead("left_pos").over(w).alias("next_pos"), F.lead("left_n").over(w).alias("next_n"))
    here = F.when(F.col("chunk") + 1 == F.col("n_chunks"), F.col("n")).when(
        F.col("at").isNotNull(), nth(F.col("right_n"), F.col("right_pos")) - nth(F.col("next_n"), F.col("next_pos"))
    )
    return rows.select("dk", here.alias("here")).groupBy("dk").agg(F.when(F.count(F.lit(1)) == F.count("here"), F.sum("here")).alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs.

    Null counts as empty: no tokens. Special strings inside texts are the special tokens that the library makes of them by
    default; none is added. Rows that repeat, and null ids, get a row each. Other columns are not read. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = T.StructType([base.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = base.filter(F.length("text") <= chunk_chars).mapInArrow(_count(tokenizer_path), schema)
    long = base.filter(F.length("text") > chunk_chars).withColumn("dk", F.sha2("text", 256))

    done, todo, overlap = None, long.select("dk", "text"), overlap_chars
    for turn in range(0 if proven(tokenizer_path) else WIDENINGS + 1, WIDENINGS + 2):
        size = chunk_chars if turn <= WIDENINGS else 0
        chunks = todo.mapInArrow(_cut(size, overlap if size else 0), _CHUNKS_DDL).repartition(partitions(spark), "dk", "chunk")
        encoded = durable(chunks.mapInArrow(_encode_chunks(tokenizer_path, size), _ENCODED), "token-chunks").dropDuplicates(["dk", "chunk"])
        spliced = durable(_spliced(encoded), "token-splices")
        good = spliced.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = spliced.filter("n_tokens is null").select("dk")
        if failed.isEmpty():
            break
        todo, overlap = long.join(failed, "dk", "left_semi").select("dk", "text"), min(overlap * WIDEN, chunk_chars)
    counted = counted.unionByName(long.select("doc_id", "n_bytes", "dk").join(done, "dk").select("doc_id", "n_bytes", "n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op3_token_count": op3_token_count}
ORACLE_SQL: dict[str, str] = {}
