"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. The blocks are sorted, and each distinct block gets one integer
name; adjacent pairs of names are then sorted and named in the same way until one name is left of each document. Two
documents end with the same name at the same level only if their bytes are equal: names come from comparing contents in
sorted order, and the hash that leads the sort order only decides where equal blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sigtrail.llm.common import durable, partitions, small_batches, table, text_of

BLOCK_BYTES = 4096
#: Rows of one partition that can be numbered.
_SPAN = 1 << 36


def _local_names(carried: pa.Schema):
    """Number the distinct contents of a partition sorted by (h, content).

    Rows go on without the content. The contents of the first and the last hash of the partition follow as edge rows (rid
    null): only these can lie in a neighbouring partition too.
    """
    schema = pa.schema([*carried, ("local", pa.int64()), ("h", pa.int64()), ("content", pa.binary())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h = last = first_h = None
        local = -1
        first: list[tuple] = []
        group: list[tuple] = []
        for batch in batches:
            hs, contents = batch.column("h").to_pylist(), batch.column("content")
            names = []
            for k, h in enumerate(hs):
                content = contents[k].as_py()
                if h != last_h or content != last:
                    local += 1
                    if h != last_h:
                        if first_h is None:
                            first_h = h
                        elif last_h == first_h:
                            first = group
                        group = []
                    group.append((local, h, content))
                    last_h, last = h, content
                names.append(local)
            if n := len(hs):
                kept = [batch.column(f.name).cast(f.type) for f in carried]
                yield pa.record_batch([*kept, pa.array(names, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=schema)
        edges = first + group
        if n := len(edges):
            ends = [pa.array([e[i] for e in edges], f.type) for i, f in enumerate(list(schema)[-3:])]
            yield pa.record_batch([*(pa.nulls(n, f.type) for f in carried), *ends], schema=schema)

    return number


def name_contents(rows: DataFrame, label: str) -> DataFrame:
    """(rid, pos, others, content binary) -> (rid, pos, others, name long): equal contents, and only they, share a name.

    The rows are dealt by ranges of (hash, rid, pos), so that a content that a third of all rows hold is spread over many
    tasks. Where it spans partitions, the few contents at their ends are matched by content: at most the first and the last
    hash of each partition, which bounds what is broadcast.
    """
    n = max(2, partitions(rows.sparkSession))
    carried = rows.drop("content")
    dealt = (
        rows.withColumn("h", F.xxhash64("content"))
        .repartitionByRange(n, "h", "rid", "pos")
        .sortWithinPartitions("h", "content", "rid", "pos")
    )
    ends = T.StructType([T.StructField("local", T.LongType()), T.StructField("h", T.LongType()), T.StructField("content", T.BinaryType())])
    out_type = T.StructType([T.StructField(f.name, f.dataType) for f in carried.schema] + ends.fields)
    named = dealt.mapInArrow(_local_names(to_arrow_schema(carried.schema)), out_type)
    named = durable(named.withColumn("name", F.spark_partition_id().cast("long") * F.lit(_SPAN) + F.col("local")).drop("local"), label)
    spanning = named.filter("rid is null").groupBy("h", "content").agg(F.min("name").alias("canon"), F.collect_set("name").alias("names"))
    alias = spanning.filter(F.size("names") > 1).select(F.explode("names").alias("name"), "canon").filter("name <> canon")
    out = named.filter("rid is not null").drop("h", "content").join(F.broadcast(alias), "name", "left")
    return out.select(*carried.columns, F.coalesce("canon", "name").alias("name"))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Equal texts (byte for byte; null counts as empty) are one group and the largest id stays. Rows with a null id stay only
    where the whole group has none. Where the largest id itself repeats within a group, each of its rows is kept: they are
    the same document. Other columns are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    blob = F.encode("text", "UTF-8")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("long")
    rows = base.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", n_blocks.alias("n"), F.sha2("text", 256).alias("text_sha256"), blob.alias("blob")
    )
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.substring(F.col("blob"), (i * block_bytes + 1).cast("int"), F.lit(block_bytes)))
    blocks = rows.select("rid", "doc_id", "n", "text_sha256", F.posexplode(cut).alias("pos", "content"))
    first = F.col("pos") == 0
    blocks = blocks.select(
        "rid", F.col("pos").cast("long").alias("pos"), "n", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("text_sha256")).alias("text_sha256"), "content"
    )
    names = durable(name_contents(blocks, "exact-level0"), "exact-names")
    facts = names.filter("pos = 0").select("rid", "n", "doc_id", "text_sha256")
    done = names.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")
    open_ = names.filter("n > 1").select("rid", "pos", "name", "n")
    level, most = 0, facts.agg(F.max("n")).first()[0] or 1
    while most > 1:
        level += 1
        pairs = open_.groupBy("rid", (F.col("pos") / 2).cast("long").alias("pos"), ((F.col("n") + 1) / 2).cast("long").alias("n")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b")
        )
        content = F.encode(F.concat_ws(",", "a", F.coalesce("b", F.lit(-1))), "UTF-8")
        names = name_contents(pairs.select("rid", "pos", "n", content.alias("content")), f"exact-level{level}")
        done = done.unionByName(names.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        open_ = names.filter("n > 1").select("rid", "pos", "name", "n")
        most = (most + 1) // 2
    identity = durable(facts.drop("n").join(done, "rid").drop("rid"), "exact-identity")
    # Read from a table, so that the adaptive join can split the rows of a large group of copies.
    groups = durable(identity.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    out = identity.join(groups, ["level", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}

ORACLE_SQL = {
    "op8_exact_dedup": """
WITH g AS (
  SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d JOIN g ON coalesce(d.text, '') = g.t
""",
}
