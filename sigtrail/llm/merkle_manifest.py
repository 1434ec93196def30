"""Merkle dataset manifest by parent-preimage paths.

Each row is a leaf; the leaves of a group (a source) form a tree, and the groups' roots form the tree of the dataset. For each
parent the concatenated digests of its children (its preimage) are stored. A leaf joins the preimages of its ancestors: with
its own 64-character slot cut out, a preimage gives the leaf's siblings, and with a replacement put into that slot it gives
the parent's new digest, so that a path both proves a leaf and folds a changed one up to the root.

Texts are read once and hashed where they lie; digests, ids and groups are all that is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtrail.llm.common import durable, partitions, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of one parent.
ARITY = 3
#: Levels that one round builds: a round's rows hold up to ARITY ** ROUND_LEVELS digests.
ROUND_LEVELS = 4
DIGEST = 64
_SPAN = ARITY**ROUND_LEVELS


def leaf_digest(*fields: Column) -> Column:
    """H of the fields in order: `-` for null, else UTF-8 byte count, colon, value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts += [F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))]
    return F.sha2(F.concat(*parts), 256)


def _ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """rows with pos (from 0) and n (the group's size): places within each group by order, and by row where that ties.

    The rows are dealt by ranges of (group, order, row), so that a large group, and even equal rows, spread over many tasks; a
    table of counts for each range and group gives what lies before.
    """
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), group, *order, "_row")
    dealt = dealt.sortWithinPartitions(group, *order, "_row").drop("_row").withColumn("_at", F.monotonically_increasing_id())
    dealt = durable(dealt, f"{label}-sorted", "zstd").withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy(F.col("_part").alias("_in_part"), F.col(group).alias("_of_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_of_group").orderBy("_in_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_of_group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("_in_part", "_of_group", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_c").over(whole).alias("n"))
    out = dealt.join(starts, (F.col("_part") == F.col("_in_part")) & F.col(group).eqNullSafe(F.col("_of_group")))
    return out.withColumn("pos", F.col("_at") + F.col("_start")).drop("_at", "_part", "_in_part", "_of_group", "_start")


def _preimages(digests: Column) -> Column:
    """The digests of each run of ARITY siblings, joined."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.array_join(F.slice(digests, i * ARITY + 1, ARITY), ""))


def _round(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, digest) -> one row for each run of _SPAN nodes: tree, block, n, pre (one array of preimages a level), top.

    Levels end where the whole tree has one node left, so that a last run of one node is hashed as long as others remain.
    """
    kids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
    out = nodes.groupBy("tree", F.expr(f"pos div {_SPAN}").alias("block"), "n").agg(kids.alias("d0")).withColumn("left0", F.col("n"))
    for k in range(1, ROUND_LEVELS + 1):
        below, open_ = F.col(f"d{k - 1}"), F.col(f"left{k - 1}") > 1
        out = out.withColumn(f"p{k}", F.when(open_, _preimages(below)))
        out = out.withColumn(f"d{k}", F.when(open_, F.transform(f"p{k}", lambda p: F.sha2(p, 256))).otherwise(below))
        out = out.withColumn(f"left{k}", F.when(open_, F.expr(f"(left{k - 1} + {ARITY - 1}) div {ARITY}")).otherwise(F.col(f"left{k - 1}")))
    levels = F.filter(F.array(*(f"p{k}" for k in range(1, ROUND_LEVELS + 1))), lambda p: p.isNotNull())
    return out.select("tree", "block", "n", levels.alias("pre"), F.get(f"d{ROUND_LEVELS}", F.lit(0)).alias("top"), F.col(f"left{ROUND_LEVELS}").alias("remain"))


def _parents(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The rounds of parents over nodes (tree, pos, n, digest), from the nodes' own to the last, each as a table."""
    rounds = []
    while True:
        done = durable(_round(nodes), f"{label}-parents", "zstd")
        rounds.append(done)
        nodes = done.filter("remain > 1").select("tree", F.col("block").alias("pos"), F.col("remain").alias("n"), F.col("top").alias("digest"))
        if nodes.isEmpty():
            return rounds


def _own_path() -> Column:
    """The preimages of a node's ancestors in its block (lowest first), each with the node's slot in it."""
    at = F.col("pos") % _SPAN
    step = lambda pre, k: F.struct(
        F.get(pre, F.floor(at / F.pow(F.lit(ARITY), k + 1)).cast("int")).alias("preimage"), (F.floor(at / F.pow(F.lit(ARITY), k)) % ARITY).cast("int").alias("slot")
    )
    return F.transform("pre", step)


def _with_paths(nodes: DataFrame, rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """nodes (tree, pos, ...) with path: the preimages of all ancestors, lowest first. above: what follows for each tree (tree, path, ...)."""
    named = [c for c in above.columns if c not in ("tree", "path")]
    at = None
    for k in reversed(range(len(rounds))):
        # A round's last blocks of a tree go on with the path of the tree, all others with that of their node in the round above.
        ends = rounds[k].filter("remain = 1").select("tree", "block").join(above, "tree")
        higher = ends if at is None else ends.unionByName(at.select("tree", F.col("pos").alias("block"), "path", *named))
        blocks = rounds[k].select("tree", "block", "pre").join(higher, ["tree", "block"]).withColumnRenamed("path", "_above")
        if k:
            kids = rounds[k - 1].filter("remain > 1").select("tree", F.col("block").alias("pos"))
        else:
            kids = nodes
        at = kids.withColumn("block", F.expr(f"pos div {_SPAN}")).join(blocks, ["tree", "block"]).withColumn("path", F.concat(_own_path(), "_above")).drop("block", "pre", "_above")
        if k:
            at = durable(at, "merkle-paths", "zstd")
    return at


def build_manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """order, group, pos, leaf, subroot, root, path, and the columns of carry: one row for each row of docs.

    path holds the preimages from the leaf's parent to the root, each with the slot (from 0) on the way; `siblings` and `fold`
    read it. A group's leaves ascend by order (nulls first); rows that tie there ascend by their leaves. Rows that repeat are
    leaves of their own. Rows of a null group are a group, which comes first. A lone leaf is its subroot, a lone subroot is the
    root. Nulls in any field and texts of any length have a leaf. Columns of docs that aren't named are not read, so their names
    can't clash. An empty table gives no rows. carry's expressions are of columns of docs, computed as its rows are read.
    """
    carry = carry or {}
    extra = [e.alias(f"_carry{k}") for k, e in enumerate(carry.values())]
    rows = docs.select(F.col(order).alias("_order"), F.col(group).alias("_group"), leaf_digest(*(F.col(f) for f in fields)).alias("leaf"), *extra)
    leaves = durable(_ranked(rows, "_group", ["_order", "leaf"], "merkle-leaves"), "merkle-leaves", "zstd")
    sizes = leaves.groupBy(F.col("_group").alias("_g")).agg(F.max("n").alias("leaves"))
    groups = durable(_ranked(sizes.withColumn("_all", F.lit(0)), "_all", ["_g"], "merkle-groups").select("_g", F.col("pos").alias("tree"), F.col("n").alias("n_groups")), "merkle-groups")
    nodes = durable(leaves.join(groups, F.col("_group").eqNullSafe(F.col("_g"))).drop("_g", "n_groups"), "merkle-nodes", "zstd")
    rounds = _parents(nodes.select("tree", "pos", "n", F.col("leaf").alias("digest")), "merkle-group")
    subroots = rounds[0].filter("remain = 1")
    for r in rounds[1:]:
        subroots = subroots.unionByName(r.filter("remain = 1"))
    subroots = durable(subroots.select("tree", F.col("top").alias("subroot")).join(groups, "tree").select(F.lit(0).alias("root_tree"), F.col("tree").alias("pos"), F.col("n_groups").alias("n"), "subroot"), "merkle-subroots")
    upper = _parents(subroots.select(F.col("root_tree").alias("tree"), "pos", "n", F.col("subroot").alias("digest")), "merkle-root")
    root = upper[-1].filter("remain = 1").select("tree", F.col("top").alias("root"), F.array().cast("array<struct<preimage: string, slot: int>>").alias("path"))
    above = _with_paths(subroots.select(F.col("root_tree").alias("tree"), "pos", "subroot"), upper, root)
    above = durable(above.select(F.col("pos").alias("tree"), "subroot", "root", "path"), "merkle-above", "zstd")
    out = _with_paths(nodes, rounds, above)
    back = [F.col(f"_carry{k}").alias(name) for k, name in enumerate(carry)]
    return out.select(F.col("_order").alias(order), F.col("_group").alias(group), "pos", "leaf", "subroot", "root", "path", *back)


def siblings(path: str | Column = "path") -> Column:
    """The siblings' digests from the leaf to the root, each level's from left to right, as one string."""
    cut = lambda p: F.concat(_left(p), _right(p))
    return F.array_join(F.transform(path, cut), "")


def fold(leaf: str | Column, path: str | Column = "path") -> Column:
    """The root that follows from a leaf's digest and the siblings of path."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda h, p: F.sha2(F.concat(_left(p), h, _right(p)), 256))


def _left(p: Column) -> Column:
    return F.substring(p["preimage"], F.lit(1), p["slot"] * DIGEST)


def _right(p: Column) -> Column:
    return F.substring(p["preimage"], p["slot"] * DIGEST + (DIGEST + 1), F.lit(ARITY * DIGEST))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what it says where every other document (by crc32 of its id) lost its line breaks."""
    damaged = leaf_digest(*(F.col(f) for f in FIELDS[:-1]), F.translate("text", "\n", ""))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, damaged)
    rows = build_manifest(table(spark, sf_dir, "documents"), carry={"tampered": tampered})
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(f) for f in FIELDS)
_BAD = " || ".join(_FIELD.format(f) for f in (*FIELDS[:-1], "replace(text, chr(10), '')"))
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

ORACLE_SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_LEAF}) AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN sha256({_BAD}) END AS bad FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
lower_(tree, lev, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM lower_ WHERE n > 1 GROUP BY tree, lev, pos // 3, n),
subroots AS (SELECT tree, h AS subroot FROM lower_ WHERE n = 1),
upper_(lev, pos, n, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots
  UNION ALL
  SELECT lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_ WHERE n > 1 GROUP BY lev, pos // 3, n),
nodes AS (
  SELECT tree AS t, 0 AS stage, lev, pos, h FROM lower_ WHERE n > 1
  UNION ALL SELECT -1, 1, lev, pos, h FROM upper_ WHERE n > 1),
levels AS (SELECT DISTINCT t, stage, lev FROM nodes),
slots AS (
  SELECT p.tree, p.pos, l.t, l.stage, l.lev, (CASE l.stage WHEN 0 THEN p.pos ELSE p.tree END) // (3 ** l.lev)::BIGINT AS x
  FROM placed p JOIN levels l ON l.t = p.tree OR l.stage = 1),
steps AS (
  SELECT s.tree, s.pos, row_number() OVER (PARTITION BY s.tree, s.pos ORDER BY s.stage, s.lev) AS step,
         coalesce(string_agg(d.h, '' ORDER BY d.pos) FILTER (WHERE d.pos < s.x), '') AS lo, coalesce(string_agg(d.h, '' ORDER BY d.pos) FILTER (WHERE d.pos > s.x), '') AS hi
  FROM slots s JOIN nodes d ON d.t = s.t AND d.lev = s.lev AND d.pos // 3 = s.x // 3 GROUP BY s.tree, s.pos, s.stage, s.lev),
folds(tree, pos, step, h) AS (
  SELECT tree, pos, 0, coalesce(bad, leaf) FROM placed
  UNION ALL
  SELECT f.tree, f.pos, s.step, sha256(s.lo || f.h || s.hi) FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step + 1),
proofs AS (SELECT tree, pos, sha256(string_agg(lo || hi, '' ORDER BY step)) AS proof FROM steps GROUP BY tree, pos)
SELECT p.doc_id, p.leaf, r.subroot, (SELECT h FROM upper_ WHERE n = 1) AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = (SELECT h FROM upper_ WHERE n = 1) AS verified
FROM placed p JOIN subroots r USING (tree) LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos
JOIN (SELECT tree, pos, arg_max(h, step) AS h FROM folds GROUP BY tree, pos) f ON f.tree = p.tree AND f.pos = p.pos
""",
}
