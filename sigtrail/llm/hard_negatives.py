"""Hard-negative mining by distributed radix selection.

Anchors meet all rows in tiles of a block of anchors and a block of rows. For each window of scores (first the anchor's whole
range, for its positives; then one window for each anchor and positive) every tile counts scores by digit, the counts are
summed, and the digit that holds the k-th score becomes the next, finer range, until it is one score. Only rows at or above
that score are gathered then. Vectors never leave their tile: what is shuffled back are counts and qualifying rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtrail.llm.common import durable, table

SCALE = 256
#: Values of one digit of a score.
RADIX = 1024
#: Anchors and rows of a tile.
TILE = 4096
#: Scores that a task holds at once.
_AT_ONCE = 1 << 20
#: Up to here a sum of products of integers is exact in doubles.
_EXACT, _LARGEST = 2**53, 2**61

_WINDOW = "array<struct<w: int, lo: bigint, hi: bigint, cut: bigint, width: bigint>>"


def scaled(vector: str | Column) -> Column:
    """The integer components, floor(SCALE * x) with x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def _whole(vector: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def prepare(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """rid, id, label, q, norm of the rows that take part, as a table; q has the length of the longest vector, zeros last."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    base = base.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & _whole("vector")).select("id", "label", scaled("vector").alias("q"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return durable(base.withColumn("norm", norm).withColumn("rid", F.monotonically_increasing_id()), "mine-rows", "zstd")


def _tiled(df: DataFrame, key: str, block: str, other: int, n_blocks: int) -> DataFrame:
    """df in n_blocks blocks by key, each once for every block of the other side."""
    own = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    other_name = "row_block" if block == "anchor_block" else "anchor_block"
    return df.withColumn(block, own).withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))


def _matrix(column: pa.ChunkedArray, exact: bool) -> np.ndarray:
    flat = column.combine_chunks()
    values = (flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64 if exact else np.int64)


def _scores(left: pa.Table, right: pa.Table, exact: bool) -> Iterator[tuple[slice, np.ndarray]]:
    """Integer scores of slices of anchors with all rows of the tile."""
    if left.num_rows and right.num_rows:
        a, b = _matrix(left["q"], exact), _matrix(right["q"], exact)
        step = max(1, _AT_ONCE // len(b))
        for k in range(0, len(a), step):
            yield slice(k, k + step), np.asarray(a[k : k + step] @ b.T, np.int64)


def _open(left: pa.Table, right: pa.Table, exact: bool, same: bool) -> Iterator[tuple[int, list[dict], np.ndarray, np.ndarray]]:
    """For each anchor of a tile: its place, its windows, and the scores and ids of the rows that may be in them."""
    ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
    anchor_ids, anchor_labels, windows = left["anchor_id"].to_numpy(), left["anchor_label"].to_numpy(), left["windows"].to_pylist()
    for rows, scores in _scores(left, right, exact):
        for k, line in enumerate(scores, rows.start):
            mine = windows[k]
            least, most = min(w["cut"] for w in mine), max(w["hi"] for w in mine)
            at = np.nonzero((line >= least) & (line <= most))[0]
            at = at[(labels[at] == anchor_labels[k]) & (ids[at] != anchor_ids[k])] if same else at[labels[at] != anchor_labels[k]]
            if len(at):
                yield k, mine, line[at], ids[at]


_COUNTS = "aid long, w int, digit long, n long"
_FOUND = "aid long, w int, id long, score long"


def _count_digits(exact: bool, same: bool, k_best: int) -> Callable:
    """Counts by digit of the scores in each window's open range: of the highest digits that hold the tile's first k scores."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        aids = left["aid"].to_numpy()
        for k, windows, scores, _ in _open(left, right, exact, same):
            for w in windows:
                if w["lo"] < w["hi"]:
                    inside = scores[(scores >= w["lo"]) & (scores <= w["hi"])]
                    digits, n = np.unique((inside - w["lo"]) // w["width"], return_counts=True)
                    least = max(0, len(n) - 1 - int(np.searchsorted(np.cumsum(n[::-1]), k_best)))
                    out += [(aids[k], w["w"], d, c) for d, c in zip(digits[least:].tolist(), n[least:].tolist(), strict=True)]
        return _as_table(out, ("aid", "w", "digit", "n"))

    return count


def _gather(exact: bool, same: bool, k_best: int) -> Callable:
    """Rows at or above each window's k-th score, a tile's first k_best at most: more can't be among the first k_best of all."""

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        aids = left["aid"].to_numpy()
        for k, windows, scores, ids in _open(left, right, exact, same):
            for w in windows:
                at = np.nonzero((scores >= w["cut"]) & (scores <= w["hi"]))[0]
                at = at[np.lexsort((ids[at], -scores[at]))[:k_best]]
                out += [(aids[k], w["w"], i, s) for i, s in zip(ids[at].tolist(), scores[at].tolist(), strict=True)]
        return _as_table(out, ("aid", "w", "id", "score"))

    return gather


def _as_table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = {"w": pa.int32()}
    return pa.table([pa.array([r[k] for r in rows], kinds.get(name, pa.int64())) for k, name in enumerate(names)], names=list(names))


def _in_tiles(anchors: DataFrame, windows: DataFrame, rows: DataFrame, sizes: tuple[int, int], work: Callable, schema: str) -> DataFrame:
    packed = windows.groupBy("aid").agg(F.collect_list(F.struct("w", "lo", "hi", "cut", "width")).cast(_WINDOW).alias("windows"))
    n_anchor, n_row = sizes
    left = _tiled(anchors.join(packed, "aid"), "aid", "anchor_block", n_row, n_anchor).groupBy("anchor_block", "row_block")
    right = _tiled(rows.select("rid", "id", "label", "q"), "rid", "row_block", n_anchor, n_row).groupBy("anchor_block", "row_block")
    return left.cogroup(right).applyInArrow(work, schema)


def _select(anchors: DataFrame, windows: DataFrame, rows: DataFrame, sizes: tuple[int, int], exact: bool, same: bool, k_best: int) -> DataFrame:
    """aid, w, id, score, rank: the first k_best rows of each window (aid, w, lo, hi), by higher score, then lower id."""
    ranges = windows.select("aid", "w", "lo", F.col("hi").alias("top"), "hi", F.lit(k_best).cast("long").alias("k"))
    span = windows.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    while span > 1:
        # The digit of the k-th score of each window; a window with fewer scores is taken whole.
        ranges = durable(ranges.withColumn("width", F.expr(f"(hi - lo) div {RADIX} + 1")), "mine-ranges")
        counts = _in_tiles(anchors, ranges.withColumn("cut", F.col("lo")), rows, sizes, _count_digits(exact, same, k_best), _COUNTS)
        counts = durable(counts.groupBy("aid", "w", "digit").agg(F.sum("n").alias("n")), "mine-counts")
        down = Window.partitionBy("aid", "w").orderBy(F.col("digit").desc())
        reached = counts.withColumn("above", F.sum("n").over(down) - F.col("n")).join(ranges.select("aid", "w", "k"), ["aid", "w"])
        held = reached.filter((F.col("above") < F.col("k")) & (F.col("above") + F.col("n") >= F.col("k"))).select("aid", "w", "digit", "above")
        stepped = ranges.join(held, ["aid", "w"], "left")
        lo = F.col("lo") + F.col("digit") * F.col("width")
        done = F.col("digit").isNull()  # too few scores, or settled: the range's lower end stays the least score that qualifies
        ranges = stepped.select(
            "aid", "w", F.when(done, F.col("lo")).otherwise(lo).alias("lo"), "top", F.when(done, F.col("lo")).otherwise(F.least("hi", lo + F.col("width") - 1)).alias("hi"),
            F.when(done, F.col("k")).otherwise(F.col("k") - F.col("above")).alias("k"),
        )
        ranges, span = durable(ranges, "mine-ranges"), -(-span // RADIX)
    final = ranges.select("aid", "w", "lo", F.col("top").alias("hi"), F.col("lo").alias("cut"), F.lit(1).cast("long").alias("width"))
    found = _in_tiles(anchors, final, rows, sizes, _gather(exact, same, k_best), _FOUND)
    order = Window.partitionBy("aid", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k_best)


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", tile: int = TILE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: a condition on `id`.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no part. A shorter vector counts as
    followed by zeros. An anchor's positives are its first other rows of its label; negatives have another label and four fifths
    of the positive's score at least, and the positive's score at most (so a negative score has none). Higher scores come first,
    ties by lower id. Rows that share the anchor's id are no other rows; otherwise rows that repeat count as often as they
    occur, each repeated anchor as an anchor of its own. Pairs without a negative give no row; an empty table gives none. Other
    columns are not read, so their names can't clash. Scores that don't fit into 64 bits raise ValueError.
    """
    rows = prepare(rows, id_col, label_col, vector_col)
    anchors = rows.filter(is_anchor)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("dim"), F.max("norm").alias("norm"), F.sum(is_anchor.cast("long")).alias("anchors")).first()
    dim, norm = facts["dim"] or 0, facts["norm"] or 0.0
    if norm * norm * 1.001 + 1 >= _LARGEST:
        raise ValueError("scores of these vectors don't fit into 64 bits")
    exact = norm * norm * 1.001 + 1 < _EXACT
    sizes = max(1, -(-(facts["anchors"] or 0) // tile)), max(1, -(-facts["n"] // tile))
    padded = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(max(dim, 1)) - F.size("q"))))
    left = padded.filter(is_anchor).select(F.col("rid").alias("aid"), F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), "q", "norm")
    left = durable(left, "mine-anchors", "zstd")
    reach = F.ceil(F.col("norm") * norm * 1.0001).cast("long") + 1  # no score is beyond the product of the norms
    whole = left.select("aid", F.lit(0).alias("w"), (-reach).alias("lo"), reach.alias("hi"))
    left = left.drop("norm")
    positives = durable(_select(left, whole, padded, sizes, exact, True, n_positives), "mine-positives")
    pairs = positives.filter("score >= 0").select("aid", F.col("rank").alias("w"), F.expr("score - score div 5").alias("lo"), F.col("score").alias("hi"))
    negatives = _select(left, pairs, padded, sizes, exact, False, n_negatives)
    named = positives.select("aid", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(named, ["aid", "w"])
    ids = anchors.select(F.col("rid").alias("aid"), F.col("id").alias("anchor_id"))
    return out.join(ids, "aid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return mine_hard_negatives(rows, F.col("id") % 100 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}

ORACLE_SQL = {
    "op12_hard_negatives": f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, a.label = r.label AS same, r.rid, r.vec_id,
         list_sum(list_transform(range(1, least(len(a.q), len(r.q)) + 1), lambda i: a.q[i] * r.q[i]))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id, rid) AS p FROM scored WHERE same QUALIFY p <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.aid, p.p ORDER BY n.score DESC, n.vec_id, n.rid) AS rank
  FROM positives p JOIN scored n ON n.aid = p.aid AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
""",
}
