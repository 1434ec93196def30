"""Exact Jaccard self-join of word-shingle sets, answered by components, with set-relation skipping.

Index: only the least few shingles of a set (its prefix, in an order that puts frequent shingles last) are dealt out, in
packed blocks. An index list is ordered by set size and read in blocks; a block is skipped whole if the best position in it
leaves too few shingles for the required overlap. Prefixes are k(n) - 1 shingles longer than one common shingle asks for, so
that two sets that link meet in at least k lists; sets with fewer possible meetings leave the index.

Answers: sets of one list are not compared all with all. A pivot of each list is compared first; sets that link to it share
its component, and what is known of the pivot answers for them: two sets in one component need no comparison, and
|x & y| <= |r & y| + |x - r| rules out y for a set x near the pivot r. What is left after a few rounds of pivots (pairs
in different components that no bound rules out) is compared pair by pair, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrail.llm.common import bucketed, durable, partitions, small_batches, table, text_of
from sigtrail.llm.components import components
from sigtrail.llm.shingles import set_check, set_id, shingle_sets

WIDTH, PERCENT = 5, 75
#: Shingles whose frequency orders them last; all others are ordered by hash. Any order gives the same links.
FREQUENT = 1 << 19
#: Shingles counted together in a task, postings sent together, and postings of one bucket at most, about.
COUNTED, SENT, BUCKET = 2_000_000, 500_000, 2_000_000
#: Postings of lists that still span components, compared in one task, about; a pair that meets in many lists is found once there.
CROSS = 50_000
#: Bits of the filter that chooses whose sets are fetched for comparison; it lets through all that are needed.
FILTER_BITS = 1 << 26
PIVOTS = 2
#: A set of n shingles meets each set that it links with in at least 1 + n // MEETINGS lists (of the smaller one's n).
MEETINGS = 32
BLOCK = 256
#: Pairs of one pivot that are compared in one task, about.
PART = 256

#: Bits of a set's identity, and identities of several sets that the driver can take: of 10^10 sets, about three.
ID_BITS, CLASHES = 64, 1 << 20

_POSTING = np.dtype([("h", "<u8"), ("s", "<i8"), ("n", "<u4"), ("p", "<u4")])
_U = np.uint64


def needed(n, m, percent: int):
    """Least overlap of sets of n and m shingles that link."""
    return -(-percent * (n + m) // (100 + percent))


def meetings(n):
    """k(n): never more than the least overlap of a set of n with any other."""
    return 1 + n // MEETINGS


def _profiles(width: int, id_type: pa.DataType, bits: int):
    """Per text its set's id, check and size (h null); and shingles that occur twice or more among the new sets of a run (n null)."""
    names = ["doc_id", "sid", "check", "n", "h", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        total = 0

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts > 1].view(np.int64), counts[counts > 1]
            n = len(values)
            return pa.record_batch([pa.nulls(n, id_type), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.array(values), pa.array(counts, pa.int64())], names=names)

        for batch in batches:
            ids, checks, ns = [], [], []
            for _, bounds, hashes in shingle_sets(batch.column("text"), width):
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own = hashes[a:b]
                    ids.append(set_id(own) >> (64 - bits))
                    checks.append(set_check(own))
                    ns.append(len(own))
                    if (ids[-1], checks[-1]) not in seen:
                        seen.add((ids[-1], checks[-1]))
                        held.append(own)
                        total += len(own)
                if total >= COUNTED:
                    yield frequent()
                    held, total = [], 0
            n = len(ids)
            yield pa.record_batch([batch.column("doc_id").cast(id_type), pa.array(ids, pa.int64()), pa.array(checks, pa.int64()), pa.array(ns, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
        if held:
            yield frequent()

    return run


def _identity(hashes: np.ndarray, clashes: set[int], bits: int) -> int:
    """The set's id, or its check where several sets have that id."""
    sid = set_id(hashes) >> (64 - bits)
    return set_check(hashes) if sid in clashes else sid


def _postings(frequent, clashes, bits: int, buckets: int, width: int, percent: int):
    """The prefixes of the sets, packed by bucket; a set that comes again within the task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = frequent.value
        several = clashes.value
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            rows = np.concatenate(held)
            at = (rows["h"] % _U(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
            packed = [rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.record_batch([pa.array(at[cuts[:-1]]), pa.array(packed, pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            for _, bounds, hashes in shingle_sets(batch.column("text"), width):
                sizes = np.diff(bounds)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sids = np.zeros(len(sizes), np.int64)
                use = np.zeros(len(sizes), bool)
                for k in np.flatnonzero(sizes):
                    sids[k] = sid = _identity(hashes[bounds[k] : bounds[k + 1]], several, bits)
                    if sid not in seen:
                        seen.add(sid)
                        use[k] = True
                key = hashes >> _U(1)
                if len(values):
                    place = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
                    key = np.where(values[place] == hashes, ranks[place] | _U(1 << 63), key)
                order = np.lexsort((hashes, key, owner))
                position = np.arange(len(hashes)) - np.repeat(bounds[:-1], sizes)
                prefix = sizes - -(-percent * sizes // 100) + meetings(sizes)
                mask = use[owner] & (position < prefix[owner])
                rows = np.empty(int(mask.sum()), _POSTING)
                rows["h"], rows["s"], rows["n"], rows["p"] = hashes[order][mask], sids[owner[mask]], sizes[owner[mask]], position[mask]
                held.append(rows)
            if sum(map(len, held)) >= SENT:
                yield send()
                held = []
        if sum(map(len, held)):
            yield send()

    return run


def _blocks(n: np.ndarray, rest: np.ndarray, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of blocks of a list ordered by n that may hold a pair with enough overlap; the others are skipped whole."""
    edges = [*range(0, len(n), BLOCK), len(n)]
    best = [int(rest[a:b].max()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for i in range(len(best)):
        a, b = edges[i], edges[i + 1]
        for j in range(i, len(best)):
            c, d = edges[j], edges[j + 1]
            if percent * int(n[c]) > 100 * int(n[b - 1]):
                break
            if min(best[i], best[j]) >= needed(int(n[a]), int(n[c]), percent):
                yield a, b, c, d


def _possible(n: np.ndarray, rest: np.ndarray, a: int, b: int, c: int, d: int, percent: int) -> np.ndarray:
    """Which pairs of two blocks pass by size and position."""
    least = needed(n[a:b, None], n[None, c:d], percent)
    out = (np.minimum(rest[a:b, None], rest[None, c:d]) >= least) & (np.minimum(n[a:b, None], n[None, c:d]) * 100 >= percent * np.maximum(n[a:b, None], n[None, c:d]))
    if a == c:
        out &= ~np.eye(b - a, dtype=bool)
    return out


def _lists(percent: int):
    """The postings of a bucket that have a possible partner in their list."""

    def run(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(x.as_py() for x in group.column("packed")), _POSTING)
        rows = rows[np.lexsort((rows["s"], rows["n"], rows["h"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["s"][1:] != rows["s"][:-1])
        rows = rows[new]
        cuts = np.flatnonzero(np.concatenate(([True], rows["h"][1:] != rows["h"][:-1], [True])))
        keep = np.zeros(len(rows), bool)
        n = rows["n"].astype(np.int64)
        rest = n - rows["p"] + meetings(n) - 1
        length = np.diff(cuts)
        two = cuts[:-1][length == 2]
        good = (np.minimum(rest[two], rest[two + 1]) >= needed(n[two], n[two + 1], percent)) & (n[two] * 100 >= percent * n[two + 1])
        keep[two[good]] = keep[two[good] + 1] = True
        for k in np.flatnonzero(length > 2):
            a0, b0 = cuts[k], cuts[k + 1]
            found = np.zeros(b0 - a0, bool)
            for a, b, c, d in _blocks(n[a0:b0], rest[a0:b0], percent):
                if found[a:b].all() and found[c:d].all():
                    continue
                hit = _possible(n[a0:b0], rest[a0:b0], a, b, c, d, percent)
                found[a:b] |= hit.any(1)
                found[c:d] |= hit.any(0)
            keep[a0:b0] = found
        rows = rows[keep]
        columns = [pa.array(rows["h"].view(np.int64) if rows["h"].flags["C_CONTIGUOUS"] else np.ascontiguousarray(rows["h"]).view(np.int64)), *(pa.array(rows[c].astype(np.int64)) for c in ("s", "n", "p"))]
        return pa.table(columns, names=["h", "s", "n", "p"])

    return run


def _sets(passing, clashes, bits: int, width: int):
    """Sets whose ids pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, several = passing.value, clashes.value
        seen: set[int] = set()
        for batch in batches:
            for _, bounds, hashes in shingle_sets(batch.column("text"), width):
                ids, sets = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    if b > a and (sid := _identity(hashes[a:b], several, bits)) not in seen and all(int(words[i >> 6]) >> (i & 63) & 1 for i in _bits(sid)):
                        seen.add(sid)
                        ids.append(sid)
                        sets.append(hashes[a:b].view(np.int64))
                if ids:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "members"])

    return run


def _bits(sid: int) -> tuple[int, int]:
    return sid & (FILTER_BITS - 1), (sid >> 32) & (FILTER_BITS - 1)


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids: FILTER_BITS bits, made by aggregates; the driver gets its words."""
    both = F.explode(F.array(F.col("s").bitwiseAND(FILTER_BITS - 1), F.shiftright("s", 32).bitwiseAND(FILTER_BITS - 1)))
    words = ids.select(both.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("value").to_numpy().astype(np.int64).view(np.uint64)
    return out


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb) with the size of the intersection. A pivot with many pairs is dealt to several tasks, each with its set."""
    pairs = durable(pairs, "join-pairs")
    many = durable(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).filter("parts > 1"), "join-parts")
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0).cast("long"))
    dealt = pairs.join(many, "a", "left").select("a", "b", "na", "nb", part.alias("part"))
    left, right = sets.select(F.col("sid").alias("a"), F.col("members").alias("ma")), sets.select(F.col("sid").alias("b"), F.col("members").alias("mb"))
    pivots = dealt.select("a", "part").distinct().hint("merge").join(left, "a")
    both = dealt.hint("merge").join(right, "b").hint("merge").join(pivots, ["a", "part"])
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("ma", "mb")).cast("long").alias("ov"))


def _may(percent: int, n1: str, p1: str, n2: str, p2: str):
    """Size and position filter of two postings as a column: a linked pair passes it at the first shingle that it shares."""
    return F.expr(f"least({n1} - {p1}, {n2} - {p2}) * {100 + percent} >= {percent} * ({n1} + {n2}) AND least({n1}, {n2}) * 100 >= {percent} * greatest({n1}, {n2})")


def _cross_pairs(percent: int):
    """Pairs of a bucket's lists in different components that no block, position or pivot bound rules out."""

    def run(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("s").to_numpy(), group.column("n").to_numpy(), group.column("h").to_numpy()))
        h, s, n, p, c, r, ov = (group.column(x).to_numpy()[order] for x in ("h", "s", "n", "p", "c", "r", "ov"))
        rest = n - p  # at the first shingle that a linked pair shares, what is left is enough
        cuts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        found: list[np.ndarray] = []
        for a0, b0 in zip(cuts[:-1], cuts[1:], strict=True):
            at = slice(a0, b0)
            if b0 - a0 < 2 or (c[at] == c[a0]).all():
                continue
            ln, lrest, lc, lr, lov, ls = n[at], rest[at], c[at], r[at], ov[at], s[at]
            for a, b, e, d in _blocks(ln, lrest, percent):
                if (lc[a:b] == lc[a]).all() and (lc[e:d] == lc[a]).all():
                    continue
                hit = _possible(ln, lrest, a, b, e, d, percent) & (lc[a:b, None] != lc[None, e:d])
                same = (lr[a:b, None] == lr[None, e:d]) & (lov[a:b, None] >= 0) & (lov[None, e:d] >= 0)
                bound = np.minimum(lov[None, e:d] + (ln - lov)[a:b, None], lov[a:b, None] + (ln - lov)[None, e:d])
                hit &= ~same | (bound >= needed(ln[a:b, None], ln[None, e:d], percent))
                i, j = np.nonzero(np.triu(hit, 1) if a == e else hit)
                x, y = ls[a:b][i], ls[e:d][j]
                nx, ny = ln[a:b][i], ln[e:d][j]
                first = x < y
                found.append(np.stack([np.where(first, x, y), np.where(first, y, x), np.where(first, nx, ny), np.where(first, ny, nx)]))
        out = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((4, 0), np.int64)
        return pa.table([pa.array(np.ascontiguousarray(x)) for x in out], names=["a", "b", "na", "nb"])

    return run


def _links(percent: int):
    return F.col("ov") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))


def shingle_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of width-word shingles; component_id is the
    least id reachable by links. A document without words links with nothing and is its own component; a null id never names
    a component unless it stands alone. Rows that repeat are documents of their own with equal sets. Other columns are not
    read. An empty table gives no rows. Shingles are compared by 64-bit hashes, sets by 128 bits: where several sets
    have one 64-bit identity, each takes another.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_field = T.StructField("doc_id", base.schema["doc_id"].dataType)  # rows of shingle counts have none
    from pyspark.sql.pandas.types import to_arrow_type

    profile_type = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in ("sid", "check", "n", "h", "c"))])
    profiles = durable(base.mapInArrow(_profiles(width, to_arrow_type(id_field.dataType), ID_BITS), profile_type), "join-profiles")
    facts = profiles.filter("n is not null").select("doc_id", "sid", "check", "n")
    same = facts.filter("n > 0").groupBy("sid").agg((F.min("check") < F.max("check")).alias("several")).filter("several").select("sid")
    several = {row.sid for row in same.limit(CLASHES + 1).collect()}
    if len(several) > CLASHES:
        raise ValueError(f"more than {CLASHES} identities stand for several sets: there are too many sets for {ID_BITS} bits")
    if several:
        shared = F.broadcast(spark.createDataFrame([(x,) for x in several], "shared long"))
        facts = facts.join(shared, F.col("sid") == F.col("shared"), "left").withColumn("sid", F.when(F.col("shared").isNotNull() & (F.col("n") > 0), F.col("check")).otherwise(F.col("sid"))).drop("shared")
    facts = facts.drop("check")
    clashes = spark.sparkContext.broadcast(several)

    often = durable(profiles.filter("n is null").groupBy("h").agg(F.sum("c").alias("c")).withColumn("level", F.floor(F.log2("c") * 8)), "join-often")
    # The highest levels of frequency that hold at most FREQUENT shingles: the driver gets a few hundred counts, then those.
    least, room = 1 << 30, FREQUENT
    for row in sorted(often.groupBy("level").count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    chosen = often.filter(F.col("level") >= least).select("h", "c").toArrow()
    values, counts = chosen.column("h").to_numpy().astype(np.int64).view(np.uint64), chosen.column("c").to_numpy()
    by_count = np.lexsort((values, counts))
    ranks = np.empty(len(values), np.uint64)
    ranks[by_count] = np.arange(len(values), dtype=np.uint64)
    by_value = np.argsort(values)
    frequent = spark.sparkContext.broadcast((values[by_value], ranks[by_value]))

    total = facts.agg(F.sum(F.expr(f"n - (({percent} * n + 99) div 100) + 1"))).first()[0] or 0
    buckets = max(partitions(spark), math.ceil(total / BUCKET))
    packed = base.mapInArrow(_postings(frequent, clashes, ID_BITS, buckets, width, percent), "bucket long, packed binary")
    lists = durable(packed.groupBy("bucket").applyInArrow(_lists(percent), "h long, s long, n long, p long"), "join-lists")
    enough = lists.groupBy("s").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n"))
    enough = durable(enough.filter(F.expr(f"met >= 1 + ({percent} * n + 99) div 100 div {MEETINGS}")).select("s", (F.col("met") / F.col("n")).alias("share")), "join-met")
    lists = durable(lists.join(enough, "s"), "join-index")

    passing = spark.sparkContext.broadcast(_filter_words(enough.select("s")))
    fetched = base.mapInArrow(_sets(passing, clashes, ID_BITS, width), "sid long, members array<bigint>").groupBy("sid").agg(F.first("members").alias("members"))
    sets = bucketed(fetched, "sid", "join_sets")

    labels = spark.createDataFrame([], "node long, label long")
    compared = spark.createDataFrame([], "a long, b long, na long, nb long, ov long")

    def merged(labels: DataFrame, overlaps: DataFrame) -> DataFrame:
        """The components after more overlaps are known."""
        edges = overlaps.filter(_links(percent)).select("a", "b")
        for end in ("a", "b"):
            edges = edges.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left").withColumn(end, F.coalesce(f"{end}_label", end)).drop(f"{end}_label")
        more = components(edges)
        old = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        return durable(old.unionByName(more.join(labels, "node", "left_anti")), "join-labels")

    def labelled(lists: DataFrame) -> DataFrame:
        return lists.join(labels.select(F.col("node").alias("s"), F.col("label").alias("c")), "s", "left").withColumn("c", F.coalesce("c", "s"))

    for turn in range(PIVOTS):
        # A set that meets others in the largest share of its shingles has the least of its own: it is the middle of its group.
        done = compared.select(F.col("a").alias("s")).distinct().withColumn("used", F.lit(1))
        current = labelled(lists).join(done, "s", "left")
        rank = F.struct(F.coalesce("used", F.lit(0)), -F.col("share"), F.xxhash64("s"))
        pivot = current.groupBy("h").agg(F.min_by(F.struct("s", "n", "p", "c"), rank).alias("r"), (F.min("c") < F.max("c")).alias("open"))
        pivot = pivot.filter("open").select("h", F.col("r.s").alias("rs"), F.col("r.n").alias("rn"), F.col("r.p").alias("rp"), F.col("r.c").alias("rc"))
        pairs = current.join(pivot, "h").filter(F.col("c") != F.col("rc")).filter(_may(percent, "n", "p", "rn", "rp"))
        pairs = pairs.select(F.col("rs").alias("a"), F.col("s").alias("b"), F.col("rn").alias("na"), F.col("n").alias("nb")).distinct()
        seen = compared.select("a", "b").unionByName(compared.select(F.col("b").alias("a"), F.col("a").alias("b")))
        overlaps = durable(_overlaps(pairs.join(seen, ["a", "b"], "left_anti"), sets), f"join-pivots{turn}")
        compared = compared.unionByName(overlaps)
        labels = merged(labels, overlaps)

    known = compared.groupBy("b").agg(F.max_by(F.struct("a", "ov"), F.struct("ov", "a")).alias("k")).select(F.col("b").alias("s"), F.col("k.a").alias("r"), F.col("k.ov").alias("ov"))
    current = labelled(lists)
    open_lists = current.groupBy("h").agg((F.min("c") < F.max("c")).alias("open")).filter("open").select("h")
    rows = current.join(open_lists, "h").join(known, "s", "left").select("h", "s", "n", "p", "c", F.coalesce("r", "s").alias("r"), F.coalesce("ov", F.lit(-1).cast("long")).alias("ov"))
    rows = durable(rows, "join-open")
    tasks = max(1, math.ceil(rows.count() / CROSS))
    left = rows.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(tasks))).groupBy("bucket").applyInArrow(_cross_pairs(percent), "a long, b long, na long, nb long").distinct()
    seen = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    overlaps = durable(_overlaps(left.join(seen, ["a", "b"], "left_anti"), sets), "join-rest")
    labels = merged(labels, overlaps)

    own = facts.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    own = durable(own.select("doc_id", "n", F.when(F.col("n") > 0, F.col("label")).alias("label")), "join-members")
    # Read from a table, so that the adaptive join can split the rows of a large component.
    least_ids = durable(own.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least_id")), "join-least")
    out = own.join(least_ids, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least_id", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLE_SQL = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, hash(g) AS g FROM (SELECT doc_id, unnest(s) AS g FROM s)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * c >= 75 * (len(sa.s) + len(sb.s) - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN m ON node = doc_id
""",
}
