"""Profiles, pair scores and clusters of artifacts.

A score that is null means not comparable; 0 means compared without a match. Candidate pairs come from equi-joins on shared
facts, on bands of hashes, or on language, never from all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.functions import scalars as S
from sigtrail.operators.store import written

# Weights of facts and of the three groups, and limits of prompt matches.
FACT_WEIGHTS = {"vendor": 1.0, "family": 1.5, "model": 2.0, "sdk": 1.0, "sdk_vendor": 1.0, "endpoint": 1.5, "service": 1.5, "ai_cli": 1.0}
GROUP_WEIGHTS = {"toolchain": 0.5, "prompt": 0.3, "code_style": 0.2}
MAX_DISTANCE, CONTENT_SHARE, STRUCTURE_SHARE = 8, 0.8, 0.2
THRESHOLD = 0.45
BANDS = MAX_DISTANCE + 1
#: Hashes of a tile; tiles at least, so that small inputs spread; hashes of both sides that are compared at once, so that all stays in a core's cache.
TILE, LEAST_TILES, STRIP, WIDTH = 32_768, 12, 16, 4096


def tool_facts(evidence: DataFrame, key: str = "artifact") -> DataFrame:
    """key, fact, weight: each fact of an artifact once. evidence: key, kind, value."""
    weight = F.create_map(*(x for k, w in FACT_WEIGHTS.items() for x in (F.lit(k), F.lit(w))))
    kept = evidence.filter(S.meaningful(F.col("value")) & F.col("kind").isin(*FACT_WEIGHTS))
    fact = F.concat("kind", F.lit(":"), F.lower(F.trim("value")))
    return kept.groupBy(key, fact.alias("fact")).agg(F.max(weight[F.col("kind")]).alias("weight"))


def jaccard_pairs(facts: DataFrame, key: str = "artifact") -> DataFrame:
    """a, b (a < b), score, n_common of all pairs with a common fact, by weighted Jaccard.

    Artifacts with the same facts are one class: classes are compared, and pairs are between them; a class with itself scores 1.
    The union's weight is the sum of both totals less the common weight, so only common facts are joined. Classes are written, so
    that facts are found once, however often classes are read.
    """
    profile = facts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("fact", "weight"))).alias("p"))
    classes = written(profile.groupBy("p").agg(F.min(key).alias("c")), "classes")
    own = classes.select("c", F.inline("p"))
    total = own.groupBy("c").agg(F.sum("weight").alias("t"))
    left, right = own.select(F.col("c").alias("a"), "fact", F.col("weight").alias("wa")), own.select(F.col("c").alias("b"), "fact", F.col("weight").alias("wb"))
    common = left.join(right, "fact").filter("a < b").groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("both"), F.count(F.lit(1)).alias("n_common"))
    ta, tb = total.select(F.col("c").alias("a"), F.col("t").alias("ta")), total.select(F.col("c").alias("b"), F.col("t").alias("tb"))
    return common.join(ta, "a").join(tb, "b").select("a", "b", (F.col("both") / (F.col("ta") + F.col("tb") - F.col("both"))).alias("score"), "n_common")


def fact_classes(facts: DataFrame, key: str = "artifact") -> DataFrame:
    """key, representative: the least artifact with the same facts."""
    profile = facts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("fact", "weight"))).alias("p"))
    least = profile.groupBy("p").agg(F.min(key).alias("representative"))
    return profile.join(least, "p").select(key, "representative")


def simhash_pairs(hashes: DataFrame, value: str = "simhash") -> DataFrame:
    """a, b (values, a < b), distance of distinct hashes at most MAX_DISTANCE apart; hash 0 is no hash.

    64 bits are cut into MAX_DISTANCE + 1 bands: two hashes that near share a band, so the join on bands loses none. A pair
    counts in the first band that it shares, so pairs aren't shuffled again; the adaptive skew join splits hot band values.
    """
    distinct = hashes.filter(F.col(value) != 0).select(F.col(value).alias("v")).distinct()
    edges = np.linspace(0, 64, BANDS + 1).astype(int)
    bands = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("v", int(a)).bitwiseAND((1 << int(b - a)) - 1).alias("bits")) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    rows = distinct.select("v", F.inline(F.array(*bands)))
    left, right = rows.select(F.col("v").alias("a"), "k", "bits"), rows.select(F.col("v").alias("b"), "k", "bits")
    differs = F.col("a").bitwiseXOR(F.col("b"))
    shared = [F.when(F.shiftrightunsigned(differs, int(a)).bitwiseAND((1 << int(b - a)) - 1) == 0, k) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    near = left.join(right, ["k", "bits"]).filter((F.col("a") < F.col("b")) & (S.hamming(F.col("a"), F.col("b")) <= MAX_DISTANCE) & (F.coalesce(*shared) == F.col("k")))
    return near.select("a", "b", S.hamming(F.col("a"), F.col("b")).cast("int").alias("distance"))


def simhash_links(hashes: DataFrame, value: str = "simhash") -> DataFrame:
    """value, n_links (long): for each distinct hash, how many others are at most MAX_DISTANCE apart; 0 and null are no hashes.

    Where texts share their words, links grow with the square of the hashes, and so does any list of them or of candidates from
    bands. Hashes are dealt to tiles of about TILE; each pair of tiles is a row of two arrays that one task compares as bits, in
    strips, and only counts leave it. Work is the square of the distinct hashes at some ns a pair; memory is bounded by a tile.
    """
    distinct = written(hashes.filter(F.col(value) != 0).select(F.col(value).alias("v")).distinct(), "distinct-hashes")
    n = max(LEAST_TILES, -(-distinct.count() // TILE))
    tiles = written(distinct.groupBy(F.pmod(F.xxhash64("v"), F.lit(n)).alias("t")).agg(F.collect_list("v").alias("v")), "hash-tiles")
    left = tiles.select(F.col("t").alias("i"), F.explode(F.sequence(F.col("t"), F.lit(n - 1).cast("long"))).alias("j"), F.col("v").alias("a"))
    right = tiles.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("t"))).alias("i"), F.col("t").alias("j"), F.col("v").alias("b"))
    pairs = left.join(right.hint("merge"), ["i", "j"])
    # Few bytes but much work: the number of tasks is given, as the size of the rows says nothing of it.
    counted = pairs.repartition(min(n * (n + 1) // 2, 4096)).mapInArrow(_count_links, "v long, n long")
    found = counted.groupBy("v").agg(F.sum("n").alias("n"))
    return distinct.join(found, "v", "left").select(F.col("v").alias(value), F.coalesce("n", F.lit(0)).alias("n_links"))


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = (np.asarray(batch[c][k].values).view(np.uint64) for c in ("a", "b"))
            same = batch["i"][k] == batch["j"][k]
            of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            for at in range(0, len(a), STRIP):
                for to in range(0, len(b), WIDTH):
                    near = np.bitwise_count(a[at : at + STRIP, None] ^ b[to : to + WIDTH]) <= MAX_DISTANCE
                    if near.any():
                        of_a[at : at + STRIP] += np.count_nonzero(near, axis=1)
                        if not same:
                            of_b[to : to + WIDTH] += near.view(np.uint8).sum(0, dtype=np.uint8)
            if same:
                of_a -= 1  # itself
            values, counts = np.concatenate([a, b]).view(np.int64), np.concatenate([of_a, of_b])
            yield pa.RecordBatch.from_arrays([values[counts > 0], counts[counts > 0]], names=["v", "n"])


def content_score(distance: Column, same_scope: Column, exact: Column) -> Column:
    """Score of two prompts: 1 for equal texts, less by Hamming distance, 0 beyond the limit or of different completeness."""
    near = F.when(distance <= MAX_DISTANCE, 0.95 * (1 - distance / 16)).otherwise(0.0)
    return F.when(~same_scope, 0.0).when(exact, 1.0).otherwise(F.coalesce(near, F.lit(0.0)))


def prompt_score(content: Column, structure: Column) -> Column:
    """Content and structure together; structure alone counts little; null if neither is comparable."""
    return F.when(content.isNull(), STRUCTURE_SHARE * structure).when(structure.isNull(), content).otherwise(CONTENT_SHARE * content + STRUCTURE_SHARE * structure)


def metric_score(metrics_a: Column, metrics_b: Column, least: int = 3) -> Column:
    """Mean similarity of two maps of metrics: one-sided ones count 0, shared zeros don't count; null under least comparable ones."""
    both = F.map_values(F.map_zip_with(metrics_a, metrics_b, lambda _, x, y: F.struct(x.alias("x"), y.alias("y"))))
    shared = F.filter(both, lambda v: v["x"].isNotNull() & v["y"].isNotNull() & ~((v["x"] == 0) & (v["y"] == 0)))
    single = F.filter(both, lambda v: v["x"].isNull() | v["y"].isNull())
    total = F.aggregate(shared, F.lit(0.0), lambda s, v: s + F.least(v["x"], v["y"]) / F.greatest(v["x"], v["y"]))
    return F.when(F.size(shared) >= least, total / (F.size(shared) + F.size(single)))


def fuse(toolchain: Column, prompt: Column, code: Column, weights: dict[str, float] | None = None) -> Column:
    """Struct overall, coverage, conditional: a missing group contributes 0; all null where nothing is comparable."""
    w = weights or GROUP_WEIGHTS
    all_ = sum(w.values())
    parts = [(toolchain, w["toolchain"] / all_), (prompt, w["prompt"] / all_), (code, w["code_style"] / all_)]
    score = sum((F.coalesce(c, F.lit(0.0)) * x for c, x in parts), F.lit(0.0))
    coverage = sum((F.when(c.isNotNull(), F.lit(x)).otherwise(0.0) for c, x in parts), F.lit(0.0))
    some = coverage > 0
    return F.struct(F.when(some, score).alias("overall"), coverage.alias("coverage"), F.when(some, score / coverage).alias("conditional"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the least node reachable. Each turn joins parents to least neighbours and contracts."""
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        parent = written(parent, "parents")
        parent = written(parent.join(parent.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up")), "parents")
        step = parent.select(F.col("node").alias("component"), "up")
        labels = parent.select("node", F.col("up").alias("component")) if labels is None else written(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        ua, ub = parent.select(F.col("node").alias("a"), F.col("up").alias("x")), parent.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = written(edges.join(ua, "a").join(ub, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def average_linkage(names: list[str], scores: dict[tuple[str, str], float], threshold: float = THRESHOLD) -> list[int]:
    """Cluster numbers by average linkage over distance 1 - score; ties merge the least names first."""
    n = len(names)
    at = {x: k for k, x in enumerate(names)}
    d = np.ones((n, n))
    for (a, b), s in scores.items():
        d[at[a], at[b]] = d[at[b], at[a]] = max(0.0, 1 - s)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    while alive.sum() > 1:
        flat = int(np.argmin(d))
        i, j = divmod(flat, n)
        if not d[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        alive[j] = False
    return label.tolist()


def merged_neighbours(nodes: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """artifact, head (the least member of its cluster): average linkage in rounds of joins, without a matrix.

    nodes: node, head; pairs: a < b, score. The state is the sum of scores between clusters that have any (pairs that aren't
    there score 0) and the clusters' sizes. Each round merges all pairs of clusters that are each other's nearest, in the order
    (mean score, least names). Average linkage never brings a merged cluster nearer than its parts were, so these merges are
    those of one-by-one clustering with the same order, whatever else is merged in the round.
    """
    heads = written(nodes.select(F.col("node").alias("artifact"), "head"), "heads")
    sums = written(pairs.groupBy("a", "b").agg(F.max("score").alias("s")), "sums")
    while True:
        sizes = heads.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
        for end in ("a", "b"):
            sums = sums.join(sizes.select(F.col("head").alias(end), F.col("n").alias(f"n{end}")), end)
        near = written(sums.withColumn("mean", F.round(F.col("s") / (F.col("na") * F.col("nb")), 12)).filter(F.col("mean") > 1 - threshold), "near")
        ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "mean", "a", "b")
        best = ends.groupBy("e.x").agg(F.min_by(F.struct("a", "b"), F.struct(-F.col("mean"), "a", "b")).alias("p"))
        chosen = written(best.groupBy("p").count().filter(F.col("count") == 2).select("p.a", "p.b"), "chosen")
        if chosen.isEmpty():
            return heads
        up = chosen.select(F.col("b").alias("old"), F.col("a").alias("new"))
        heads = written(heads.join(up, F.col("head") == F.col("old"), "left").select("artifact", F.coalesce("new", "head").alias("head")), "heads")
        sums = sums.select("a", "b", "s")
        for end in ("a", "b"):
            sums = sums.join(up.select(F.col("old").alias(end), "new"), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
        sums = written(sums.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")), "sums")


def cluster(nodes: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, largest: int = 2000, linked: DataFrame | None = None) -> DataFrame:
    """artifact, cluster (C- and a hash of its least member), size: average linkage within each component of pairs nearer than threshold.

    A merge needs a cross pair below the threshold, so clusters lie within components, and components are clustered apart: those
    of at most `largest` members in one task each, larger ones by merged_neighbours, with the same clusters. linked: the components,
    where they are known. pairs are read several times: give a table, not what it takes long to find.
    """
    if linked is None:
        linked = components(pairs.filter(F.col("score") > 1 - threshold).select("a", "b"))
    sized = written(linked.join(linked.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component"), "linked")
    inside = pairs.join(sized.select(F.col("node").alias("a"), F.col("component").alias("ca"), "members"), "a").join(sized.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    inside = inside.filter("ca = cb").select(F.col("ca").alias("component"), "members", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        labels = average_linkage(names, {(a, b): s for a, b, s in zip(pdf["a"], pdf["b"], pdf["score"], strict=True)}, threshold)
        return pd.DataFrame({"artifact": names, "head": [names[k] for k in labels]})

    grouped = inside.filter(F.col("members") <= largest).groupBy("component").applyInPandas(run, "artifact string, head string")
    large = sized.filter(F.col("members") > largest)
    if not large.isEmpty():
        grouped = grouped.unionByName(merged_neighbours(large.select("node", F.col("node").alias("head")), inside.filter(F.col("members") > largest).select("a", "b", "score"), threshold))
    heads = nodes.select("artifact").join(grouped, "artifact", "left").withColumn("head", F.coalesce("head", "artifact"))
    sizes = heads.groupBy("head").agg(F.min("artifact").alias("least"), F.count(F.lit(1)).alias("size"))
    return heads.join(sizes, "head").select("artifact", F.concat(F.lit("C-"), F.substring(F.sha2("least", 256), 1, 12)).alias("cluster"), "size")


def numbered(clusters: DataFrame) -> DataFrame:
    """clusters with label C001 ... by least member: for reports of few clusters, as the numbers are one global order."""
    from pyspark.sql import Window

    least = clusters.groupBy("cluster").agg(F.min("artifact").alias("least"))
    return clusters.join(least.select("cluster", F.format_string("C%03d", F.row_number().over(Window.orderBy("least"))).alias("label")), "cluster")
