"""Review of what was found: spans checked again, quotes repaired, comparisons with their evidence's strength, units on request."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a unit query may ask for, results and characters that it returns at most (limits are the feature: a bounded answer).
UNIT_QUERIES = ["definition", "calls", "callers", "strings", "neighbors"]
MAX_RESULTS, MAX_CONTENT = 8, 12_000


def check_spans(spans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """spans with ok: whether the bytes at [start, end) of the artifact have the recorded SHA-256. spans: artifact, start, end, sha256."""
    part = F.substring(F.col("content"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    joined = spans.join(artifacts.select("artifact", "content"), "artifact", "left")
    return joined.withColumn("ok", F.coalesce(F.sha2(part, 256) == F.col("sha256"), F.lit(False))).drop("content")


def strengths(comparisons: DataFrame, assessments: DataFrame) -> DataFrame:
    """comparisons with the strengths of their evidence: assessments with a common evidence id whose path begins the comparison's.

    Where no path fits, those with a common id alone count. The join is on exploded ids. comparisons: comparison_id, path,
    evidence. assessments: path, evidence, strength.
    """
    c = comparisons.select("comparison_id", F.col("path").alias("c_path"), F.explode(F.array_distinct("evidence")).alias("e"))
    a = assessments.select(F.col("path").alias("a_path"), "strength", F.explode(F.array_distinct("evidence")).alias("e"))
    hits = c.join(a, "e").select("comparison_id", "strength", F.startswith("c_path", F.col("a_path")).alias("fits")).distinct()
    sets = hits.groupBy("comparison_id").agg(F.collect_set(F.when(F.col("fits"), F.col("strength"))).alias("by_path"), F.collect_set("strength").alias("by_id"))
    chosen = F.sort_array(F.when(F.size("by_path") > 0, F.col("by_path")).otherwise(F.col("by_id")))
    out = comparisons.join(sets.select("comparison_id", chosen.alias("strengths")), "comparison_id", "left")
    none = F.array().cast("array<string>")
    weak = F.exists(F.coalesce("strengths", none), lambda s: s.isin("weak", "unknown"))
    return out.withColumn("strengths", F.coalesce("strengths", none)).withColumn("needs_review", weak | (F.size("strengths") == 0))


def association_status(targets: DataFrame, relations: DataFrame, least: float = 0.0) -> DataFrame:
    """artifact, n_related, best, status: why an artifact has or lacks associations.

    targets: artifact, has_profile. relations: a, b, score (null: not comparable), undirected.
    """
    both = relations.select(F.col("a").alias("artifact"), "score").unionByName(relations.select(F.col("b").alias("artifact"), "score"))
    sums = both.groupBy("artifact").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.count_if(F.col("score") > least).alias("n_related"), F.max("score").alias("best"))
    out = targets.join(sums, "artifact", "left")
    status = (
        F.when(~F.col("has_profile"), "no_features").when(F.col("n").isNull(), "no_relations").when(F.col("n_scored") == 0, "not_comparable")
        .when(F.col("n_related") == 0, "no_positive_match").otherwise("matched")
    )
    return out.select("artifact", F.coalesce("n_related", F.lit(0)).cast("long").alias("n_related"), "best", status.alias("status"))


def query_units(requests: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """request, kind, unit, content or reason: bounded answers to allowed questions about units.

    requests: request, kind, unit. units: unit, content. edges: src, kind, dst.
    """
    from sigtrail.operators.rules import capped

    asked = requests.withColumn("allowed", F.col("kind").isin(UNIT_QUERIES))
    denied = asked.filter("not allowed").select("request", "kind", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("content"), F.lit("not_allowed").alias("reason"))
    ok = asked.filter("allowed").select("request", "kind", F.col("unit").alias("of"))
    questions = ok.select("kind", "of").distinct()
    out = edges.select(F.lit("out").alias("way"), F.col("src").alias("of"), F.col("kind").alias("edge"), F.col("dst").alias("other"))
    back = edges.select(F.lit("back").alias("way"), F.col("dst").alias("of"), F.col("kind").alias("edge"), F.col("src").alias("other"))
    # The first of each kind hold the first of all kinds, so a unit with many edges is cut before the joins.
    first = capped(out.unionByName(back).distinct(), ["way", "of", "edge"], [F.col("other")], MAX_RESULTS)
    fits = (F.col("kind").isin("calls", "strings") & (F.col("way") == "out") & (F.col("edge") == F.col("kind"))) | ((F.col("kind") == "callers") & (F.col("way") == "back") & (F.col("edge") == "calls")) | (F.col("kind") == "neighbors")
    found = questions.filter("kind = 'definition'").withColumn("other", F.col("of")).unionByName(questions.join(first, "of").filter(fits).select("kind", "of", "other")).distinct()
    top = capped(found, ["kind", "of"], [F.col("other")], MAX_RESULTS).join(units.withColumnRenamed("unit", "other"), "other", "left")
    answers = top.select("kind", "of", F.col("other").alias("unit"), F.left("content", F.lit(MAX_CONTENT)).alias("content"), F.lit(True).alias("found"))
    told = ok.join(answers, ["kind", "of"], "left").select("request", "kind", "unit", "content", F.when(F.col("found").isNull(), "no_result").alias("reason"))
    return told.unionByName(denied)


def _repair(quote: str | None, text: str | None) -> str | None:
    if quote is None or text is None:
        return None
    if quote and quote in text:
        return quote
    words = quote.split()
    if not words:
        return None
    hits = {m.group() for m in re.finditer(r"\s+".join(map(re.escape, words)), text)}
    return hits.pop() if len(hits) == 1 else None


@F.pandas_udf(T.StringType())
def repair_quote(quote: pd.Series, text: pd.Series) -> pd.Series:
    """The quote as its text has it, if it differs in white space only and has one such form there; else null."""
    return pd.Series([_repair(q, t) for q, t in zip(quote, text, strict=True)])
