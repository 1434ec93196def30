"""Typed comparison of an event's report with an artifact, and the gates on report facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.functions import scalars as S

#: Relations of a comparison, in their order.
RELATIONS = ["supports", "contradicts", "complements", "inconclusive"]


def compare_models(report: DataFrame, sample: DataFrame, links: DataFrame) -> DataFrame:
    """event, artifact, model, relation, sample_value, review: one row for each model of an event and each linked artifact.

    report: event, pos, model (the first row of each canonical model counts). sample: artifact, pos, model. links: event,
    artifact, method. Another model contradicts only where the artifact is linked by its hash.
    """
    first = Window.partitionBy("event", S.model_key(F.col("model"))).orderBy("pos")
    asked = report.filter(S.meaningful(F.col("model"))).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    rows = asked.join(links, "event").join(sample.select("artifact", F.col("pos").alias("s_pos"), F.col("model").alias("s_model")), "artifact", "left")
    kind = S.models_match(F.col("s_model"), F.col("model"))
    ranked = rows.groupBy("event", "artifact", "model", "method").agg(
        F.min_by(F.struct("s_model", kind.alias("kind")), F.when(kind != "none", F.col("s_pos"))).alias("hit"), F.min_by("s_model", "s_pos").alias("other"), F.count("s_model").alias("n")
    )
    matched = F.col("hit.kind").isNotNull()
    against = (F.col("n") > 0) & (F.col("method") == "sha256_exact")
    relation = F.when(matched, "supports").when(against, "contradicts").otherwise("inconclusive")
    value = F.when(matched, F.col("hit.s_model")).when(against, F.col("other"))
    review = F.when((F.col("method") == "sha256_exact") & matched, "not_reviewed").otherwise("needs_review")
    return ranked.select("event", "artifact", "model", relation.alias("relation"), value.alias("sample_value"), review.alias("review"))


def compare_flags(expected: Column, observed: Column) -> Column:
    """supports if every expected flag is observed and there is one, else inconclusive."""
    return F.when((F.size(expected) > 0) & (F.size(F.array_except(expected, observed)) == 0), "supports").otherwise("inconclusive")


def summary(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    return comparisons.groupBy(*keys).agg(*(F.count_if(F.col("relation") == r).alias(r) for r in RELATIONS))


def validate_facts(facts: DataFrame, units: DataFrame) -> DataFrame:
    """facts with reject_reason, null for those that hold: no reference, unknown unit, or a raw value that the unit doesn't have.

    facts: fact_id, unit_ids, raw. units: unit_id, content.
    """
    refs = facts.select("fact_id", "raw", F.explode("unit_ids").alias("unit_id")).join(units, "unit_id", "left")
    seen = refs.groupBy("fact_id").agg(F.count_if(F.col("content").isNull()).alias("unknown"), F.count_if(F.instr("content", F.col("raw")) > 0).alias("held"))
    out = facts.join(seen, "fact_id", "left")
    reason = F.when(F.coalesce(F.size("unit_ids"), F.lit(0)) <= 0, "no_reference").when(F.col("unknown") > 0, "unknown_unit").when(F.col("held") == 0, "raw_not_in_unit")
    return out.withColumn("reject_reason", reason).drop("unknown", "held")


def review_gate(facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """path, status, value: what a review leaves of each fact, and whether the review covers just the facts that there are.

    facts: path, value. reviews: path, verdict (accept, reject, unresolved). Rejected and unresolved values become unknown.
    """
    both = facts.join(reviews.withColumnRenamed("path", "r_path"), F.col("path") == F.col("r_path"), "full")
    status = F.when(F.col("path").isNull(), "unexpected").when(F.col("r_path").isNull(), "missing").otherwise(F.col("verdict"))
    return both.select(F.coalesce("path", "r_path").alias("path"), status.alias("status"), F.when(status == "accept", F.col("value")).otherwise("unknown").alias("value"))


def merge_chunks(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, conflict, evidence: values of the same path from several chunks; different ones become unknown."""
    return values.groupBy(*keys).agg(
        F.when(F.countDistinct("value") > 1, "unknown").otherwise(F.min("value")).alias("value"), (F.countDistinct("value") > 1).alias("conflict"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    )
