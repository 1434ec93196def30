"""Evidence rows: gates, deduplication and the conclusion for each artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribution_eligible(explicit: Column, role: Column, status: Column, method: Column) -> Column:
    """The explicit flag where there is one, else a verified relation that no model proposed; only in application code."""
    own = F.coalesce(role, F.lit("application")) == "application"
    legacy = F.coalesce(status == "relation_verified", F.lit(False)) & (F.coalesce(method, F.lit("")) != "llm")
    return F.coalesce(explicit, legacy) & own


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def conclude(evidence: DataFrame, prompts: DataFrame, key: str = "artifact") -> DataFrame:
    """key, evidence_grade, label, strength, model, vendor, n_evidence: one row for each artifact with evidence or prompts.

    evidence: key, type, value, vendor, model, confidence, status, eligible. prompts: key, eligible. One aggregate of each.
    """
    relation = F.col("eligible") & (F.col("status") == "relation_verified")
    is_model = F.col("eligible") & F.col("type").isin("model_identifier", "model_argument")
    best = F.struct((F.col("status") == "relation_verified").alias("r"), F.col("vendor").isNotNull().alias("v"), F.col("confidence").alias("c"), F.col("value").alias("o"))
    e = evidence.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_evidence"), F.max(relation).alias("relation"), F.max(F.when(F.col("eligible"), F.col("confidence"))).alias("top"),
        F.max_by(F.struct("vendor", F.coalesce("model", "value").alias("model")), F.when(is_model, best)).alias("m"), F.max(is_model).alias("any_model"),
    )
    p = prompts.groupBy(key).agg(F.count(F.lit(1)).alias("n_prompts"), F.max("eligible").alias("prompt_ok"))
    both = e.join(p, key, "full")
    relation, prompt_ok = F.coalesce("relation", F.lit(False)), F.coalesce("prompt_ok", F.lit(False))
    grade = (
        F.when(relation, "static_relation_supported").when(F.col("n_evidence") > 0, "marker_only")
        .when(prompt_ok, "static_relation_supported").when(F.col("n_prompts") > 0, "static_interaction_candidate").otherwise("insufficient")
    )
    strength = F.coalesce(F.col("top"), F.when(prompt_ok, F.lit(0.75)), F.lit(0.0))
    return both.select(
        key, grade.alias("evidence_grade"), F.when(relation | prompt_ok, "probable").otherwise("unknown").alias("label"), strength.alias("strength"),
        F.when(F.col("any_model"), F.col("m.vendor")).alias("vendor"), F.when(F.col("any_model"), F.col("m.model")).alias("model"), F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"),
    )
