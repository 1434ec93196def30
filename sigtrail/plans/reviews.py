"""Queries over reviews of evidence, on the planted corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtrail.operators import review
from sigtrail.plans.planted import planted, with_planted


def span_check(spark, sf_dir):
    p = planted(spark, sf_dir).filter("length(signal) > 8")
    content = F.encode("signal", "UTF-8")
    wrong = F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.lit(""))
    spans = p.select("artifact", F.lit(1).cast("long").alias("start"), F.lit(6).cast("long").alias("end"), F.sha2(F.concat(F.substring("signal", 2, 5), wrong), 256).alias("sha256"))
    return review.check_spans(spans, p.select("artifact", content.alias("content"))).groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


def strength_join(spark, sf_dir):
    p = planted(spark, sf_dir)
    path = F.concat(F.lit("events.e"), F.col("doc_id") % 10, F.lit(".targets"))
    ids = F.array(F.concat(F.lit("v"), F.col("doc_id") % 50), F.concat(F.lit("v"), F.col("doc_id") % 70))
    c = p.select(F.col("artifact").alias("comparison_id"), path.alias("path"), ids.alias("evidence"))
    strength = F.element_at(F.array(F.lit("strong"), F.lit("weak"), F.lit("moderate")), (F.col("doc_id") % 3 + 1).cast("int"))
    a = p.select(F.concat(F.lit("events.e"), F.col("doc_id") % 10).alias("path"), F.array(F.concat(F.lit("v"), F.col("doc_id"))).alias("evidence"), strength.alias("strength"))
    return review.strengths(c, a).select("comparison_id", F.array_join("strengths", ",").alias("strengths"), "needs_review")


def association_status(spark, sf_dir):
    p = planted(spark, sf_dir)
    relations = p.filter("doc_id % 3 = 0 and doc_id > 0").select(F.col("doc_id").alias("a"), F.floor(F.col("doc_id") / 2).cast("long").alias("b"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 5) / 4).alias("score"))
    return review.association_status(p.select(F.col("doc_id").alias("artifact"), (F.col("doc_id") % 11 != 0).alias("has_profile")), relations)


def unit_queries(spark, sf_dir):
    p = planted(spark, sf_dir)
    unit = lambda c: F.concat(F.lit("u"), c)
    units = p.select(unit(F.col("doc_id")).alias("unit"), F.col("signal").alias("content"))
    edges = p.select(unit(F.col("doc_id")).alias("src"), F.when(F.col("doc_id") % 2 == 0, "calls").otherwise("strings").alias("kind"), unit(F.col("doc_id") % 7).alias("dst"))
    kind = F.element_at(F.array(*map(F.lit, ["definition", "calls", "callers", "strings", "neighbors", "delete"])), (F.col("doc_id") % 6 + 1).cast("int"))
    asked = p.select(F.col("doc_id").alias("request"), kind.alias("kind"), unit(F.col("doc_id") % 30).alias("unit"))
    return review.query_units(asked, units, edges).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit").alias("n_units"))


def quote_repair(spark, sf_dir):
    p = planted(spark, sf_dir).filter("length(signal) > 8")
    loose = F.concat(F.regexp_replace(F.trim("signal"), " ", "  "), F.when(F.col("doc_id") % 5 == 0, " more").otherwise(""))
    return p.select("artifact", review.repair_quote(loose, F.col("text")).alias("quote"))


QUERIES = {"q_span_check": span_check, "q_strength_join": strength_join, "q_association_status": association_status, "q_unit_queries": unit_queries, "q_quote_repair": quote_repair}

ORACLE_SQL = {
    "q_span_check": with_planted("SELECT doc_id % 3 <> 0 AS ok, count(*) AS n FROM planted WHERE length(signal) > 8 GROUP BY 1"),
    "q_strength_join": with_planted(
        """c AS (SELECT artifact, 'events.e' || (doc_id % 10) || '.targets' AS path, unnest(list_distinct(['v' || (doc_id % 50), 'v' || (doc_id % 70)])) AS e FROM planted),
a AS (SELECT 'events.e' || (doc_id % 10) AS path, 'v' || doc_id AS e, ['strong', 'weak', 'moderate'][doc_id % 3 + 1] AS s FROM planted),
h AS (SELECT artifact, s, starts_with(c.path, a.path) AS fits FROM c JOIN a USING (e)),
k AS (SELECT artifact, bool_or(fits) AS any_fit FROM h GROUP BY 1),
r AS (SELECT artifact, string_agg(DISTINCT s, ',' ORDER BY s) AS strengths FROM h JOIN k USING (artifact) WHERE fits OR NOT any_fit GROUP BY 1)
SELECT artifact AS comparison_id, coalesce(strengths, '') AS strengths, strengths IS NULL OR contains(strengths, 'weak') AS needs_review FROM planted LEFT JOIN r USING (artifact)"""
    ),
    "q_association_status": with_planted(
        """r AS (SELECT doc_id AS a, doc_id // 2 AS b, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 5) / 4 END AS score FROM planted WHERE doc_id % 3 = 0 AND doc_id > 0),
u AS (SELECT a AS x, score FROM r UNION ALL SELECT b, score FROM r), s AS (SELECT x, count(*) AS n, count(score) AS k, count(*) FILTER (WHERE score > 0) AS m, max(score) AS best FROM u GROUP BY 1)
SELECT doc_id AS artifact, coalesce(m, 0) AS n_related, best, CASE WHEN doc_id % 11 = 0 THEN 'no_features' WHEN n IS NULL THEN 'no_relations' WHEN k = 0 THEN 'not_comparable' WHEN m = 0 THEN 'no_positive_match' ELSE 'matched' END AS status
FROM planted LEFT JOIN s ON x = doc_id"""
    ),
    "q_quote_repair": with_planted("SELECT artifact, CASE WHEN doc_id % 5 <> 0 THEN trim(signal) END AS quote FROM planted WHERE length(signal) > 8"),
}
