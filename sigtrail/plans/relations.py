"""Queries over similarity, clusters, comparisons and gates, on the planted corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtrail.functions import python as P
from sigtrail.operators import compare, rules
from sigtrail.operators import similarity as M
from sigtrail.operators.store import written
from sigtrail.plans.detection import _HITS
from sigtrail.plans.planted import planted, with_planted


def _facts(spark, sf_dir):
    hits = rules.scan_rules(planted(spark, sf_dir))
    kinds = F.array(F.struct(F.lit("vendor").alias("kind"), F.col("vendor").alias("value")), F.struct(F.lit("family").alias("kind"), F.col("family").alias("value")), F.struct(F.lit("model").alias("kind"), F.col("model").alias("value")), F.struct(F.lit("service").alias("kind"), F.when(F.col("type") == "endpoint", F.col("value")).alias("value")))
    return M.tool_facts(hits.select("artifact", F.inline(kinds)))


def tool_jaccard(spark, sf_dir):
    return M.jaccard_pairs(_facts(spark, sf_dir)).select("a", "b", F.round("score", 6).alias("score"), "n_common")


def simhash_pairs(spark, sf_dir):
    """One row for each document: its class (the least document with its hash), how many the class has, and the classes near it."""
    hashed = written(planted(spark, sf_dir).select("artifact", P.simhash64("text").alias("simhash")), "simhashes")
    classes = hashed.filter("simhash <> 0").groupBy("simhash").agg(F.min("artifact").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    near = classes.join(M.simhash_links(classes), "simhash")
    return hashed.join(near, "simhash", "left").select("artifact", "simhash", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _metrics(p):
    loc = (F.length(F.col("text")) % 97).cast("double")
    return p.select("artifact", "doc_id", "lang", F.create_map(F.lit("loc"), loc, F.lit("functions"), (F.col("doc_id") % 7).cast("double"), F.lit("blank"), (F.col("doc_id") % 3).cast("double"), F.lit("comment"), F.when(F.col("doc_id") % 2 == 0, 0.5)).alias("m"))


def code_ratio(spark, sf_dir):
    rows = _metrics(planted(spark, sf_dir))
    rows = rows.withColumn("m", F.map_filter("m", lambda k, v: v.isNotNull()))
    one = rows.filter("doc_id = 0").select(F.col("artifact").alias("one"), F.col("m").alias("m1"))
    return rows.crossJoin(F.broadcast(one)).select("artifact", F.round(M.metric_score(F.col("m"), F.col("m1")), 6).alias("score"))  # one profile against all


def fused(spark, sf_dir):
    p = planted(spark, sf_dir)
    tool = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 11) / 10)
    prompt = M.prompt_score(F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 5) / 4), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 3) / 2))
    code = F.when(F.col("doc_id") % 6 == 0, (F.col("doc_id") % 13) / 12)
    f = p.select("artifact", M.fuse(tool, prompt, code).alias("f"))
    return f.select("artifact", *(F.round(f"f.{c}", 6).alias(c) for c in ("overall", "coverage", "conditional")))


def components(spark, sf_dir):
    edges = planted(spark, sf_dir).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("a"), F.floor(F.col("doc_id") / 2).cast("long").alias("b"))
    return M.components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def upgma_clusters(spark, sf_dir):
    facts = written(_facts(spark, sf_dir), "facts")
    classes = written(M.fact_classes(facts), "members")
    nodes = classes.select(F.col("representative").alias("artifact")).distinct()
    return classes.join(M.cluster(nodes, written(M.jaccard_pairs(facts), "pairs")).withColumnRenamed("artifact", "representative"), "representative").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_artifacts"))


def comparison_relations(spark, sf_dir):
    p = planted(spark, sf_dir)
    sample = rules.scan_rules(p).filter("type = 'model_identifier'").select("artifact", F.col("ordinal").alias("pos"), F.coalesce("model", "value").alias("model"))
    names = ["gpt-4o-mini", "Gemini", "gemini-2.5-flash-lite-latest", "qwen2.5-coder-32b-instruct", "claude"]
    report = spark.createDataFrame([(e, k, m) for e in range(5) for k, m in enumerate([names[e], names[(e + 1) % 5]])], "event int, pos int, model string")
    links = p.select((F.col("doc_id") % 5).cast("int").alias("event"), "artifact", F.when(F.col("doc_id") % 2 == 0, "sha256_exact").otherwise("family_only").alias("method"))
    return compare.summary(compare.compare_models(report, sample, links), ["event"])


def fact_validation(spark, sf_dir):
    p = planted(spark, sf_dir)
    units = p.select(F.col("artifact").alias("unit_id"), F.col("signal").alias("content"))
    ids = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 6 == 1, F.array(F.lit("nowhere"))).otherwise(F.array("artifact"))
    facts = p.select(F.col("artifact").alias("fact_id"), ids.alias("unit_ids"), F.when(F.col("doc_id") % 4 == 0, "gpt-").otherwise("PROMPT").alias("raw"))
    return compare.validate_facts(facts, units).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def review_gate(spark, sf_dir):
    p = planted(spark, sf_dir)
    facts = p.filter("doc_id % 5 <> 0").select(F.col("artifact").alias("path"), F.col("lang").alias("value"))
    verdict = F.when(F.col("doc_id") % 3 == 0, "accept").when(F.col("doc_id") % 3 == 1, "reject").otherwise("unresolved")
    reviews = p.filter("doc_id % 7 <> 0").select(F.col("artifact").alias("path"), verdict.alias("verdict"))
    return compare.review_gate(facts, reviews).groupBy("status", "value").agg(F.count(F.lit(1)).alias("n"))


def chunk_merge(spark, sf_dir):
    p = planted(spark, sf_dir).select((F.col("doc_id") % 90).alias("event"), (F.col("doc_id") % 2).alias("path"), "family", F.col("lang").alias("value"), F.array("family").alias("evidence"))
    m = compare.merge_chunks(p, ["event", "path"])
    return m.select("event", "path", "value", "conflict", F.array_join("evidence", ",").alias("evidence"))


QUERIES = {
    "q_tool_jaccard": tool_jaccard, "q_simhash_pairs": simhash_pairs, "q_code_ratio_similarity": code_ratio, "q_fused_similarity": fused, "q_components": components,
    "q_upgma_clusters": upgma_clusters, "q_comparison_relations": comparison_relations, "q_fact_validation": fact_validation, "q_review_gate": review_gate, "q_chunk_merge": chunk_merge,
}

ORACLE_SQL = {
    "q_tool_jaccard": with_planted(
        f"""{_HITS}, ev AS (SELECT artifact, 'vendor' AS kind, vendor AS value, 1.0 AS w FROM hits UNION ALL SELECT artifact, 'family', family, 1.5 FROM hits UNION ALL SELECT artifact, 'model', model, 2.0 FROM hits UNION ALL SELECT artifact, 'service', value, 1.5 FROM hits WHERE type = 'endpoint'),
f AS (SELECT DISTINCT artifact, kind || ':' || lower(trim(value)) AS fact, w::DOUBLE AS w FROM ev WHERE value IS NOT NULL AND lower(trim(value)) NOT IN ('', 'unknown', 'none', 'null', 'n/a', 'na', '-')),
p AS (SELECT artifact, string_agg(fact, '|' ORDER BY fact) AS p FROM f GROUP BY 1), c AS (SELECT min(artifact) AS artifact FROM p GROUP BY p),
o AS (SELECT f.* FROM f JOIN c USING (artifact)), t AS (SELECT artifact, sum(w) AS t FROM o GROUP BY 1),
j AS (SELECT x.artifact AS a, y.artifact AS b, sum(least(x.w, y.w)) AS s, count(*) AS n FROM o x JOIN o y ON x.fact = y.fact AND x.artifact < y.artifact GROUP BY 1, 2)
SELECT a, b, round(s / (ta.t + tb.t - s), 6) AS score, n AS n_common FROM j JOIN t ta ON a = ta.artifact JOIN t tb ON b = tb.artifact"""
    ),
    "q_fused_similarity": with_planted(
        """s AS (SELECT artifact, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 11) / 10 END AS t, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 5) / 4 END AS c, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 3) / 2 END AS st, CASE WHEN doc_id % 6 = 0 THEN (doc_id % 13) / 12 END AS k FROM planted),
p AS (SELECT artifact, t, k, CASE WHEN c IS NULL THEN 0.2::DOUBLE * st WHEN st IS NULL THEN c ELSE 0.8::DOUBLE * c + 0.2::DOUBLE * st END AS p FROM s),
f AS (SELECT artifact, 0.5::DOUBLE * coalesce(t, 0) + 0.3::DOUBLE * coalesce(p, 0) + 0.2::DOUBLE * coalesce(k, 0) AS o, CASE WHEN t IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN p IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN k IS NULL THEN 0 ELSE 0.2::DOUBLE END AS g FROM p)
SELECT artifact, CASE WHEN g > 0 THEN round(o, 6) END AS overall, round(g, 6) AS coverage, CASE WHEN g > 0 THEN round(o / g, 6) END AS conditional FROM f"""
    ),
    "q_code_ratio_similarity": with_planted(
        """m AS (SELECT artifact, doc_id, (length(text) % 97)::DOUBLE AS l, (doc_id % 7)::DOUBLE AS f, (doc_id % 3)::DOUBLE AS b, CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE END AS c FROM planted),
x AS (SELECT m.artifact, k, x, y FROM m, (SELECT l AS l1, f AS f1, b AS b1, c AS c1 FROM m WHERE doc_id = 0), LATERAL (SELECT unnest([m.l, m.f, m.b, m.c]) AS x, unnest([l1, f1, b1, c1]) AS y, unnest([1, 2, 3, 4]) AS k)),
s AS (SELECT artifact, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0)) AS n, count(*) FILTER (WHERE (x IS NULL) <> (y IS NULL)) AS one, sum(CASE WHEN x = 0 AND y = 0 THEN 0 ELSE least(x, y) / greatest(x, y) END) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS s FROM x GROUP BY 1)
SELECT artifact, CASE WHEN n >= 3 THEN round(s / (n + one), 6) END AS score FROM s"""
    ),
    "q_components": with_planted(
        """RECURSIVE_PLACEHOLDER"""
    ),
    "q_comparison_relations": with_planted(
        f"""{_HITS}, s AS (SELECT artifact, coalesce(model, value) AS m FROM hits WHERE type = 'model_identifier'),
n AS (SELECT ['gpt-4o-mini', 'Gemini', 'gemini-2.5-flash-lite-latest', 'qwen2.5-coder-32b-instruct', 'claude'] AS x),
r AS (SELECT e AS event, x[((e + k) % 5)::INTEGER + 1] AS model FROM n, range(0, 5) a(e), range(0, 2) b(k)),
c AS (SELECT r.event, p.artifact, r.model, p.doc_id % 2 = 0 AS exact, regexp_replace(regexp_replace(lower(r.model), '-latest$', ''), '[^a-z0-9]', '', 'g') AS rk, regexp_replace(regexp_replace(lower(s.m), '-latest$', ''), '[^a-z0-9]', '', 'g') AS sk
      FROM planted p JOIN r ON r.event = p.doc_id % 5 LEFT JOIN s USING (artifact)),
g AS (SELECT event, artifact, model, exact, bool_or(coalesce(rk = sk OR (rk IN ('gemini', 'gpt', 'gptoss', 'claude', 'qwen') AND starts_with(sk, rk)) OR (sk IN ('gemini', 'gpt', 'gptoss', 'claude', 'qwen') AND starts_with(rk, sk)), false)) AS hit, count(sk) AS n FROM c GROUP BY 1, 2, 3, 4)
SELECT event::INTEGER AS event, count(*) FILTER (WHERE hit) AS supports, count(*) FILTER (WHERE NOT hit AND n > 0 AND exact) AS contradicts, 0::BIGINT AS complements, count(*) FILTER (WHERE NOT hit AND NOT (n > 0 AND exact)) AS inconclusive FROM g GROUP BY 1"""
    ),
    "q_fact_validation": with_planted(
        "SELECT CASE WHEN doc_id % 6 = 0 THEN 'no_reference' WHEN doc_id % 6 = 1 THEN 'unknown_unit' WHEN NOT contains(signal, CASE WHEN doc_id % 4 = 0 THEN 'gpt-' ELSE 'PROMPT' END) THEN 'raw_not_in_unit' END AS reject_reason, count(*) AS n FROM planted GROUP BY 1"
    ),
    "q_review_gate": with_planted(
        """f AS (SELECT artifact, lang, doc_id FROM planted WHERE doc_id % 5 <> 0), r AS (SELECT artifact, CASE doc_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'unresolved' END AS v FROM planted WHERE doc_id % 7 <> 0),
b AS (SELECT CASE WHEN f.artifact IS NULL THEN 'unexpected' WHEN r.artifact IS NULL THEN 'missing' ELSE v END AS status, lang FROM f FULL JOIN r ON f.artifact = r.artifact)
SELECT status, CASE WHEN status = 'accept' THEN lang ELSE 'unknown' END AS value, count(*) AS n FROM b GROUP BY 1, 2"""
    ),
    "q_chunk_merge": with_planted(
        "SELECT doc_id % 90 AS event, doc_id % 2 AS path, CASE WHEN count(DISTINCT lang) > 1 THEN 'unknown' ELSE min(lang) END AS value, count(DISTINCT lang) > 1 AS conflict, string_agg(DISTINCT family, ',' ORDER BY family) AS evidence FROM planted GROUP BY 1, 2"
    ),
}
ORACLE_SQL["q_components"] = """WITH RECURSIVE e AS (SELECT doc_id AS a, doc_id // 2 AS b FROM documents WHERE doc_id % 3 = 0 AND doc_id <> doc_id // 2),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a),
m AS (SELECT node, min(seen) AS component FROM r GROUP BY 1) SELECT component, count(*) AS n FROM m GROUP BY 1"""
