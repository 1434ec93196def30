"""Queries over cross-checks of reports with artifacts and over evaluation, on the planted corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtrail.operators import crosscheck, stats
from sigtrail.plans.planted import planted, with_planted

#: Columns, in SQL that Spark and DuckDB both read.
_ARTIFACT = "sha2(cast(doc_id AS string), 256)"
_METHOD = "CASE WHEN doc_id % 3 = 0 THEN 'sha256_exact' ELSE 'family_only' END"
_PROVIDER = "CASE doc_id % 4 WHEN 0 THEN 'OpenAI LP' WHEN 1 THEN 'Google Gemini API' WHEN 2 THEN '' WHEN 3 THEN 'Anthropic' END"


def _links(spark, sf_dir):
    """Each source's report has its own name as a family, and every third artifact as an indicator."""
    p = planted(spark, sf_dir)
    indicators = p.filter("doc_id % 3 = 0").selectExpr("family AS report", "doc_id + 1 AS pos", "concat('i', doc_id) AS entity", "'indicator' AS type", "cast(null AS string) AS name", f"upper({_ARTIFACT}) AS normalized")
    families = p.select("family").distinct().selectExpr("family", "0L", "'f'", "'malware_family'", "concat(' ', upper(family))", "'other'")
    models = p.select("family").distinct().selectExpr("family", "0L", "'m'", "'model'", "'GPT_4o'", "''")
    providers = p.select("family").distinct().selectExpr("family", "0L", "'p'", "'provider'", "'x'", "'OpenAI  Inc'")
    entities = indicators.union(families).union(models).union(providers)
    samples = p.selectExpr(f"{_ARTIFACT} AS artifact", "family").union(p.selectExpr("artifact", "family"))
    return entities, crosscheck.link_samples(entities, samples)


def report_links(spark, sf_dir):
    return _links(spark, sf_dir)[1]


def claim_graph(spark, sf_dir):
    entities, links = _links(spark, sf_dir)
    p = planted(spark, sf_dir)
    said = p.select("family").distinct().selectExpr("family AS report", "'f' AS subject", "inline(array(('uses_model', 'm'), ('uses_provider', 'p'), ('has_ai_role', null), ('has_target', 'm'))) AS (predicate, object)")
    held = p.filter("doc_id % 3 = 0").selectExpr("family", "'f'", "'has_indicator'", "concat('i', doc_id)")
    claims = said.union(held).withColumn("claim", F.concat_ws("-", "report", "predicate", "object"))
    value = "CASE doc_id % 5 WHEN 0 THEN 'gpt 4o-latest' WHEN 2 THEN 'openai' ELSE 'claude' END"
    first = p.filter("doc_id % 5 <> 3").selectExpr(f"{_ARTIFACT} AS artifact", "0 AS pos", "CASE doc_id % 5 WHEN 2 THEN 'provider' ELSE 'model' END AS kind", "'e0' AS path", f"{value} AS value")
    second = p.filter("doc_id % 5 = 4").selectExpr(_ARTIFACT, "1", "'model'", "'e1'", "'GPT-4o'")
    return crosscheck.compare_claims(claims, entities, links, first.union(second)).drop("claim", "report")


def _events(spark, sf_dir):
    p = planted(spark, sf_dir)
    return p, p.selectExpr("family AS event", "artifact", f"{_METHOD} AS method")


def provider_relations(spark, sf_dir):
    p, links = _events(spark, sf_dir)
    report = p.select("family").distinct().selectExpr("family AS event", "inline(array((0, 'OpenAI'), (1, 'open-ai'), (2, 'Google'), (3, ''))) AS (pos, provider)")
    return crosscheck.compare_providers(report, p.selectExpr("artifact", "0 AS pos", f"{_PROVIDER} AS provider"), links)


def prompt_relations(spark, sf_dir):
    p, links = _events(spark, sf_dir)
    prompts = "inline(array((0, 'h1', 'full', array('x', 'y')), (1, null, 'described_only', null), (2, null, 'partial', null))) AS (pos, text_hash, availability, flags)"
    report = p.select("family").distinct().selectExpr("family AS event", prompts)
    sample = p.filter("doc_id % 4 < 3").selectExpr("artifact", "'h1' AS text_hash", "CASE doc_id % 4 WHEN 0 THEN 'full_text' WHEN 1 THEN 'excerpt_only' END AS completeness", "doc_id % 4 <> 2 AS eligible")
    observed = p.selectExpr("artifact", "CASE WHEN doc_id % 5 = 0 THEN array('x', 'y', 'z') ELSE array('x') END AS flags")
    return crosscheck.compare_prompts(report, sample, observed, links)


def context_relations(spark, sf_dir):
    p, links = _events(spark, sf_dir)
    facts = "inline(array(('event_context', 'time', '2025', 1), ('event_context', 'status', '', 2), ('toolchain', 'purpose', 'code', 3), ('code_style', 'style', 'terse', 0))) AS (`group`, name, value, n_evidence)"
    return crosscheck.complement(p.select("family").distinct().selectExpr("family AS event", facts), links)


def evaluation(spark, sf_dir):
    p = planted(spark, sf_dir)
    cases = p.selectExpr(
        "artifact AS case", "text", "CASE doc_id % 4 WHEN 0 THEN 'application' WHEN 1 THEN 'dependency' END AS expected_role", "doc_id % 11 = 0 AS failed", "CASE WHEN doc_id % 6 <> 0 THEN doc_id % 6 END AS requests",
        "CASE WHEN doc_id % 6 <> 0 THEN doc_id % 100 END AS tokens", "CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 8) / 8 END AS latency",
    )
    model, vendor = p.filter("doc_id % 19 < 2").selectExpr("artifact AS case", "'model' AS kind", "CASE doc_id % 19 WHEN 0 THEN 'gpt-4o-mini' ELSE 'gemini-2.5-flash-lite' END AS value"), p.filter("doc_id % 3 = 0").selectExpr("artifact", "'vendor'", "'OpenAI'")
    negative = p.selectExpr("artifact", "'negative'", "CASE WHEN doc_id % 2 = 0 THEN 'absent' ELSE 'none' END")
    prompt = p.filter("doc_id % 5 = 0").selectExpr("artifact", "'prompt'", "'You are'")
    expected = model.union(vendor).union(negative).union(prompt).union(prompt)
    # Every model is reported twice, one wrongly, with the vendor it has; a prompt in every second of five.
    hits = p.filter("doc_id % 19 < 3").selectExpr("artifact AS case", "'model' AS kind", "CASE doc_id % 19 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'absent' ELSE 'Qwen' END AS value", "'OpenAI' AS vendor", "'application' AS role", "doc_id % 2 = 0 AS bound")
    prompts = p.filter("doc_id % 10 = 0").selectExpr("artifact", "'prompt'", "'You are'", "cast(null AS string)", "CASE WHEN doc_id % 20 = 0 THEN 'application' END", "doc_id % 20 = 0")
    units = p.filter("doc_id % 8 = 1").selectExpr("artifact AS case", "'dependency' AS role")
    return stats.evaluation(cases, expected, hits.union(hits).union(prompts), units)


QUERIES = {
    "q_report_links": report_links, "q_claim_graph": claim_graph, "q_provider_relations": provider_relations, "q_prompt_relations": prompt_relations, "q_context_relations": context_relations, "q_evaluation": evaluation,
}

_SHA = "sha256(cast(doc_id AS varchar))"
_REVIEW = "CASE WHEN doc_id % 3 = 0 AND relation = 'supports' THEN 'not_reviewed' ELSE 'needs_review' END AS review"


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN round(({a}) / ({b}), 6) END"


ORACLE_SQL = {
    "q_report_links": with_planted(
        f"""SELECT family AS report, {_SHA} AS artifact, CASE WHEN doc_id % 3 = 0 THEN 'i' || doc_id ELSE 'f' END AS entity, {_METHOD} AS method,
CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.55 END::DOUBLE AS confidence, doc_id % 3 = 0 AS propagates FROM planted WHERE family IS NOT NULL"""
    ),
    "q_claim_graph": with_planted(
        f"""c AS (SELECT doc_id, {_SHA} AS artifact, k, CASE
    WHEN k = 'role' THEN 'complements' WHEN k = 'model' AND doc_id % 5 IN (0, 4) OR k = 'provider' AND doc_id % 5 = 2 THEN 'supports'
    WHEN k = 'model' AND doc_id % 5 = 1 AND doc_id % 3 = 0 THEN 'contradicts' ELSE 'inconclusive' END AS relation,
  CASE WHEN k = 'role' THEN 'classification.llm_involvement' WHEN k = 'provider' THEN CASE WHEN doc_id % 5 = 2 THEN 'e0' ELSE 'features.toolchain.evidence' END
    ELSE CASE doc_id % 5 WHEN 4 THEN 'e1' WHEN 0 THEN 'e0' WHEN 1 THEN 'e0' ELSE 'classification.model_attribution' END END AS path
  FROM planted, (VALUES ('model'), ('provider'), ('role')) v(k) WHERE family IS NOT NULL)
SELECT artifact, relation, path, CASE WHEN doc_id % 3 = 0 AND relation <> 'contradicts' THEN 'auto' ELSE 'needs_review' END AS decision FROM c"""
    ),
    "q_provider_relations": with_planted(
        f"""c AS (SELECT *, CASE WHEN provider = 'OpenAI' AND doc_id % 4 = 0 OR provider = 'Google' AND doc_id % 4 = 1 THEN {_PROVIDER} END AS sample_value FROM planted, (VALUES ('OpenAI'), ('Google')) v(provider)),
r AS (SELECT *, CASE WHEN sample_value IS NOT NULL THEN 'supports' ELSE 'inconclusive' END AS relation FROM c WHERE family IS NOT NULL)
SELECT family AS event, artifact, provider, sample_value, relation, {_REVIEW} FROM r"""
    ),
    "q_prompt_relations": with_planted(
        f"""r AS (SELECT *, CASE WHEN pos = 0 AND (doc_id % 4 = 0 OR doc_id % 5 = 0) THEN 'supports' WHEN pos = 1 THEN 'complements' ELSE 'inconclusive' END AS relation
  FROM planted, (VALUES (0), (1), (2)) v(pos) WHERE family IS NOT NULL)
SELECT family AS event, artifact, pos, relation, {_REVIEW} FROM r"""
    ),
    "q_context_relations": with_planted(
        """SELECT family AS event, artifact, g AS "group", name, value, 'complements' AS relation, 'needs_review' AS review
FROM planted, (VALUES ('event_context', 'time', '2025'), ('toolchain', 'purpose', 'code')) v(g, name, value) WHERE family IS NOT NULL"""
    ),
    "q_evaluation": with_planted(
        f"""n AS (SELECT doc_id, doc_id % 19 AS s, doc_id % 4 AS role, doc_id % 5 = 0 AS asked, doc_id % 10 = 0 AS said, contains(text, 'You are') AS quoted, contains(text, 'absent') AS has_absent, contains(text, 'Qwen') AS has_qwen FROM planted),
t AS (SELECT count(*) FILTER (WHERE s = 0) AS mtp, count(*) FILTER (WHERE s IN (1, 2)) AS mfp, count(*) FILTER (WHERE s = 1) AS mfn, count(*) FILTER (WHERE s < 3) AS vn, count(*) FILTER (WHERE s < 3 AND doc_id % 3 <> 0) AS vf,
  count(*) FILTER (WHERE said) AS ptp, count(*) FILTER (WHERE asked AND NOT said) AS pfn, count(*) FILTER (WHERE doc_id % 20 = 0) AS bound, count(*) AS cases, count(*) FILTER (WHERE s = 1 AND doc_id % 2 = 0) AS decoys,
  2 * count(*) FILTER (WHERE role = 0 AND s < 3) + count(*) FILTER (WHERE role = 0 AND said) AS apps, count(*) FILTER (WHERE role = 0 AND said AND doc_id % 20 <> 0) AS wrong, count(*) FILTER (WHERE role = 1) AS deps, count(*) FILTER (WHERE doc_id % 8 = 5) AS missing,
  2 * count(*) FILTER (WHERE s < 3) + count(*) FILTER (WHERE said) AS cites,
  2 * (count(*) FILTER (WHERE s = 0) + count(*) FILTER (WHERE s = 1 AND has_absent) + count(*) FILTER (WHERE s = 2 AND has_qwen)) + count(*) FILTER (WHERE said AND quoted) AS valid,
  2 * count(*) FILTER (WHERE s < 3 AND doc_id % 2 = 0) + count(*) FILTER (WHERE doc_id % 20 = 0) AS rel, 2 * count(*) FILTER (WHERE s = 0 AND doc_id % 2 = 0) + count(*) FILTER (WHERE doc_id % 20 = 0) AS good,
  count(*) FILTER (WHERE doc_id % 11 = 0) AS failed, count(*) FILTER (WHERE doc_id % 6 <> 0) AS timed, sum(doc_id % 6) AS requests, sum(doc_id % 100) FILTER (WHERE doc_id % 6 <> 0) AS tokens, avg((doc_id % 8) / 8) FILTER (WHERE doc_id % 6 <> 0) AS latency FROM n)
SELECT {_rate('mtp', 'mtp + mfp')} AS model_identifier_precision, {_rate('mtp', 'mtp + mfn')} AS model_identifier_recall, {_rate('vf', 'vn')} AS model_vendor_false_attribution_rate, {_rate('ptp', 'ptp')} AS prompt_component_precision,
  {_rate('ptp', 'ptp + pfn')} AS prompt_component_recall, {_rate('bound', 'ptp')} AS prompt_call_binding_precision, {_rate('decoys', 'cases')} AS decoy_false_positive_rate, {_rate('wrong + missing', 'apps + deps')} AS role_error_rate,
  {_rate('valid', 'cites')} AS citation_validity_rate, {_rate('good', 'rel')} AS relation_verified_precision, {_rate('failed', 'cases')} AS analysis_failure_rate, {_rate('requests', 'timed')} AS average_requests,
  {_rate('tokens', 'timed')} AS average_tokens, round(latency, 6) AS average_latency FROM t"""
    ),
}
