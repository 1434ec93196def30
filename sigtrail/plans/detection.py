"""Queries over rule scans, wording and evidence, on the planted corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.functions import scalars as S
from sigtrail.operators import evidence, rules
from sigtrail.plans.planted import planted, with_planted


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_RULES = " UNION ALL ".join(
    f"SELECT artifact, '{kind}' AS type, '{rid}' AS rule_id, unnest(regexp_extract_all(text, {_quoted(p)})) AS value, "
    f"generate_subscripts(regexp_extract_all(text, {_quoted(p)}), 1) - 1 AS ordinal, {_quoted(v)}::VARCHAR AS vendor, {_quoted(f)}::VARCHAR AS family, {_quoted(m)}::VARCHAR AS model, {c}::DOUBLE AS confidence FROM planted"
    for kind, pack in rules.GROUPS
    for rid, p, v, f, m, c in pack
)
_HITS = f"hits AS (SELECT * FROM ({_RULES}) WHERE ordinal < {rules.MATCH_CAP})"


def model_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rules.scan_rules(planted(spark, sf_dir)).filter("type = 'model_identifier'")
    return hits.groupBy(F.coalesce("model", "value").alias("model")).agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("artifact").alias("n_artifacts"))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan_rules(planted(spark, sf_dir)).select("artifact", "type", "rule_id", "value", F.col("ordinal").cast("long").alias("ordinal"), "vendor", "family", "model", "confidence")


def prompt_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("artifact", rules.prompt_flags(F.col("text")).alias("f")).select("artifact", "f.*")


def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.special_tokens(planted(spark, sf_dir))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = planted(spark, sf_dir).withColumn("role", F.when(F.col("doc_id") % 7 == 0, "example").otherwise("application"))
    hits = rules.scan_rules(base).join(base.select("artifact", "role", (F.col("doc_id") % 3 == 0).alias("verified")), "artifact")
    status = F.when(F.col("verified"), "relation_verified").otherwise("unverified")
    no = F.lit(None).cast("boolean")
    e = hits.withColumn("status", status).withColumn("eligible", evidence.attribution_eligible(no, F.col("role"), status, F.lit("rule")))
    p = rules.special_tokens(base).join(base.select("artifact", "role", (F.col("doc_id") % 2 == 0).alias("bound")), "artifact")
    return e, p.withColumn("eligible", F.col("bound") & (F.col("role") == "application"))


def evidence_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.conclude(*_evidence(spark, sf_dir))


def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rules.scan_rules(planted(spark, sf_dir))
    kept = evidence.first_wins(hits, ["artifact", "type", "value"], ["rule_id", "ordinal"])
    return kept.groupBy("type", "rule_id").agg(F.count(F.lit(1)).alias("n_kept"))


def assertion_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).groupBy(rules.assertion_class(F.col("signal")).alias("assertion")).agg(F.count(F.lit(1)).alias("n"))


def evidence_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("artifact", rules.evidence_strength(F.col("signal")).alias("e")).select("artifact", "e.*")


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).groupBy("family", rules.event_type(F.col("signal")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


def dictionary_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.dictionary_terms(planted(spark, sf_dir), ["artifact", "signal"], "signal")
    return found.select("artifact", "entity_type", "term", S.stable_id("entity", F.col("artifact"), F.col("entity_type"), F.lower("term")).alias("entity_id"))


def language_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrail.operators.language import source_language

    return planted(spark, sf_dir).groupBy(source_language(F.col("signal")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("HTTPS://User:pw@Api.Example.com:443/v1/"), F.col("family"), F.lit("?q=1#frag"))
    name = F.concat(F.lit("Family "), F.col("family"), F.lit(" (alias "), F.col("lang"), F.lit(")"))
    plain, alias = S.name_and_alias(name)
    return planted(spark, sf_dir).select(
        "artifact", S.normalize_space(F.col("signal")).alias("spaced"), S.canonical_key(F.col("signal")).alias("key"), S.model_key(F.lit("Gemini-1.5 Flash-latest")).alias("model_key"),
        S.meaningful(F.col("signal")).alias("meaningful"), S.url_normalized(url).alias("url"), S.url_host(url).alias("host"), S.endpoint_label(url).alias("endpoint"), S.family_key(name).alias("family_key"),
        plain.alias("plain"), alias.alias("alias"), S.token_estimate(F.col("signal")).alias("tokens"), S.excerpt(F.col("signal"), F.lit(10), F.lit(15), 5).alias("excerpt"),
        S.member_role(F.concat(F.lit("pkg/"), F.when(F.col("doc_id") % 2 == 0, "vendor").otherwise("src"), F.lit("/a.py"))).alias("role"),
    )


_NO_TERM = r"[^A-Za-z0-9_-]"
_TERMS = " UNION ALL ".join(
    f"SELECT artifact, '{kind}' AS entity_type, '{t}' AS term FROM planted WHERE regexp_matches(signal, '(?i)(^|{_NO_TERM}){t.replace('.', chr(92) + '.')}($|{_NO_TERM})')"
    for kind, terms in rules.REPORT_TERMS.items()
    for t in terms
)


def _words(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(signal), '{w}')" for w in words) + ")"


def _has(pattern: str) -> str:
    return f"regexp_matches(signal, '{pattern}')"


QUERIES = {
    "q_model_distribution": model_distribution,
    "q_rule_hits_capped": rule_hits,
    "q_prompt_flags": prompt_flags,
    "q_special_tokens": special_tokens,
    "q_evidence_grade": evidence_grade,
    "q_evidence_dedup": evidence_dedup,
    "q_assertion_class": assertion_class,
    "q_evidence_strength": evidence_strength,
    "q_event_types": event_types,
    "q_dictionary_claims": dictionary_claims,
    "q_source_language": language_cascade,
    "q_text_scalars": text_scalars,
}

ORACLE_SQL = {
    "q_model_distribution": with_planted(f"{_HITS} SELECT coalesce(model, value) AS model, count(*) AS n_hits, count(DISTINCT artifact) AS n_artifacts FROM hits WHERE type = 'model_identifier' GROUP BY 1"),
    "q_rule_hits_capped": with_planted(f"{_HITS} SELECT * FROM hits"),
    "q_prompt_flags": with_planted("SELECT artifact, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in rules.PROMPT_PATTERNS.items()) + " FROM planted"),
    "q_special_tokens": with_planted("SELECT artifact, t AS token FROM planted, (SELECT unnest([" + ", ".join(map(_quoted, rules.SPECIAL_TOKENS)) + "]) AS t) WHERE contains(lower(text), lower(t))"),
    "q_evidence_grade": with_planted(
        f"""{_HITS},
base AS (SELECT artifact, doc_id, doc_id % 7 <> 0 AS app FROM planted),
e AS (SELECT h.*, b.doc_id % 3 = 0 AS verified, b.doc_id % 3 = 0 AND b.app AS eligible FROM hits h JOIN base b USING (artifact)),
ea AS (SELECT artifact, count(*) AS n_evidence, bool_or(eligible AND verified) AS relation, max(confidence) FILTER (WHERE eligible) AS top,
         max_by(coalesce(model, value), (verified, vendor IS NOT NULL, confidence, value)) FILTER (WHERE eligible AND type = 'model_identifier') AS model,
         max_by(vendor, (verified, vendor IS NOT NULL, confidence, value)) FILTER (WHERE eligible AND type = 'model_identifier') AS vendor FROM e GROUP BY 1),
tok AS (SELECT artifact FROM planted, (SELECT unnest([{", ".join(map(_quoted, rules.SPECIAL_TOKENS))}]) AS t) WHERE contains(lower(text), lower(t))),
pa AS (SELECT artifact, count(*) AS n_prompts, bool_or(doc_id % 2 = 0 AND app) AS ok FROM tok JOIN base USING (artifact) GROUP BY 1)
SELECT artifact,
  CASE WHEN coalesce(relation, false) THEN 'static_relation_supported' WHEN n_evidence > 0 THEN 'marker_only' WHEN coalesce(ok, false) THEN 'static_relation_supported'
       WHEN n_prompts > 0 THEN 'static_interaction_candidate' ELSE 'insufficient' END AS evidence_grade,
  CASE WHEN coalesce(relation, false) OR coalesce(ok, false) THEN 'probable' ELSE 'unknown' END AS label,
  coalesce(top, CASE WHEN coalesce(ok, false) THEN 0.75 END, 0.0)::DOUBLE AS strength, vendor, model, coalesce(n_evidence, 0) AS n_evidence
FROM ea FULL JOIN pa USING (artifact)"""
    ),
    "q_evidence_dedup": with_planted(
        f"{_HITS}, k AS (SELECT type, rule_id, row_number() OVER (PARTITION BY artifact, type, value ORDER BY rule_id, ordinal) AS n FROM hits) SELECT type, rule_id, count(*) AS n_kept FROM k WHERE n = 1 GROUP BY 1, 2"
    ),
    "q_assertion_class": with_planted(
        f"SELECT CASE WHEN {_words(rules.NEGATIVE_WORDS)} THEN 'unknown' WHEN {_words(rules.LIKELY_WORDS)} THEN 'likely' WHEN {_words(rules.SPECULATIVE_WORDS)} THEN 'speculative' ELSE 'asserted' END AS assertion, count(*) AS n FROM planted GROUP BY 1"
    ),
    "q_evidence_strength": with_planted(
        f"""s AS (SELECT artifact, signal,
  CASE WHEN {_has(rules.NEGATIVE)} THEN 'negative_evidence' WHEN {_has(rules.SPECULATIVE)} THEN 'author_inference' WHEN {_has(rules.POSSIBLE)} THEN 'author_inference' WHEN {_has(rules.LIKELY)} THEN 'author_assessment' WHEN {_has(rules.ATTRIBUTION)} THEN 'author_assessment' ELSE 'direct_observation' END AS claim_type,
  CASE WHEN {_has(rules.NEGATIVE)} THEN 'denied' WHEN {_has(rules.SPECULATIVE)} THEN 'speculative' WHEN {_has(rules.POSSIBLE)} THEN 'possible' WHEN {_has(rules.LIKELY)} THEN 'likely' ELSE 'asserted' END AS assertion_status,
  CASE {" ".join(f"WHEN {_has(p)} THEN '{n}'" for n, p in rules.CONFIDENCE)} ELSE 'not_stated' END AS author_confidence FROM planted)
SELECT artifact, claim_type, assertion_status, author_confidence,
  CASE WHEN signal = '' THEN 'unknown' WHEN assertion_status = 'denied' THEN 'strong' WHEN {_has(rules.CONFIRMED)} AND assertion_status = 'asserted' THEN 'confirmed'
       WHEN assertion_status IN ('possible', 'speculative') THEN 'weak'
       WHEN assertion_status = 'likely' OR claim_type IN ('author_inference', 'author_assessment') THEN CASE WHEN author_confidence = 'explicit_high' THEN 'strong' ELSE 'moderate' END ELSE 'strong' END AS strength FROM s"""
    ),
    "q_event_types": with_planted(
        """SELECT family, CASE WHEN contains(lower(signal), 'ransomware') THEN 'ransomware' WHEN contains(lower(signal), 'malware') THEN 'malware_operation' WHEN contains(lower(signal), 'intrusion') THEN 'intrusion'
WHEN contains(lower(signal), 'proof of concept') THEN 'proof_of_concept' ELSE 'unknown' END AS event_type, count(*) AS n FROM planted GROUP BY 1, 2"""
    ),
    "q_dictionary_claims": with_planted(
        f"t AS ({_TERMS}) SELECT artifact, entity_type, term, 'entity:' || substr(sha256(artifact || chr(31) || entity_type || chr(31) || lower(term)), 1, 20) AS entity_id FROM t"
    ),
    "q_source_language": with_planted("SELECT CASE WHEN regexp_matches(signal, '(?:^|[\\n;])\\s*(?:from\\s+[A-Za-z_.]+\\s+import|import\\s+[A-Za-z_]+|def\\s+[A-Za-z_]+\\s*\\()') THEN 'python' ELSE 'unknown' END AS language, count(*) AS n FROM planted GROUP BY 1"),
    "q_text_scalars": with_planted(
        """SELECT artifact, trim(regexp_replace(signal, '\\s+', ' ', 'g')) AS spaced, lower(regexp_replace(signal, '[^\\p{L}\\p{N}]', '', 'g')) AS key, 'gemini15flash' AS model_key,
  trim(signal) <> '' AS meaningful, 'https://api.example.com/v1/' || family || '?q=1' AS url, 'api.example.com' AS host, 'api.example.com/v1/' || family AS endpoint, 'family' || family AS family_key,
  'Family ' || family AS plain, 'alias ' || lang AS alias, greatest(1, (strlen(signal) + 2) // 3) AS tokens, trim(substr(signal, 6, 15)) AS excerpt,
  CASE WHEN doc_id % 2 = 0 THEN 'dependency' ELSE 'application' END AS role FROM planted"""
    ),
}
