"""Queries over nested reports: JSON made of each document's columns and whole text, nested to a depth that its id sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtrail.operators import chunks as C
from sigtrail.operators import pointers as P
from sigtrail.operators import rules
from sigtrail.plans.planted import planted, with_planted

_ACTOR = '{"name":"APT28","actor_type":"unknown","confidence":"high","evidence_ids":["v2"]}'
_TOOL = '{"provider":"OpenAI","model":null,"deployment":"cloud_api","evidence_ids":["v2","v1"]}'
#: The report in SQL that Spark and DuckDB both read, but for {text} and {signal}: those columns as JSON strings.
_EVENT = f"""concat('{{"event_id":"e', doc_id, '","identity":{{"event_name":"x/y~z","event_type":"', CASE doc_id % 3 WHEN 0 THEN 'unknown' ELSE 'intrusion' END, '","evidence_ids":["v1","v9"]}},"time":{{"start":', CASE WHEN event_date IS NULL THEN 'null' ELSE concat('"', event_date, '"') END,
 ',"end":"unknown","evidence_ids":', CASE doc_id % 4 WHEN 0 THEN '[]' ELSE '["v2"]' END, '}},"status":{{"value":"experimental","evidence_ids":["v2"]}},"ai_involvement":{{"autonomy_level":"unattended","output_handling":"","evidence_ids":["v3"]}},"attribution":{{"actors":[', CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '{_ACTOR}' ELSE '{_ACTOR},{_ACTOR}' END,
 ']}},"targets":[{{"name":"', source_, '","sector":null,"evidence_ids":["v1"]}}],"ai_signals":{{"toolchain":[', CASE doc_id % 2 WHEN 0 THEN '{_TOOL}' ELSE '' END, '],"prompts":[{{"effectiveness":"unknown","structural_features":{{"role_definition":', CASE doc_id % 5 WHEN 0 THEN 'true' ELSE 'false' END,
 ',"code_only":true}},"evidence_ids":["v2"]}}]}},"more~a/b":', repeat('[{{"in":', CAST(doc_id % 9 AS int)), '{{"evidence_ids":["v1"],"n":1.5}}', repeat('}},{{}}]', CAST(doc_id % 9 AS int)), ',"evidence":[{{"evidence_id":"v1","excerpt":', {{text}}, '}},{{"evidence_id":"v2","excerpt":', {{signal}}, '}}]}}')""".replace("source_", "family")


def _event(text: str, signal: str) -> str:
    return _EVENT.replace("{text}", text).replace("{signal}", signal)


def _reports(spark, sf_dir, *more: str):
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    p = planted(spark, sf_dir).withColumns({"text_json": quoted("text"), "signal_json": quoted("signal")})
    return p.selectExpr("artifact", _event("text_json", "signal_json") + " AS event", *more)


def report_nodes(spark, sf_dir):
    found = P.nodes(_reports(spark, sf_dir), texts=False)
    return found.select("artifact", "pointer", "kind", F.when(F.col("kind").isin("number", "boolean"), F.col("value")).otherwise(F.sha2("value", 256)).alias("value"))


def fact_objects(spark, sf_dir):
    return P.fact_objects(_reports(spark, sf_dir)).select("artifact", "pointer", F.array_join("evidence_ids", ",").alias("evidence_ids"))


def high_risk(spark, sf_dir):
    return P.high_risk(P.nodes(_reports(spark, sf_dir), texts=False))


def field_assessments(spark, sf_dir):
    p = planted(spark, sf_dir)
    claims = p.filter("doc_id % 3 = 1").select("artifact", F.lit("v2").alias("evidence_id"), F.explode(F.array(F.lit("attributed_to"), F.lit("uses_model"))).alias("predicate"), F.lit("author_inference").alias("claim_type"), F.lit("likely").alias("assertion_status"), F.lit("implicit").alias("author_confidence"))
    by_rules = p.filter("doc_id % 2 = 0").select("artifact", F.lit("v2").alias("evidence_id"))
    return P.assess_fields(_reports(spark, sf_dir), claims=claims, by_rules=by_rules).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def event_merge(spark, sf_dir):
    """Reports of three chunks: each is the event of one document of the family."""
    merged, _ = C.merge_events(_reports(spark, sf_dir, "doc_id AS chunk", "concat(family, '-', doc_id div 60) AS report"), "report")
    found = P.nodes(merged, "report", items=False, texts=False)
    lists = found.filter("kind = 'array' and in_list is null").select("report", "pointer")
    items = found.filter("item = pointer").groupBy("report", F.col("in_list").alias("pointer")).agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.coalesce(F.size("evidence_ids"), F.lit(0))).alias("n_ids"))
    lists = lists.join(items, ["report", "pointer"], "left").select("report", "pointer", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_ids", F.lit(0)).alias("n_ids"), F.lit(None).cast("string").alias("value"))
    return lists.unionByName(found.filter("in_list is null and kind not in ('array', 'object')").select("report", "pointer", F.lit(0).alias("n_items"), F.lit(0).alias("n_ids"), "value"))


QUERIES = {"q_event_merge": event_merge, "q_report_nodes": report_nodes, "q_fact_objects": fact_objects, "q_high_risk_fields": high_risk, "q_field_assessments": field_assessments}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _has(p: str) -> str:
    return f"regexp_matches(text, {_q(p)})"


_WALK = f"""events_ AS (SELECT artifact, doc_id, {_event("to_json(text)", "to_json(signal)")}::JSON AS event FROM planted),
walk(artifact, pointer, name, v) AS (
  SELECT artifact, '', NULL::VARCHAR, event FROM events_
  UNION ALL
  SELECT w.artifact, w.pointer || '/' || replace(replace(c.k, '~', '~0'), '/', '~1'), c.k, c.v FROM walk w, LATERAL (
    SELECT unnest(json_keys(w.v)) AS k, unnest(list_transform(json_keys(w.v), lambda k: json_extract(w.v, '$."' || k || '"'))) AS v WHERE json_type(w.v) = 'OBJECT'
    UNION ALL SELECT unnest(range(json_array_length(w.v)::BIGINT))::VARCHAR, unnest(json_extract(w.v, '$[*]')) WHERE json_type(w.v) = 'ARRAY') c),
nodes AS (
  SELECT artifact, pointer, name, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
    CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN v ->> '$' END AS value, CASE WHEN json_type(v) = 'OBJECT' THEN (v ->> '$.evidence_ids[*]') END AS ids FROM walk)"""
_PATH = r"""'event' || replace(regexp_replace(p, '/(\d+)(/|$)', '[\1]\2', 'g'), '/', '.')"""
_IN_LIST = "|".join(rf"/{p}/\d+" for p in P.ASSESSED_LISTS)
_TOPIC = "CASE " + " ".join(f"WHEN base = '{t}' OR starts_with(base, '{t}.') THEN '{t}'" for t in P.FIELD_PREDICATES) + " END"

_BARE = "CASE json_type(v) WHEN 'OBJECT' THEN list_transform(list_sort(list_filter(json_keys(v), lambda k: k NOT IN ('evidence_ids', 'artifact_id'))), lambda k: k || '=' || json_extract(v, '$.\"' || k || '\"')::VARCHAR)::VARCHAR ELSE v::VARCHAR END"
ORACLE_SQL = {
    "q_event_merge": with_planted(
        f"""{_WALK}, of AS (SELECT artifact, doc_id, family || '-' || (doc_id // 60) AS report FROM planted),
all_ AS (SELECT report, doc_id, pointer, kind, value FROM nodes JOIN of USING (artifact) WHERE NOT regexp_matches(pointer, '/[0-9]+(/|$)')),
shapes AS (SELECT report, pointer, count(DISTINCT CASE WHEN kind IN ('object', 'array') THEN kind ELSE 'scalar' END) AS n FROM all_ WHERE kind <> 'null' GROUP BY 1, 2 HAVING n > 1),
plain AS (SELECT a.* FROM all_ a WHERE NOT EXISTS (SELECT 1 FROM shapes s WHERE s.report = a.report AND (a.pointer = s.pointer OR starts_with(a.pointer, s.pointer || '/')))),
scalars AS (
  SELECT report, pointer, list(DISTINCT kind || value) FILTER (WHERE kind <> 'null' AND value NOT IN ('', 'unknown')) AS known, any_value(value) FILTER (WHERE kind <> 'null' AND value NOT IN ('', 'unknown')) AS one,
    (list(value ORDER BY doc_id))[1] AS first FROM plain WHERE kind NOT IN ('array', 'object') GROUP BY 1, 2),
items AS (SELECT report, regexp_extract(pointer, '^(.*)/[0-9]+$', 1) AS pointer, {_BARE} AS identity, CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.evidence_ids[*]' END AS ids FROM walk JOIN of USING (artifact) WHERE regexp_full_match(pointer, '(/[^/]*[^0-9/][^/]*)+/[0-9]+')),
different AS (SELECT report, pointer, identity, len(list_distinct(flatten(list(coalesce(ids, []))))) AS n FROM items GROUP BY 1, 2, 3),
lists AS (SELECT report, pointer, count(*) AS n_items, sum(n)::BIGINT AS n_ids FROM different GROUP BY 1, 2),
clashes AS (SELECT report, sum(n)::BIGINT AS n FROM (SELECT report, count(*) AS n FROM scalars WHERE len(known) > 1 GROUP BY 1 UNION ALL SELECT report, count(*) FROM shapes GROUP BY 1) GROUP BY 1)
SELECT report, pointer, 0 AS n_items, 0 AS n_ids, CASE WHEN len(known) > 1 THEN CASE WHEN regexp_matches(pointer, '{C.UNKNOWN_FIELDS}') THEN 'unknown' END ELSE coalesce(one, first) END AS value FROM scalars
UNION ALL SELECT report, '/limitations', n, 2 * n, NULL FROM clashes
UNION ALL SELECT report, pointer, 0, 0, NULL FROM shapes
UNION ALL SELECT DISTINCT p.report, p.pointer, coalesce(n_items, 0), coalesce(n_ids, 0), NULL FROM plain p LEFT JOIN lists USING (report, pointer) WHERE kind = 'array'"""
    ),
    "q_report_nodes": with_planted(f"{_WALK} SELECT artifact, pointer, kind, CASE WHEN kind IN ('number', 'boolean') THEN value ELSE sha256(value) END AS value FROM nodes"),
    "q_fact_objects": with_planted(f"{_WALK} SELECT artifact, pointer, array_to_string(ids, ',') AS evidence_ids FROM nodes WHERE len(ids) > 0 AND NOT starts_with(pointer, '/evidence/')"),
    "q_high_risk_fields": with_planted(
        f"{_WALK} SELECT artifact, pointer, value FROM nodes WHERE regexp_full_match(pointer, {_q('|'.join(P.AT_RISK))}) AND value NOT IN ('', 'unknown', 'not_stated') AND NOT (kind = 'boolean' AND value = 'false')"
    ),
    "q_field_assessments": with_planted(
        f"""{_WALK},
objects AS (SELECT artifact, pointer, ids FROM nodes WHERE len(ids) > 0 AND regexp_full_match(pointer, '{"|".join(p for p, _ in P.ASSESSED)}|{_IN_LIST}')),
texts AS (SELECT artifact, text AS t1, signal AS t2, doc_id FROM planted),
fields AS (
  SELECT o.artifact, unnest(CASE pointer WHEN '/identity' THEN ['/identity/event_name', '/identity/event_type'] ELSE [pointer] END) AS p, ids, pointer, doc_id,
    array_to_string(list_filter([CASE WHEN list_contains(ids, 'v1') THEN t1 END, CASE WHEN list_contains(ids, 'v2') THEN t2 END], lambda x: x IS NOT NULL), ' ') AS text
  FROM objects o JOIN texts USING (artifact)),
named AS (SELECT *, {_PATH} AS field_path FROM fields),
based AS (SELECT *, regexp_replace(regexp_replace(field_path, '\\[\\d+\\]', '', 'g'), '^event\\.', '') AS base FROM named),
told AS (SELECT *, doc_id % 3 = 1 AND list_contains(ids, 'v2') AND coalesce({_TOPIC} IN ('attribution', 'ai_signals.toolchain'), true) AS claimed, doc_id % 2 = 0 AND list_contains(ids, 'v2') AS ruled, starts_with(base, 'attribution') AS actor FROM based),
judged AS (
  SELECT *, CASE WHEN field_path = 'event.status' AND {_has(rules.POSSIBLE)} THEN 'author_inference' WHEN {_has(rules.NEGATIVE)} THEN 'negative_evidence' WHEN claimed THEN 'author_inference' WHEN {_has(rules.SPECULATIVE)} OR {_has(rules.POSSIBLE)} THEN 'author_inference'
      WHEN {_has(rules.LIKELY)} OR actor OR {_has(rules.ATTRIBUTION)} THEN 'author_assessment' ELSE 'direct_observation' END AS claim_type,
    CASE WHEN field_path = 'event.status' AND {_has(rules.POSSIBLE)} THEN 'possible' WHEN {_has(rules.NEGATIVE)} THEN 'denied' WHEN claimed THEN 'likely' WHEN {_has(rules.SPECULATIVE)} THEN 'speculative' WHEN {_has(rules.POSSIBLE)} THEN 'possible'
      WHEN {_has(rules.LIKELY)} THEN 'likely' ELSE 'asserted' END AS assertion_status,
    CASE WHEN claimed THEN 'implicit' {" ".join(f"WHEN {_has(p)} {'OR actor' if n == 'explicit_high' else ''} THEN '{n}'" for n, p in rules.CONFIDENCE)} ELSE 'not_stated' END AS author_confidence FROM told)
SELECT artifact, field_path, array_to_string(ids, ',') AS evidence_ids, claim_type, assertion_status, author_confidence,
  CASE WHEN text = '' THEN 'unknown' WHEN assertion_status = 'denied' THEN 'strong' WHEN {_has(rules.CONFIRMED)} AND assertion_status = 'asserted' THEN 'confirmed' WHEN assertion_status IN ('possible', 'speculative') THEN 'weak'
    WHEN assertion_status = 'likely' OR claim_type IN ('author_inference', 'author_assessment') THEN CASE author_confidence WHEN 'explicit_high' THEN 'strong' ELSE 'moderate' END ELSE 'strong' END AS evidence_strength,
  CASE WHEN claimed AND ruled THEN 'hybrid' WHEN claimed THEN 'model_candidate' ELSE 'deterministic_rule' END AS extractor_method, CASE WHEN claimed AND ruled THEN 0.85 WHEN claimed THEN 0.75 ELSE 0.9 END::DOUBLE AS extractor_confidence FROM judged"""
    ),
}
ORACLE_SQL = {name: sql.replace("WITH planted AS", "WITH RECURSIVE planted AS", 1) for name, sql in ORACLE_SQL.items()}
