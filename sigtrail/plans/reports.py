"""Queries over report events, claims, sources and lists, on planted report lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtrail.operators import blocks as B
from sigtrail.operators import events as E
from sigtrail.operators import rules
from sigtrail.operators.evidence import first_wins
from sigtrail.plans.planted import planted, with_planted

LINES = [
    "PROMPTFLUX Dropper was seen in the wild in July 2025", "FRUITSHELL is a reverse shell that can bypass detection", "The group tracked as GTG-1002 used an autonomous AI agent",
    "PROMPTSTEAL generates commands with Qwen2.5-Coder-32B-Instruct and the Hugging Face API against Ukraine", "It is experimental and does not demonstrate an ability to compromise a network",
    "APT28 attacks led to data exfiltration in mid March 2024", "A proof of concept copies itself to removable drives and network shares", "LAMEHUG uses Claude and APT28 is behind it",
]
_CASE = "CASE " + " ".join(f"WHEN {{i}} = {k} THEN '{x}'" for k, x in enumerate(LINES)) + " ELSE '' END"
_TEXT = "concat(" + ", chr(10), ".join(_CASE.replace("{i}", f"(doc_id + {k}) % {m}") for k, m in ((0, 11), (3, 13), (5, 17))) + ", chr(10), signal)"
_SQL = f"reports AS (SELECT artifact, doc_id, family, {_TEXT} AS text FROM planted)"
_LINES = """lines AS (SELECT artifact, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS index FROM (SELECT artifact, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM reports))"""


def _reports(spark, sf_dir):
    return planted(spark, sf_dir).selectExpr("artifact", "doc_id", "family", f"{_TEXT} AS text")


def _blocks(spark, sf_dir):
    return B.line_blocks(_reports(spark, sf_dir))


def event_facts(spark, sf_dir):
    return E.facts(_blocks(spark, sf_dir)).select("artifact", "fact_group", "value", F.col("index").cast("long").alias("first_index"))


TOOL_LINES = ["It calls gpt-3.5-turbo by the OpenAI chat completions API", "a gpt-oss: 20b model runs", "Ollama API", "large language models help", "the Gemini API", "Claude Code with MCP tools ran unattended", "results are saved to disk by human operators", "GPT-4"]
_TOOL_TEXT = "concat_ws(chr(10), " + ", ".join(f"CASE (doc_id + {k}) % {m} " + " ".join(f"WHEN {j} THEN '{x}'" for j, x in enumerate(TOOL_LINES)) + " ELSE 'none' END" for k, m in ((0, 11), (4, 13))) + ")"


def _tool_blocks(spark, sf_dir):
    return B.line_blocks(planted(spark, sf_dir).selectExpr("artifact", f"{_TOOL_TEXT} AS text"))


def report_toolchain(spark, sf_dir):
    t = E.toolchain(_tool_blocks(spark, sf_dir))
    return t.select("artifact", "provider", "family", "model", "service", "agent", "deployment", F.array_join(F.transform("evidence", lambda i: i.cast("string")), ",").alias("evidence"))


def involvement(spark, sf_dir):
    return E.involvement(_tool_blocks(spark, sf_dir))


def event_months(spark, sf_dir):
    return E.first_month(_blocks(spark, sf_dir)).groupBy("start").agg(F.count(F.lit(1)).alias("n"))


def report_claims(spark, sf_dir):
    terms = rules.dictionary_terms(_blocks(spark, sf_dir), ["artifact", "index", "text"])
    return E.claims(terms.drop("text"), ["artifact", "index"]).groupBy("predicate", "subject", "object").agg(F.count(F.lit(1)).alias("n"))


def entity_merge(spark, sf_dir):
    p = planted(spark, sf_dir).select(F.concat(F.lit("e"), F.col("doc_id") % 37).alias("entity_id"), "family", F.col("family").alias("name"), F.array("lang", "family").alias("aliases"))
    m = E.merge_entities(p)
    return m.select("entity_id", "name", F.array_join("aliases", ",").alias("aliases"), "n_mentions")


def purposes(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy(E.purpose(F.col("text")).alias("purpose")).agg(F.count(F.lit(1)).alias("n"))


def base64_constants(spark, sf_dir):
    p = planted(spark, sf_dir).select("artifact", F.concat(F.lit("x = "), F.base64(F.encode(F.concat(F.lit("You are an assistant that writes things for number "), F.col("doc_id")), "UTF-8")), F.lit(" ;")).alias("text"))
    return E.base64_constants(p).select("artifact", "decoded")


def code_metrics(spark, sf_dir):
    source = F.concat(F.lit("# head\n\nvalue_one = "), F.col("doc_id"), F.lit("\ndef run(x):\n    # "), F.col("family"), F.lit("\n    return x\n"))
    return E.code_metrics(planted(spark, sf_dir).select("artifact", source.alias("text")))


def unit_split(spark, sf_dir):
    parts = E.split_units(planted(spark, sf_dir), "artifact", "text", 500)
    return parts.groupBy("artifact").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.length("content")).alias("chars"))


def hash_links(spark, sf_dir):
    p = planted(spark, sf_dir).select("doc_id", F.concat(F.sha2("artifact", 256), F.lit("; "), F.upper(F.sha2("family", 256)), F.lit(";short; ")).alias("list"))
    each = p.select("doc_id", F.explode(F.split("list", ";")).alias("h")).select("doc_id", F.lower(F.trim("h")).alias("sample"))
    return each.filter(F.length("sample") == 64).groupBy("sample").agg(F.count(F.lit(1)).alias("n_events"))


def context_names(spark, sf_dir):
    p = planted(spark, sf_dir)
    names = F.array(F.upper("lang"), F.col("lang"), F.col("family"), F.lit(""))
    rows = p.select("artifact", F.posexplode(names).alias("pos", "name")).filter(F.trim("name") != "").withColumn("k", F.lower(F.trim("name")))
    kept = first_wins(rows, ["artifact", "k"], ["pos"])
    return kept.groupBy("artifact").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ",").alias("names"))


def issue_buckets(spark, sf_dir):
    p = _reports(spark, sf_dir)
    tests = {"no_signal": F.length(F.trim("text")) == 0, "model": F.col("text").rlike("gpt-"), "actor": F.contains("text", F.lit("APT28")), "odd": F.col("doc_id") % 2 == 1}
    labels = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))
    return p.select(F.explode(labels).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def paging(spark, sf_dir):
    p = planted(spark, sf_dir).select("doc_id", "family", "event_date")
    return p.orderBy(F.col("event_date").desc_nulls_last(), "doc_id").offset(20).limit(15)  # a page is the feature


def manifest(spark, sf_dir):
    p = planted(spark, sf_dir).select("doc_id", F.sha2("family", 256).alias("sha256"), "family")
    return first_wins(p.filter(F.col("sha256").rlike("^[a-f0-9]{64}$")), ["sha256"], ["doc_id"]).select("sha256", "family", "doc_id")


QUERIES = {
    "q_report_toolchain": report_toolchain, "q_involvement": involvement, "q_event_facts": event_facts, "q_event_months": event_months, "q_report_claims": report_claims,
    "q_entity_merge": entity_merge, "q_purposes": purposes, "q_base64_constants": base64_constants, "q_code_metrics": code_metrics, "q_unit_split": unit_split, "q_hash_links": hash_links,
    "q_context_names": context_names, "q_issue_buckets": issue_buckets, "q_paging": paging, "q_manifest": manifest,
}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _flat(pattern: str) -> str:
    """DuckDB's expressions have no look-behind: word boundaries do in ASCII text."""
    return pattern.replace(r"(?<![A-Za-z0-9])", r"\b").replace(r"(?![A-Za-z0-9])", r"\b")


_FACTS = "facts AS (" + " UNION ALL ".join(f"SELECT artifact, '{g}' AS fact_group, {_q(v)} AS value, min(index) AS first_index FROM lines WHERE regexp_matches(text, {_q(_flat(p))}) GROUP BY 1" for g, v, p in E.FACT_RULES) + ")"
_ALL = f"{_SQL}, {_LINES}"
_NO = r"[^A-Za-z0-9_-]"
_TERMS = " UNION ALL ".join(f"SELECT artifact, index, '{k}' AS t, '{x}' AS term FROM lines WHERE regexp_matches(text, '(?i)(^|{_NO}){x.replace('.', chr(92) + '.')}($|{_NO})')" for k, xs in rules.REPORT_TERMS.items() for x in xs)
_MONTH = "'" + E.MONTH + "'"
_MONTH_NUMBER = "list_position([" + ", ".join(f"'{m}'" for m in E.MONTHS) + f"], regexp_extract(text, {_MONTH}, 1))"
_START = f"regexp_extract(text, {_MONTH}, 2) || '-' || lpad(({_MONTH_NUMBER})::VARCHAR, 2, '0')"
_MONTHS = f"months AS (SELECT artifact, min_by({_START}, index) AS start FROM lines WHERE regexp_matches(text, {_MONTH}) GROUP BY 1)"

_TOOLS = [*E.MODEL_RULES, *E.SERVICE_RULES]
_NULL = lambda x: "NULL::VARCHAR" if x is None else _q(x)
_TOOL_HITS = " UNION ALL ".join(
    f"SELECT artifact, {n} AS rule, {_NULL(pr)} AS provider, {_NULL(fa)} AS family, {_NULL(mo)} AS model, {_NULL(se)} AS service, {_NULL(ag)} AS agent, {_NULL(de)} AS deployment, min(index) AS i FROM l WHERE regexp_matches(text, {_q(_flat(p))}) GROUP BY 1"
    for n, (p, pr, fa, mo, se, ag, de) in enumerate([(*t[:5], None, t[5]) for t in _TOOLS] + [(E.AGENT_PROTOCOL, None, None, None, None, "MCP", "unknown"), (E.ANY_MODEL, None, "LLM", None, None, None, "unknown")])
)
_TOOL_LINES = f"l AS (SELECT artifact, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS index FROM (SELECT artifact, string_split({_TOOL_TEXT}, chr(10)) AS x FROM planted))"
ORACLE_SQL = {
    "q_report_toolchain": with_planted(
        f"""{_TOOL_LINES}, h AS ({_TOOL_HITS}), k AS (SELECT * FROM h WHERE rule < {len(_TOOLS) + 1} OR artifact NOT IN (SELECT artifact FROM h WHERE rule < {len(_TOOLS) + 1})),
m AS (SELECT artifact, coalesce(provider, '-') AS p, service, min(rule) AS lead FROM k WHERE service IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT k.*, CASE WHEN k.rule BETWEEN {len(E.MODEL_RULES)} AND {len(_TOOLS) - 1} THEN coalesce(m.lead, k.rule) ELSE k.rule END AS owner FROM k LEFT JOIN m ON m.artifact = k.artifact AND m.p = coalesce(k.provider, '-') AND m.service = k.service),
g AS (SELECT artifact, owner, string_agg(DISTINCT i::VARCHAR, ',' ORDER BY i::VARCHAR) AS evidence FROM o GROUP BY 1, 2)
SELECT g.artifact, provider, family, model, service, agent, deployment, evidence FROM g JOIN h ON h.artifact = g.artifact AND h.rule = g.owner"""
    ),
    "q_involvement": with_planted(
        f"""{_TOOL_LINES} SELECT artifact, CASE WHEN bool_or(regexp_matches(text, {_q(E.AUTONOMY[0][1])})) THEN 'unattended' WHEN bool_or(regexp_matches(text, {_q(E.AUTONOMY[1][1])})) THEN 'human_on_loop' ELSE 'unknown' END AS autonomy,
CASE WHEN bool_or(regexp_matches(text, {_q(E.OUTPUT[0][1])})) THEN 'blindly_executed' WHEN bool_or(regexp_matches(text, {_q(E.OUTPUT[1][1])})) THEN 'saved_to_file' ELSE 'unknown' END AS output_handling, bool_or(regexp_matches(text, {_q(E.HUMANS)})) AS human_role FROM l GROUP BY 1"""
    ),
    "q_event_facts": with_planted(f"{_ALL}, {_FACTS} SELECT * FROM facts"),
    "q_event_months": with_planted(f"{_ALL}, {_MONTHS} SELECT start, count(*) AS n FROM months GROUP BY 1"),
    "q_report_claims": with_planted(
        f"""{_ALL}, t AS ({_TERMS}), a AS (SELECT unnest([{", ".join(_q(p) for p, _, _ in E.CLAIM_TYPES)}]) AS predicate, unnest([{", ".join(_q(s) for _, s, _ in E.CLAIM_TYPES)}]) AS st, unnest([{", ".join(_q(o) for _, _, o in E.CLAIM_TYPES)}]) AS ot),
c AS (SELECT DISTINCT s.artifact, s.index, predicate, s.term AS subject, o.term AS object FROM t s JOIN a ON s.t = st JOIN t o ON o.t = ot AND s.artifact = o.artifact AND s.index = o.index)
SELECT predicate, subject, object, count(*) AS n FROM c GROUP BY 1, 2, 3"""
    ),
    "q_entity_merge": with_planted(
        "m AS (SELECT 'e' || (doc_id % 37) AS entity_id, family, unnest([lang, family]) AS alias FROM planted) SELECT entity_id, min(family) AS name, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases, count(*) // 2 AS n_mentions FROM m GROUP BY 1"
    ),
    "q_purposes": with_planted(
        f"""{_ALL}, p AS (SELECT lower(text) AS t FROM lines) SELECT CASE WHEN regexp_matches(t, 'rewrite|self-modification|regeneration') THEN 'self_rewriting' WHEN contains(t, 'command') AND contains(t, 'generate') THEN 'command_generation'
WHEN regexp_matches(t, 'ransomware code|lua scripts') THEN 'malicious_code_generation' WHEN contains(t, 'search') AND regexp_matches(t, 'secret|token') THEN 'secret_discovery' WHEN regexp_matches(t, 'orchestrat|sub-agent') THEN 'attack_orchestration'
WHEN regexp_matches(t, 'enumerat|travers') THEN 'post_compromise_operations' END AS purpose, count(*) AS n FROM p GROUP BY 1"""
    ),
    "q_base64_constants": with_planted("SELECT artifact, 'You are an assistant that writes things for number ' || doc_id AS decoded FROM planted"),
    "q_code_metrics": with_planted(
        r"""s AS (SELECT artifact, '# head' || chr(10) || chr(10) || 'value_one = ' || doc_id || chr(10) || 'def run(x):' || chr(10) || '    # ' || family || chr(10) || '    return x' || chr(10) AS t FROM planted),
w AS (SELECT artifact, string_split(t, chr(10)) AS l, regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]*') AS w FROM s)
SELECT artifact, len(l) AS loc, round(len(list_filter(l, lambda x: trim(x) = '')) / len(l), 6) AS blank_ratio, round(len(list_filter(l, lambda x: starts_with(trim(x), '#'))) / len(l), 6) AS comment_ratio,
  round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6)::DOUBLE AS mean_identifier_length FROM w"""
    ),
    "q_unit_split": with_planted("SELECT artifact, greatest(1, ceil(length(text) / 500.0))::BIGINT AS n_parts, length(text)::BIGINT AS chars FROM planted"),
    "q_hash_links": with_planted("h AS (SELECT sha256(artifact) AS sample FROM planted UNION ALL SELECT sha256(family) FROM planted) SELECT sample, count(*) AS n_events FROM h GROUP BY 1"),
    "q_context_names": with_planted("SELECT artifact, upper(lang) || ',' || family AS names FROM planted"),
    "q_issue_buckets": with_planted(
        f"{_SQL}, i AS (SELECT unnest(list_filter([CASE WHEN length(trim(text)) = 0 THEN 'no_signal' END, CASE WHEN contains(text, 'gpt-') THEN 'model' END, CASE WHEN contains(text, 'APT28') THEN 'actor' END, CASE WHEN doc_id % 2 = 1 THEN 'odd' END], lambda x: x IS NOT NULL)) AS issue FROM reports) SELECT issue, count(*) AS n FROM i GROUP BY 1"
    ),
    "q_paging": with_planted("SELECT doc_id, family, event_date FROM planted ORDER BY event_date DESC NULLS LAST, doc_id LIMIT 15 OFFSET 20"),
    "q_manifest": with_planted("SELECT sha256(family) AS sha256, family, min(doc_id) AS doc_id FROM planted GROUP BY family"),
}
