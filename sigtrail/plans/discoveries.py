"""Queries over the events that reports name: reports are planted lines and the whole text of each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtrail.operators import assess as A
from sigtrail.operators import blocks as B
from sigtrail.operators import discovery as D
from sigtrail.operators import events as E
from sigtrail.operators.store import written
from sigtrail.plans.planted import planted, with_planted

LINES = [
    "Overview of promptflux and others", "PROMPTFLUX Dropper was seen in the wild in July 2025", "promptlock is an experimental ransomware, a proof of concept that can generate commands",
    "The malware dubbed FruitShell-X may rewrite itself: its prompt says output only the code", "The group tracked as GTG-1002 used an autonomous AI agent in live operations", "About LameHug/LAMEHUG2 and PromptSteal",
    "We track as QUIETVAULT what was reported in May as VAULTNINE", "QUIETVAULT is not used in the wild", "Ministry Targeted With Hermes AI Agent", "DARKSHELL in a table", "then DARKSHELL, a credential stealer",
    "PROMPTFLUX (aka FluxOne) is what FluxOne (also known as PromptFluxPlus) was", "VAULTNINE (aka QUIETVAULT) and its data miner", "The payload named DropZone is compiled in Golang with PyInstaller", "Hermes left a prompt to collect and output data; it then executes it",
    "A prompt of QUIETVAULT to act as a shell: output only one-line commands", "Summary",
]
_PARTS = [f"CASE WHEN doc_id % {k + 3} < 2 THEN '{x}' ELSE '' END" for k, x in enumerate(LINES)]
_HASH = "CASE WHEN doc_id % 4 = 1 THEN concat('QUIETVAULT ', md5(artifact), upper(md5(artifact))) ELSE '' END"
_TEXT = "concat(" + ", chr(10), ".join([*_PARTS[:-1], _HASH, "text", _PARTS[-1]]) + ")"
_HEADING = "(starts_with(text, 'About ') OR starts_with(text, 'Overview ') OR text = 'Summary')"
TARGET_FAMILY = "FluxOne"


def _blocks(spark, sf_dir):
    heading = lambda x: x.startswith("About ") | x.startswith("Overview ") | (x == "Summary")
    lines = B.sectioned_lines(planted(spark, sf_dir).selectExpr("artifact", f"{_TEXT} AS text"), heading)
    # Split and put in sections once: discovery and contexts read the blocks several times.
    return written(lines.withColumn("kind", F.when(heading(F.col("text")), "heading").otherwise("paragraph")), "blocks", "zstd")


def _targets(spark, sf_dir):
    """One target for every fifth document: a family of another name, which its text holds or doesn't."""
    return planted(spark, sf_dir).filter("doc_id % 5 = 0").select("artifact", F.lit(TARGET_FAMILY).alias("name"), F.array(F.lit("PromptFluxPlus")).alias("aliases"), F.lit("target").alias("hint"))


def event_discovery(spark, sf_dir):
    found = D.discover(_blocks(spark, sf_dir), targets=_targets(spark, sf_dir))
    return found.select("artifact", "name_key", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join("hints", "|").alias("hints"), F.col("first_index").cast("long").alias("first_index"), "n_anchors")


def _context(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    candidates = written(D.discover(b), "events")
    return written(D.with_terms(D.contexts(b, candidates), candidates), "context", "zstd")


def event_contexts(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return D.contexts(b, D.discover(b)).groupBy("artifact", "name_key").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("index").alias("sum_index"))


def event_status(spark, sf_dir):
    c = _context(spark, sf_dir)
    status = A.grounded_status(c, "event_id", "term").select("event_id", "status")
    return c.select("event_id", "artifact", "name_key").distinct().join(status, "event_id").select("artifact", "name_key", "status")


def event_assembly(spark, sf_dir):
    e = D.assembled(_context(spark, sf_dir))
    return e.select("artifact", "name", "event_type", "status", "start", F.coalesce(F.size("facts"), F.lit(0)).cast("long").alias("n_facts"), F.array_join(F.transform("facts", lambda f: f["value"]), "|").alias("facts"))


def event_artifacts(spark, sf_dir):
    c = _context(spark, sf_dir)
    kinds = D.assembled(c).select("event_id", "event_type")
    out = D.artifacts(c, kinds).join(c.select("event_id", "artifact", "name_key").distinct(), "event_id")
    return out.select("artifact", "name_key", "family", F.array_join("sha256", ",").alias("sha256"), "scope", "role", "language", "packer")


def event_prompts(spark, sf_dir):
    c = _context(spark, sf_dir)
    out = D.prompt_mentions(c).join(c.select("event_id", "artifact", "name_key").distinct(), "event_id")
    return out.select("artifact", "name_key", "purpose", F.col("index").cast("long").alias("index"), "n_blocks", F.array_join("constraints", ",").alias("constraints"), "evasion", "effectiveness")


QUERIES = {
    "q_event_discovery": event_discovery, "q_event_contexts": event_contexts, "q_event_status": event_status, "q_event_assembly": event_assembly, "q_event_artifacts": event_artifacts, "q_event_prompts": event_prompts,
}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _flat(pattern: str) -> str:
    """DuckDB's expressions have no look-behind: word boundaries do in ASCII text."""
    return pattern.replace(r"(?<![A-Za-z0-9])", r"\b").replace(r"(?![A-Za-z0-9])", r"\b")


def _rule(rule, pattern, name, hint, alias, empty, first, heading) -> str:
    every = lambda g: f"regexp_extract_all(text, {_q(pattern)}, {g})" + ("[1:1]" if first else "")
    columns = [f"unnest({every(name)}) AS name", f"generate_subscripts({every(name)}, 1) AS n", f"unnest({every(hint)}) AS hint" if isinstance(hint, int) else f"{'NULL' if hint is None else _q(hint)} AS hint"]
    columns += [f"unnest({every(alias)}) AS alias" if alias else "NULL AS alias", f"unnest({every(empty)}) AS unless" if empty else "'' AS unless"]
    return f"SELECT artifact, index, {rule} AS rule, {', '.join(columns)} FROM lines" + (" WHERE kind = 'heading'" if heading else "")


_LINES = f"""reports AS (SELECT artifact, doc_id, {_TEXT} AS text FROM planted),
split AS (SELECT artifact, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS index FROM (SELECT artifact, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM reports)),
lines AS (SELECT *, CASE WHEN {_HEADING} THEN 'heading' ELSE 'paragraph' END AS kind, last_value(CASE WHEN {_HEADING} THEN text END IGNORE NULLS) OVER (PARTITION BY artifact ORDER BY index) AS section FROM split)"""
_NO = ", ".join(map(_q, D.NO_NAMES))
_TARGETS = f"""SELECT artifact, index, [2, index, coalesce(n, 0)] AS ord, '{TARGET_FAMILY}' AS name, 'PromptFluxPlus' AS alias, 'target' AS hint FROM (
  SELECT l.artifact, index, 0 AS n FROM lines l JOIN planted p ON p.artifact = l.artifact AND doc_id % 5 = 0 WHERE regexp_matches(l.text, '(?i)\\b({TARGET_FAMILY}|PromptFluxPlus)\\b') OR regexp_matches(section, '(?i)\\b({TARGET_FAMILY}|PromptFluxPlus)\\b'))"""


def _events(targets: bool) -> str:
    return f"""{_LINES},
by_rule AS ({" UNION ALL ".join(_rule(*r) for r in D.NAME_RULES)}),
tokens AS (SELECT artifact, index, unnest(regexp_extract_all(text, {_q(D.TOKEN)})) AS name FROM lines),
twice AS (SELECT artifact, name, min(index) AS first FROM tokens WHERE name NOT IN ({_NO}) AND NOT regexp_matches(name, {_q(D.NO_TOKEN)}) AND regexp_matches(name, {_q(D.TOKEN_WORDS)}) GROUP BY 1, 2 HAVING count(*) > 1),
near AS (
  SELECT t.artifact, t.name, w.first, t.index AS place, string_agg(b.text, ' ' ORDER BY b.index) AS around FROM (SELECT DISTINCT * FROM tokens) t JOIN twice w USING (artifact, name)
  JOIN lines b ON b.artifact = t.artifact AND b.index BETWEEN t.index - {D.NEAR_BLOCKS} AND t.index + {D.NEAR_BLOCKS} GROUP BY 1, 2, 3, 4),
every AS (
  SELECT artifact, index, [0, index, rule * 1000 + n] AS ord, CASE WHEN rule = {D.AGENT_RULE} THEN name || ' intrusion' ELSE name END AS name, alias, hint FROM by_rule
  WHERE unless = '' AND (rule <> {D.CAMEL_RULE} OR regexp_matches(name, {_q(D.CAMEL_WORDS)}))
  UNION ALL SELECT DISTINCT artifact, first, [1, first, 0], name, NULL, 'malware' FROM near WHERE regexp_matches(around, {_q(D.NEAR_TOKEN)})
  {"UNION ALL " + _TARGETS if targets else ""}),
said AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS name_key FROM every WHERE length(name) >= 4 AND upper(name) NOT IN ({_NO})),
pairs AS (
  SELECT artifact, index, unnest(regexp_extract_all(text, {_q(D.ALSO_KNOWN)}, 1)) AS a, unnest(regexp_extract_all(text, {_q(D.ALSO_KNOWN)}, 2)) AS b, generate_subscripts(regexp_extract_all(text, {_q(D.ALSO_KNOWN)}, 1), 1) AS n FROM lines),
edges AS (SELECT artifact, lower(a) AS a, lower(b) AS b FROM pairs UNION SELECT artifact, lower(b), lower(a) FROM pairs),
reach(artifact, node, other) AS (SELECT artifact, a, a FROM edges UNION SELECT r.artifact, r.node, e.b FROM reach r JOIN edges e ON e.artifact = r.artifact AND e.a = r.other),
component AS (SELECT artifact, node, min(other) AS grp FROM reach GROUP BY 1, 2),
firsts AS (SELECT artifact, name_key, arg_min(name, ord) AS name, min(ord) AS ord, min(index) AS first_index FROM said GROUP BY 1, 2),
members AS (SELECT f.*, coalesce(c.grp, lower(f.name)) AS grp FROM firsts f LEFT JOIN component c ON c.artifact = f.artifact AND c.node = lower(f.name)),
leads AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY artifact, grp ORDER BY NOT (upper(name) = name AND regexp_matches(name, '[A-Z]')), first_index, ord) = 1),
mine AS (SELECT s.*, m.grp FROM said s JOIN members m USING (artifact, name_key)),
others AS (
  SELECT artifact, grp, alias, ord FROM mine WHERE alias <> '' UNION ALL SELECT artifact, grp, name, ord FROM members
  UNION ALL SELECT p.artifact, c.grp, p.alias, [3, p.index, p.n - 1] FROM (SELECT artifact, index, n, unnest([a, b]) AS alias FROM pairs) p JOIN component c ON c.artifact = p.artifact AND c.node = lower(p.alias)),
alias_lists AS (SELECT artifact, grp, list(alias ORDER BY ord, alias) AS aliases FROM (SELECT o.artifact, o.grp, alias, min(o.ord) AS ord FROM others o JOIN leads l ON l.artifact = o.artifact AND l.grp = o.grp WHERE lower(alias) <> lower(l.name) GROUP BY 1, 2, 3) GROUP BY 1, 2),
hint_lists AS (SELECT artifact, grp, list(hint ORDER BY ord, hint) AS hints FROM (SELECT artifact, grp, hint, min(ord) AS ord FROM mine WHERE hint IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
anchors AS (SELECT artifact, grp, min(index) AS first_index, count(DISTINCT index) AS n_anchors FROM mine GROUP BY 1, 2),
found AS (
  SELECT l.artifact, l.name_key, l.name, coalesce(aliases, []) AS aliases, coalesce(hints, []) AS hints, a.first_index, n_anchors FROM leads l JOIN anchors a ON a.artifact = l.artifact AND a.grp = l.grp
  LEFT JOIN alias_lists x ON x.artifact = l.artifact AND x.grp = l.grp LEFT JOIN hint_lists h ON h.artifact = l.artifact AND h.grp = l.grp)"""


_CONTEXT = f"""{_events(False)},
terms AS (SELECT DISTINCT artifact, name_key, lower(t) AS t FROM (SELECT artifact, name_key, unnest(list_concat([name, string_split(name, ' ')[1]], aliases)) AS t FROM found) WHERE t <> ''),
hits AS (
  SELECT l.artifact, l.index, t.name_key, bool_or(contains(lower(l.text), t.t)) AS in_text, coalesce(bool_or(contains(lower(l.section), t.t)), false) AS in_section
  FROM lines l JOIN terms t USING (artifact) GROUP BY 1, 2, 3),
n_events AS (SELECT artifact, count(*) AS n, min(name_key) AS only_key FROM found GROUP BY 1),
owners AS (SELECT artifact, index, CASE WHEN bool_or(in_section) THEN list(name_key) FILTER (WHERE in_section) ELSE list(name_key) FILTER (WHERE in_text) END AS o FROM hits GROUP BY 1, 2),
ends AS (SELECT l.artifact, (SELECT min(index) FROM hits h WHERE h.artifact = l.artifact AND (in_text OR in_section)) AS first, max(index) FILTER (WHERE lower(section) = 'summary') AS last FROM lines l GROUP BY 1),
nearest AS (
  SELECT o.artifact, o.index, h.name_key, min(abs(o.index - h.index)) AS distance FROM owners o JOIN hits h ON h.artifact = o.artifact AND (h.in_text OR h.in_section) AND abs(o.index - h.index) <= {D.REACH}
  WHERE o.o IS NULL GROUP BY 1, 2, 3),
best AS (SELECT artifact, index, arg_min(name_key, distance) AS name_key FROM nearest n GROUP BY 1, 2 HAVING count(*) FILTER (WHERE distance = (SELECT min(distance) FROM nearest m WHERE m.artifact = n.artifact AND m.index = n.index)) = 1),
placed AS (
  SELECT l.artifact, e.only_key AS name_key, l.index FROM lines l JOIN n_events e ON e.artifact = l.artifact AND e.n = 1 JOIN ends s ON s.artifact = l.artifact
  WHERE s.first IS NULL OR (l.index >= s.first - {D.BEFORE_FIRST} AND (s.last IS NULL OR l.index <= s.last))
  UNION ALL SELECT o.artifact, o.o[1], o.index FROM owners o JOIN n_events e ON e.artifact = o.artifact AND e.n > 1 WHERE len(o.o) = 1
  UNION ALL SELECT b.artifact, b.name_key, b.index FROM best b JOIN n_events e ON e.artifact = b.artifact AND e.n > 1),
context AS (SELECT p.artifact, p.name_key, p.index, l.text, f.name, f.aliases, f.hints FROM placed p JOIN lines l USING (artifact, index) JOIN found f USING (artifact, name_key))"""
# Distances of the best are told apart by a rank, as DuckDB would run the subquery above for each row.
_CONTEXT = _CONTEXT.replace(
    _CONTEXT[_CONTEXT.index("best AS (") : _CONTEXT.index("placed AS (")],
    """best AS (
  SELECT artifact, index, any_value(name_key) AS name_key FROM (SELECT *, rank() OVER (PARTITION BY artifact, index ORDER BY distance) AS r FROM nearest) WHERE r = 1 GROUP BY 1, 2 HAVING count(*) = 1),
""",
)
_TYPE_OF = """CASE WHEN contains(t, 'cyber espionage') THEN 'cyber_espionage' WHEN (contains(t, 'android') OR contains(t, '安卓')) AND (contains(t, 'malware') OR contains(t, '恶意软件')) THEN 'malware_operation'
  WHEN regexp_matches(t, 'ransomware|勒索软件') AND regexp_matches(t, 'reverse shell|反向 ?shell') THEN 'malware_operation' WHEN regexp_matches(t, 'ransomware|勒索软件') THEN 'ransomware'
  WHEN regexp_matches(t, 'malware|dropper|data miner|credential stealer|reverse shell|恶意软件|恶意程序') THEN 'malware_operation' WHEN regexp_matches(t, 'intrusion|compromise multiple systems') THEN 'intrusion'
  WHEN regexp_matches(t, 'proof.of.concept') THEN 'proof_of_concept' ELSE 'unknown' END"""
_TYPES = f"""kinds AS (SELECT artifact, name_key, arg_min(k, (CASE k WHEN 'unknown' THEN 1000000000 ELSE 0 END) + index) AS event_type FROM (SELECT artifact, name_key, index, {_TYPE_OF} AS k FROM (SELECT *, lower(text) AS t FROM context)) GROUP BY 1, 2)"""
_STATUS_HITS = " UNION ALL ".join(
    f"SELECT *, {n} AS n, '{v}' AS value, strpos(lower(text), lower(regexp_extract(text, {_q(_flat(p))}))) AS place FROM marked WHERE regexp_matches(text, {_q(_flat(p))})"
    for n, (v, p) in enumerate([("observed_in_operations", r"(?i)\bObserved\b"), ("observed_in_operations", r"(?i)\bin operations\b"), *A.STATUS_RULES])
)
# Lines that name an event are planted and shorter than NEAR_CHARS, so both are near there.
_STATUS = f"""marked AS (
  SELECT c.artifact, c.name_key, c.index, c.text, bool_or(named) OVER (PARTITION BY artifact, name_key ORDER BY index RANGE BETWEEN {A.NEAR_BLOCKS} PRECEDING AND {A.NEAR_BLOCKS} FOLLOWING) AS close, named
  FROM (SELECT *, len(list_filter(list_concat([name], aliases), lambda x: regexp_matches(text, '(?i)\\b' || regexp_escape(x) || '\\b'))) > 0 AS named FROM context) c),
status_hits AS ({_STATUS_HITS}),
first_hits AS (SELECT * FROM status_hits QUALIFY row_number() OVER (PARTITION BY artifact, name_key, n ORDER BY index) = 1),
good AS (
  SELECT * FROM first_hits WHERE CASE WHEN named THEN length(text) <= {A.NEAR_CHARS} ELSE length(text) <= {A.SHORT_BLOCK} AND close END
  AND NOT (n >= 2 AND value = 'observed_in_operations' AND (regexp_matches(substr(text, greatest(place - {A.BEFORE}, 1), least(place - 1, {A.BEFORE})), {_q(A.DENIED)}) OR contains(lower(text), 'does not')))),
ranked AS (
  SELECT artifact, name_key, n, value FROM good WHERE n >= 2 UNION ALL SELECT artifact, name_key, -1, 'observed_in_operations' FROM good WHERE n < 2 GROUP BY 1, 2 HAVING count(*) = 2),
statuses AS (SELECT c.artifact, c.name_key, coalesce(arg_min(r.value, r.n), 'unknown') AS status FROM (SELECT DISTINCT artifact, name_key FROM context) c LEFT JOIN ranked r USING (artifact, name_key) GROUP BY 1, 2)"""
_FACTS = "facts AS (" + " UNION ALL ".join(f"SELECT DISTINCT artifact, name_key, '{g}' AS fact_group, {_q(v)} AS value FROM context WHERE regexp_matches(text, {_q(_flat(p))})" for g, v, p in E.FACT_RULES) + ")"
_MONTH = _q(E.MONTH)
_NUMBER = "list_position([" + ", ".join(map(_q, E.MONTHS)) + f"], regexp_extract(text, {_MONTH}, 1))"
_PURPOSE = """CASE WHEN regexp_matches(t, 'rewrite|self-modification|regeneration') THEN 'self_rewriting' WHEN contains(t, 'command') AND contains(t, 'generate') THEN 'command_generation'
WHEN regexp_matches(t, 'ransomware code|lua scripts') THEN 'malicious_code_generation' WHEN contains(t, 'search') AND regexp_matches(t, 'secret|token') THEN 'secret_discovery' WHEN regexp_matches(t, 'orchestrat|sub-agent') THEN 'attack_orchestration'
WHEN regexp_matches(t, 'enumerat|travers') THEN 'post_compromise_operations' WHEN regexp_matches(t, '""" + A.REPORT_FLAGS["evasion"] + """') THEN 'analysis_evasion' WHEN contains(t, 'collect') THEN 'data_collection' ELSE '' END"""
_FLAGS = ["role_definition", "output_only", "code_only", "single_line_command"]
_ROLE_LABELS = "[" + ", ".join(_q(label) for label, _ in D.ROLES) + "]"
_ROLE_NAMES = "[" + ", ".join(_q(role) for _, role in D.ROLES) + "]"
_ESCAPED = "regexp_escape(family)"

ORACLE_SQL = {
    "q_event_discovery": with_planted(f"RECURSIVE_ {_events(True)} SELECT artifact, name_key, name, array_to_string(aliases, '|') AS aliases, array_to_string(hints, '|') AS hints, first_index, n_anchors FROM found"),
    "q_event_contexts": with_planted(f"RECURSIVE_ {_CONTEXT} SELECT artifact, name_key, count(*) AS n_blocks, sum(index)::BIGINT AS sum_index FROM context GROUP BY 1, 2"),
    "q_event_status": with_planted(f"RECURSIVE_ {_CONTEXT}, {_STATUS} SELECT * FROM statuses"),
    "q_event_assembly": with_planted(
        f"""RECURSIVE_ {_CONTEXT}, {_STATUS}, {_TYPES}, {_FACTS}, months AS (SELECT artifact, name_key, arg_min(regexp_extract(text, {_MONTH}, 2) || '-' || lpad({_NUMBER}::VARCHAR, 2, '0'), index) AS start FROM context WHERE regexp_matches(text, {_MONTH}) GROUP BY 1, 2),
lists AS (SELECT artifact, name_key, count(*) AS n_facts, string_agg(value, '|' ORDER BY fact_group, value) AS facts FROM facts GROUP BY 1, 2)
SELECT s.artifact, f.name, event_type, CASE WHEN n_facts IS NULL THEN 'unknown' ELSE status END AS status, CASE WHEN n_facts IS NOT NULL THEN start END AS start, coalesce(n_facts, 0) AS n_facts, facts
FROM statuses s JOIN found f USING (artifact, name_key) JOIN kinds USING (artifact, name_key) LEFT JOIN lists USING (artifact, name_key) LEFT JOIN months USING (artifact, name_key)"""
    ),
    "q_event_artifacts": with_planted(
        f"""RECURSIVE_ {_CONTEXT}, {_TYPES},
known AS (
  SELECT f.artifact, f.name_key, 0 AS part, f.name AS family, f.aliases, 'family' AS scope, NULL AS role FROM found f JOIN kinds USING (artifact, name_key)
  WHERE event_type IN ({", ".join(map(_q, D.FAMILY_TYPES))}) OR len(list_filter(hints, lambda h: contains({_q(" ".join(label for label, _ in D.ROLES).lower())}, lower(h)))) > 0
  UNION ALL SELECT artifact, name_key, 1, arg_min(regexp_extract(text, {_q(D.IMPLANT)}, 1), index), [], 'artifact_only', 'implant' FROM context WHERE regexp_matches(text, {_q(D.IMPLANT)}) GROUP BY 1, 2),
hashed AS (
  SELECT k.artifact, k.name_key, k.part, c.index, list_transform(regexp_extract_all(c.text, {_q(D.SHA256)}), lambda h: lower(h)) AS h FROM known k JOIN context c ON c.artifact = k.artifact AND c.name_key = k.name_key
  WHERE len(list_filter(list_concat([k.family], k.aliases), lambda t: contains(lower(c.text), lower(t)))) > 0),
scopes AS (SELECT artifact, name_key, part, arg_max(CASE WHEN len(h) > 1 THEN 'sample_set' ELSE 'exact_sample' END, index) AS s, string_agg(h[1], ',' ORDER BY index) AS sha256 FROM hashed WHERE len(h) > 0 GROUP BY 1, 2, 3),
joined AS (SELECT artifact, name_key, string_agg(text, ' ' ORDER BY index) AS j FROM (SELECT *, row_number() OVER (PARTITION BY artifact, name_key ORDER BY index) AS nth FROM context) WHERE nth <= {D.ROLE_BLOCKS} GROUP BY 1, 2),
roles AS (SELECT k.artifact, k.name_key, part, list_filter(range(1, {len(D.ROLES) + 1}), lambda i: regexp_matches(j, '(?i)' || {_ESCAPED} || '.{{0,{D.ROLE_CHARS}}}' || {_ROLE_LABELS}[i] || '|' || {_ROLE_LABELS}[i] || '.{{0,{D.ROLE_CHARS}}}' || {_ESCAPED}))[1] AS r FROM known k JOIN joined USING (artifact, name_key))
SELECT k.artifact, k.name_key, k.family, coalesce(sha256, '') AS sha256, coalesce(s, scope) AS scope, coalesce({_ROLE_NAMES}[r], role) AS role,
  CASE {" ".join(f"WHEN regexp_matches(j, '(?i)(written|compiled) in {x}') THEN '{'Go' if x == 'Golang' else x}'" for x in D.LANGUAGES)} END AS language, CASE WHEN contains(j, 'PyInstaller') THEN 'PyInstaller' END AS packer
FROM known k JOIN roles USING (artifact, name_key, part) JOIN joined USING (artifact, name_key) LEFT JOIN scopes USING (artifact, name_key, part)"""
    ),
    "q_event_prompts": with_planted(
        f"""RECURSIVE_ {_CONTEXT}, cues AS (SELECT artifact, name_key, index, text, lower(text) AS t FROM context WHERE contains(lower(text), 'prompt') AND regexp_matches(text, {_q(D.PROMPT_CUES)})),
purposes AS (SELECT *, {_PURPOSE} AS purpose FROM cues), firsts_ AS (SELECT artifact, name_key, purpose, min(index) AS first FROM purposes GROUP BY 1, 2, 3),
kept AS (SELECT *, row_number() OVER (PARTITION BY artifact, name_key ORDER BY first) AS nth FROM firsts_), last_ AS (SELECT artifact, name_key, first AS last FROM kept WHERE nth = {D.MOST_PROMPTS}),
held AS (SELECT p.* FROM purposes p JOIN kept k USING (artifact, name_key, purpose) LEFT JOIN last_ USING (artifact, name_key) WHERE nth <= {D.MOST_PROMPTS} AND (last IS NULL OR p.index <= last)),
agg AS (SELECT artifact, name_key, purpose, min(index) AS index, count(*) AS n_blocks, arg_min(t, index) AS t FROM held GROUP BY 1, 2, 3)
SELECT artifact, name_key, nullif(purpose, '') AS purpose, index, n_blocks, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '{A.REPORT_FLAGS[f]}') THEN '{f}' END" for f in _FLAGS)}], lambda x: x IS NOT NULL), ',') AS constraints,
  regexp_matches(t, '{A.REPORT_FLAGS["evasion"]}') AS evasion, CASE WHEN regexp_matches(t, 'blindly executed|then executes|able to induce|logs show') THEN 'succeeded' ELSE 'unknown' END AS effectiveness FROM agg"""
    ),
}
ORACLE_SQL = {name: sql.replace("RECURSIVE_ ", "").replace("WITH planted AS", "WITH RECURSIVE planted AS", 1) for name, sql in ORACLE_SQL.items()}
