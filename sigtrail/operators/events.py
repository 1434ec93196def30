"""Events in reports: discovery of names, facts by rules over ordered blocks, claims and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.functions import scalars as S
from sigtrail.operators.assess import STATUS_RULES

# Patterns of models and services, and rules (group, value, pattern); the first block that has a pattern is the evidence of its fact.
MODEL_RULES = [
    (r"(?i)gemini-1\.5-flash-latest", "Google", "Gemini", "gemini-1.5-flash-latest", "Gemini API", "cloud_api"),
    (r"(?i)Qwen2\.5-Coder-32B-Instruct", "Alibaba/Qwen", "Qwen", "Qwen2.5-Coder-32B-Instruct", "Hugging Face API", "cloud_api"),
    (r"(?i)\bGPT-4\b", "OpenAI", "GPT", "GPT-4", "Chat Completions API", "cloud_api"),
    (r"(?i)\bgpt-3\.5-turbo\b", "OpenAI", "GPT", "gpt-3.5-turbo", "Chat Completions API", "cloud_api"),
    (r"(?i)(?<![A-Za-z0-9])gpt-oss\s*[-: ]\s*20b(?![A-Za-z0-9])", "OpenAI", "GPT-OSS", "gpt-oss-20b", "Ollama API", "local_model"),
    (r"(?i)\bClaude Code\b", "Anthropic", "Claude", "Claude Code", None, "unknown"),
]
SERVICE_RULES = [
    (r"(?i)Gemini(?:'s)? API|Google Gemini API", "Google", "Gemini", None, "Gemini API", "cloud_api"),
    (r"(?i)Hugging Face API|API for Hugging Face", "Hugging Face", None, None, "Hugging Face API", "cloud_api"),
    (r"(?i)OpenAI chat completions API", "OpenAI", "GPT", None, "Chat Completions API", "cloud_api"),
    (r"(?i)on-host installed AI CLI tools", None, None, None, "AI CLI", "on_host_cli"),
    (r"(?i)\bOllama API\b", None, "GPT-OSS", None, "Ollama API", "local_model"),
]
AGENT_PROTOCOL, ANY_MODEL = r"(?i)Model Context Protocol\s*\(MCP\)|\bMCP tools\b", r"(?i)\bLLMs?\b|large language model"
FACT_RULES = [
    *(("model", model, p) for p, _, _, model, _, _ in MODEL_RULES),
    *(("service", service, p) for p, _, _, _, service, _ in SERVICE_RULES),
    *(("status", value, p) for value, p in STATUS_RULES),
    ("role", "self_rewriter", r"(?i)rewrite.*(?:source code|malware)|self-modification|regeneration"),
    ("role", "command_generator", r"(?i)generate(?:s|d)? commands|commands for execution"),
    ("role", "autonomous_operator", r"(?i)autonomous AI agent|autonomous penetration testing orchestrators"),
    ("role", "analysis_evasion", r"(?i)bypass detection|evasion"),
    ("behavior", "persistence", r"(?i)Startup folder.*persistence"),
    ("behavior", "propagation", r"(?i)removable drives.*network shares"),
    ("behavior", "reconnaissance_and_exfiltration", r"(?i)filesystem reconnaissance.*data exfiltration"),
    ("behavior", "local_execution", r"(?i)blindly executed locally|executes the commands.*sends the collected data"),
    ("behavior", "host_enumeration", r"(?i)enumerating ministry hosts.*traversing files"),
    ("behavior", "full_attack_lifecycle", r"(?i)reconnaissance, vulnerability discovery, exploitation, lateral movement"),
    ("code_style", "self_rewriting", r"(?i)metamorphic script|self-modification|rewrite the malware's entire source code"),
    ("code_style", "task_decomposition", r"(?i)decomposed complex multi-stage attacks"),
    ("code_style", "unfinished_features", r"(?i)incomplete features are commented out|function.*commented out"),
    ("outcome", "confirmed_intrusion", r"(?i)compromise multiple systems|validated a handful of successful intrusions"),
    ("outcome", "data_exfiltration", r"(?i)data exfiltration|exfiltrated"),
    ("limitation", "capability_not_observed", r"(?i)does not demonstrate an ability to compromise|does not have the ability to compromise"),
    ("limitation", "feature_not_active", r"(?i)function.*commented out|incomplete features are commented out"),
    ("limitation", "initial_access_unknown", r"(?i)initial access was.*not.*evident"),
    ("limitation", "tool_use_unconfirmed", r"(?i)do not have evidence confirming or denying VShell"),
    ("limitation", "model_reliability", r"(?i)frequently overstated.*fabricated data|hallucination"),
    ("limitation", "credential_origin", r"(?i)stolen API tokens|keys were leaked"),
    ("target", "Ukraine", r"(?i)malware against Ukraine|against Ukraine"),
    ("target", "Thailand Ministry of Finance", r"(?i)targeting Thailand's Ministry of Finance|Thailand's Ministry of Finance Targeted"),
    ("target", "roughly 30 entities", r"(?i)(?:targeted\s+)?roughly 30 entities"),
    ("target", "Argentina", r"主要针对阿根廷用户|针对阿根廷用户"),
    ("actor", "APT", r"(?i)(?:Russian government-backed actor\s+)?(APT\d+)(?:\s*\(aka\s+([A-Z][A-Z0-9-]+)\))?"),
    ("actor", "Chinese state-sponsored group", r"(?i)high confidence.*?Chinese state-sponsored group"),
    ("actor", "tracked group", r"(?i)(?:operators? are part of a )?group tracked as\s+([A-Z][A-Za-z0-9-]{3,30})"),
]
AUTONOMY = [("unattended", r"(?i)unattended|YOLO mode"), ("human_on_loop", r"(?i)80-90%|minimal human oversight")]
OUTPUT = [("blindly_executed", r"(?i)blindly executed|then executes the commands"), ("saved_to_file", r"(?i)saved? (?:to|the new)|saving the new")]
HUMANS = r"(?i)targets selected by human|human operators"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH = rf"\b(?:(?:early|mid|late)[ -])?({'|'.join(MONTHS)})\s+(20\d{{2}})\b"
#: predicate: types of subject and object that a claim may have.
CLAIM_TYPES = [
    ("uses_model", "malware_family", "ai_model"), ("uses_model", "threat_actor", "ai_model"), ("uses_provider", "malware_family", "ai_provider"), ("attributed_to", "malware_family", "threat_actor"),
    ("uses_agent", "threat_actor", "ai_agent"),
]


def facts(blocks: DataFrame, key: str = "artifact") -> DataFrame:
    """key, fact_group, value, index: each rule's first block of a document, in one pass and one aggregate."""
    held = F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(g).alias("fact_group"), F.lit(v).alias("value"))) for g, v, p in FACT_RULES))
    return blocks.select(key, "index", F.inline(F.array_compact(held))).groupBy(key, "fact_group", "value").agg(F.min("index").alias("index"))


def toolchain(blocks: DataFrame, key: str = "artifact") -> DataFrame:
    """key, provider, family, model, service, agent, deployment, evidence (block indexes): AI tools of a document's first blocks with a rule.

    A service that a model of the same provider has already named only adds evidence to it; a document without any tool that
    speaks of language models has one of family LLM.
    """
    said = [(p, provider, family, model, service, None, deployment) for p, provider, family, model, service, deployment in [*MODEL_RULES, *SERVICE_RULES]]
    said += [(AGENT_PROTOCOL, None, None, None, None, "MCP", "unknown"), (ANY_MODEL, None, "LLM", None, None, None, "unknown")]
    names = ["provider", "family", "model", "service", "agent", "deployment"]
    rules = F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(n).alias("rule"), *(F.lit(v).cast("string").alias(c) for c, v in zip(names, values, strict=True)))) for n, (p, *values) in enumerate(said)))
    hits = blocks.select(key, "index", F.inline(F.array_compact(rules))).groupBy(key, "rule", *names).agg(F.min("index").alias("index"))
    # What two rules say of one provider and service is one tool: the model's, with both as evidence. A service never joins two models.
    lead = Window.partitionBy(key, "provider", "service", (F.col("agent").isNotNull() | F.col("service").isNull()).cast("int") * (F.col("rule") + 1)).orderBy("rule")
    rows = hits.withColumn("owner", F.when((F.col("rule") >= len(MODEL_RULES)) & (F.col("rule") < len(MODEL_RULES) + len(SERVICE_RULES)), F.first("rule").over(lead)).otherwise(F.col("rule")))
    rows = rows.withColumn("n_others", F.sum((F.col("rule") < len(said) - 1).cast("int")).over(Window.partitionBy(key))).filter((F.col("rule") < len(said) - 1) | (F.col("n_others") == 0))
    own = rows.groupBy(key, "owner").agg(F.min_by(F.struct(*names), "rule").alias("t"), F.array_sort(F.collect_set("index")).alias("evidence"))
    return own.select(key, "t.*", "evidence")


def involvement(blocks: DataFrame, key: str = "artifact") -> DataFrame:
    """key, autonomy, output_handling, human_role of a document, from all its blocks."""
    has = lambda p: F.bool_or(F.col("text").rlike(p))
    ladder = lambda rules: F.when(has(rules[0][1]), rules[0][0]).when(has(rules[1][1]), rules[1][0]).otherwise("unknown")
    return blocks.groupBy(key).agg(ladder(AUTONOMY).alias("autonomy"), ladder(OUTPUT).alias("output_handling"), has(HUMANS).alias("human_role"))


def first_month(blocks: DataFrame, key: str = "artifact") -> DataFrame:
    """key, start (YYYY-MM), index of the first block with a month and a year."""
    hit = blocks.filter(F.col("text").rlike(MONTH))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract("text", MONTH, 1))
    start = F.concat_ws("-", F.regexp_extract("text", MONTH, 2), F.lpad(number.cast("string"), 2, "0"))
    return hit.groupBy(key).agg(F.min_by(start, "index").alias("start"), F.min("index").alias("index"))


def assemble(found: DataFrame, months: DataFrame, statuses: DataFrame, key: str = "artifact") -> DataFrame:
    """One nested event for each key: arrays of facts with the ids of their evidence, status and time.

    statuses: key, status (`assess.grounded_status`): what a denial or another event's text says is no status of this one.
    """
    fact = F.struct("fact_group", "value", S.stable_id("evidence", F.col(key), F.col("index")).alias("evidence_id"))
    out = found.groupBy(key).agg(F.sort_array(F.collect_list(fact)).alias("facts"))
    return out.join(statuses, key, "left").join(months.select(key, "start"), key, "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def claims(terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, predicate, subject, object: pairs of terms of one block whose types a predicate allows. terms: keys, entity_type, term."""
    spark = terms.sparkSession
    allowed = F.broadcast(spark.createDataFrame(CLAIM_TYPES, "predicate string, s_type string, o_type string"))  # fixed and small
    s = terms.select(*keys, F.col("entity_type").alias("s_type"), F.col("term").alias("subject"))
    o = terms.select(*keys, F.col("entity_type").alias("o_type"), F.col("term").alias("object"))
    return s.join(allowed, "s_type").join(o, [*keys, "o_type"]).select(*keys, "predicate", "subject", "object").distinct()


def merge_entities(entities: DataFrame) -> DataFrame:
    """entity_id, name, aliases, n_mentions: entities of one id with all their aliases."""
    return entities.groupBy("entity_id").agg(F.min("name").alias("name"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.count(F.lit(1)).alias("n_mentions"))


def purpose(text: Column) -> Column:
    """What a model is used for, by an ordered list of words; null if none applies."""
    low = F.lower(text)
    has = lambda *words: F.greatest(*(F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) == 1
    return (
        F.when(has("rewrite", "self-modification", "regeneration"), "self_rewriting").when(has("command") & has("generate"), "command_generation")
        .when(has("ransomware code", "lua scripts"), "malicious_code_generation").when(has("search") & has("secret", "token"), "secret_discovery")
        .when(has("orchestrat", "sub-agent"), "attack_orchestration").when(has("enumerat", "travers"), "post_compromise_operations")
    )


def base64_constants(rows: DataFrame, key: str = "artifact", text: str = "text", least: int = 44) -> DataFrame:
    """key, constant, decoded: runs of Base64 that decode to valid UTF-8 text."""
    run = rf"[A-Za-z0-9+/]{{{least},}}={{0,2}}"
    found = rows.filter(F.col(text).rlike(run)).select(key, F.explode(F.regexp_extract_all(text, F.lit(run), F.lit(0))).alias("constant"))
    decoded = found.withColumn("decoded", F.try_validate_utf8(F.try_to_binary("constant", F.lit("base64")).cast("string")))
    return decoded.filter("decoded is not null and constant rlike '^(?:....)*$'")


def code_metrics(rows: DataFrame, key: str = "artifact", text: str = "text") -> DataFrame:
    """key, loc, blank_ratio, comment_ratio, mean_identifier_length of sources, by text alone."""
    lines = F.split(text, r"\r\n|[\n\r]")
    count = lambda test: F.size(F.filter(lines, test)).cast("double")
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)).cast("double")
    return rows.select(
        key, F.size(lines).cast("long").alias("loc"), F.round(count(lambda x: F.trim(x) == "") / F.size(lines), 6).alias("blank_ratio"),
        F.round(count(lambda x: F.trim(x).startswith("#")) / F.size(lines), 6).alias("comment_ratio"), F.round(F.when(F.size(words) > 0, total / F.size(words)), 6).alias("mean_identifier_length"),
    )


def split_units(units: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """key, part, n_parts, content: units in parts of at most `most` characters, nothing lost."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / most)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col(text), (k * most + 1).cast("int"), F.lit(most)))
    return units.select(key, n.alias("n_parts"), F.posexplode(parts).alias("part", "content"))
