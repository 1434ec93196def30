"""Rule packs, and scans of texts with them: one row for each match."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Identifiers and patterns that are looked for.
MODEL_RULES = [
    ("google_gemini_15_flash_latest", r"(?i)\bgemini-1\.5-flash-latest\b", "Google", "Gemini", "gemini-1.5-flash-latest", 0.99),
    ("google_gemini_25_flash_lite", r"(?i)\bgemini-2\.5-flash-lite\b", "Google", "Gemini", "gemini-2.5-flash-lite", 0.99),
    ("qwen25_coder_32b", r"(?i)\b(?:Qwen/)?Qwen2\.5-Coder-32B-Instruct\b", "Alibaba/Qwen", "Qwen", "Qwen2.5-Coder-32B-Instruct", 0.99),
    ("gpt_oss_20b", r"(?i)\bgpt[-_:]?oss[-_:]?20b\b", "OpenAI", "gpt-oss", "gpt-oss-20b", 0.99),
    ("openai_gpt_family", r"(?i)\bgpt-(?:3\.5|4)[A-Za-z0-9._:-]*\b", "OpenAI", "GPT", None, 0.95),
]
ENDPOINT_RULES = [
    ("huggingface_inference", r"(?i)api-inference\.huggingface\.co", "Hugging Face", "unknown", None, 0.98),
    ("google_generative_language", r"(?i)generativelanguage\.googleapis\.com", "Google Gemini API", "Gemini", None, 0.98),
    ("ollama_local", r"(?i)(?:localhost|127\.0\.0\.1):11434|/api/(?:chat|generate)", "Ollama", "unknown", None, 0.90),
]
SDK_RULES = [
    ("openai_python_sdk", r"(?i)\b(?:import|from)\s+openai\b|OpenAI\(", "OpenAI", "openai", None, 0.90),
    ("google_generative_ai_sdk", r"(?i)google\.generativeai|GenerativeModel\(", "Google", "google-generativeai", None, 0.90),
    ("anthropic_python_sdk", r"(?i)\b(?:import|from)\s+anthropic\b|Anthropic\(", "Anthropic", "anthropic", None, 0.90),
    ("generic_chat_interface", r"(?i)\b(?:ollama|chat\.completions|function_call|tool_calls)\b", None, "generic-chat-interface", None, 0.90),
]
CLI_RULES = [
    ("anthropic_claude_cli_noninteractive", r"(?is)(?:\bclaude\b.{0,240}--dangerously-skip-permissions|--dangerously-skip-permissions.{0,240}\bclaude\b)", "Anthropic", "Claude", None, 0.98),
]
PROMPT_PATTERNS = {
    "role_definition": r"(?i)\byou are (?:an?|the)\b",
    "output_only": r"(?i)\b(?:return|output|respond with)\s+(?:only|just)\b",
    "code_only": r"(?i)\b(?:only|just)\s+(?:the )?(?:code|command|script)\b",
    "single_line_command": r"(?i)\b(?:one[- ]line|single[- ]line)\s+(?:windows )?(?:command|script)\b",
    "self_modification": r"(?i)\b(?:rewrite|modify|obfuscat\w*|transform)\s+(?:itself|this (?:script|code)|the (?:script|code))\b",
    "evasion": r"(?i)\b(?:evade|bypass|avoid)\b.{0,80}\b(?:detect|antivirus|security|analysis)\b",
    "jailbreak": r"(?i)\b(?:ignore (?:all )?(?:previous|prior) instructions|DAN|jailbreak)\b",
    "safety_framing": r"(?i)\b(?:authorized|penetration testing|research purpose|educational purpose|CTF)\b",
}
STRUCTURE_PATTERNS = {
    "conversation_object": r"(?i)\b(?:ChatPrompt|ChatMessage|FullConversation)\b",
    "prompt_configuration": r"(?i)\b(?:initial_[a-z0-9_]*prompt|validation_criteria|buildValidationPrompt)\b",
}
SPECIAL_TOKENS = ["<|system|>", "<|user|>", "<|assistant|>", "<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<<SYS>>"]
REPORT_TERMS = {
    "malware_family": ["PROMPTFLUX", "PROMPTSTEAL", "LAMEHUG", "FRUITSHELL", "PROMPTLOCK", "QUIETVAULT", "MalTerminal", "Slopoly", "Skynet", "Hades", "HONESTCUE"],
    "threat_actor": ["APT28", "FROZENLAKE", "UAC-0001", "GTG-1002", "Coral Sleet", "Hive0163"],
    "ai_model": ["gemini-1.5-flash-latest", "Gemini 1.5 Flash", "Qwen2.5-Coder-32B-Instruct", "GPT-4", "GPT-4.1", "gpt-4.1-2025-04-14", "Claude"],
    "ai_provider": ["Google Gemini API", "Gemini API", "Hugging Face API", "OpenAI chat completions API", "OpenAI API"],
    "ai_agent": ["Claude Code", "Hermes", "Model Context Protocol", "MCP"],
}
NEGATIVE_WORDS = ["no evidence", "not observed", "unable to determine", "无法确定", "没有证据"]
LIKELY_WORDS = ["likely", "appears", "suggests", "可能", "疑似"]
SPECULATIVE_WORDS = ["speculate", "speculation", "推测"]
CONFIRMED = r"(?i)\b(?:confirmed|verified|observed|demonstrated|identified|detected)\b|确认|证实|验证|观察到|检测到|发现"
LIKELY = r"(?i)\b(?:likely|probably|assess(?:ed|ment)?|believe|believed|suspect(?:ed)?)\b|很可能|高度可能|研判|评估认为|认为|据信"
POSSIBLE = r"(?i)\b(?:may|might|could|possibly|possible|potentially|appears? to|seems? to)\b|可能|或许|疑似|推测|推断"
SPECULATIVE = r"(?i)\b(?:speculat(?:e|ed|ive)|hypothes(?:is|ized))\b|猜测|假设"
NEGATIVE = r"(?i)\b(?:no evidence|not observed|not confirmed|cannot confirm|could not confirm|unable to confirm|did not observe|without evidence)\b|没有证据|无证据|未观察到|尚未观察到|未确认|无法确认|不能确认|未发现"
ATTRIBUTION = r"(?i)\b(?:attribute[ds]? to|attribution|associated with|linked to|state-sponsored|government-backed)\b|归因|关联到|国家支持|政府支持"
CONFIDENCE = [("explicit_high", r"(?i)\bhigh confidence\b|高度确信|高置信度"), ("explicit_medium", r"(?i)\bmedium confidence\b|中等置信度"), ("explicit_low", r"(?i)\blow confidence\b|低置信度")]
#: Matches of one rule in one artifact that are kept.
MATCH_CAP = 256

GROUPS = [("model_identifier", MODEL_RULES), ("endpoint", ENDPOINT_RULES), ("sdk_marker", SDK_RULES), ("ai_cli", CLI_RULES)]
#: Words in small letters, one of which each match of a rule holds: a text without them isn't read for the rule. A rule that isn't named here is read in every text.
CUES = {
    "google_gemini_15_flash_latest": ["gemini-1.5-flash-latest"],
    "google_gemini_25_flash_lite": ["gemini-2.5-flash-lite"],
    "qwen25_coder_32b": ["qwen2.5-coder-32b-instruct"],
    "gpt_oss_20b": ["gpt"],
    "openai_gpt_family": ["gpt-3.5", "gpt-4"],
    "huggingface_inference": ["api-inference.huggingface.co"],
    "google_generative_language": ["generativelanguage.googleapis.com"],
    "ollama_local": [":11434", "/api/chat", "/api/generate"],
    "openai_python_sdk": ["openai"],
    "google_generative_ai_sdk": ["generativeai", "generativemodel("],
    "anthropic_python_sdk": ["anthropic"],
    "generic_chat_interface": ["ollama", "chat.completions", "function_call", "tool_calls"],
    "anthropic_claude_cli_noninteractive": ["--dangerously-skip-permissions"],
}


def has_cue(low: Column, rule_id: str) -> Column:
    """Whether a text, given in small letters, may have a match of the rule."""
    return reduce(or_, (F.contains(low, F.lit(cue)) for cue in CUES[rule_id])) if rule_id in CUES else F.lit(True)


def scan_rules(texts: DataFrame, key: str = "artifact", text: str = "text", cap: int = MATCH_CAP, position: str | None = None) -> DataFrame:
    """key, type, rule_id, value, ordinal, vendor, family, model, confidence: every match of every rule, up to cap per artifact and rule.

    Each rule is a constant pattern, compiled once, and read only in texts that hold one of its CUES; only texts with a match are
    expanded. The cap cuts a sorted array within the row, so nothing is shuffled. Where an artifact has several texts, position
    names the column that orders them: it is returned too, and the cap holds for all texts of an artifact together.
    """
    found = F.array(
        *(
            F.struct(
                F.lit(kind).alias("type"), F.lit(rule_id).alias("rule_id"), F.when(has_cue(F.col("_low"), rule_id), F.slice(F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)), 1, cap)).alias("values"),
                F.lit(vendor).cast("string").alias("vendor"), F.lit(family).cast("string").alias("family"), F.lit(model).cast("string").alias("model"), F.lit(confidence).alias("confidence"),
            )
            for kind, rules in GROUPS
            for rule_id, pattern, vendor, family, model, confidence in rules
        )
    )
    keys = [key] if position is None else [key, position]
    hits = texts.select(*keys, F.col(text).alias("_text"), F.lower(text).alias("_low")).select(*keys, F.explode(F.filter(found, lambda r: F.size(r["values"]) > 0)).alias("r"))
    hits = hits.select(*keys, "r.type", "r.rule_id", "r.vendor", "r.family", "r.model", "r.confidence", F.posexplode("r.values").alias("ordinal", "value"))
    if position is None:
        return hits
    nth = F.row_number().over(Window.partitionBy(key, "rule_id").orderBy(position, "ordinal"))
    return hits.withColumn("nth", nth).filter(F.col("nth") <= cap).drop("nth")  # Spark keeps the first cap rows of a task before it shuffles


def prompt_flags(text: Column) -> Column:
    """Struct of the eight prompt flags of a text."""
    return F.struct(*(text.rlike(p).alias(name) for name, p in PROMPT_PATTERNS.items()))


def special_tokens(texts: DataFrame, key: str = "artifact", text: str = "text") -> DataFrame:
    """key, token: the special tokens that a text has, in any case."""
    held = F.array(*(F.when(F.contains(F.lower(text), F.lit(t.lower())), F.lit(t)) for t in SPECIAL_TOKENS))
    return texts.select(key, F.explode(F.array_compact(held)).alias("token"))


def assertion_class(text: Column) -> Column:
    """unknown, likely, speculative or asserted, by the wording; the first that applies."""
    low = F.lower(text)
    has = lambda words: F.greatest(*(F.contains(low, F.lit(w)).cast("int") for w in words)) == 1
    return F.when(has(NEGATIVE_WORDS), "unknown").when(has(LIKELY_WORDS), "likely").when(has(SPECULATIVE_WORDS), "speculative").otherwise("asserted")


def evidence_strength(text: Column) -> Column:
    """Struct claim_type, assertion_status, author_confidence, strength of an evidence text by its wording."""
    pairs = [(NEGATIVE, "negative_evidence", "denied"), (SPECULATIVE, "author_inference", "speculative"), (POSSIBLE, "author_inference", "possible"), (LIKELY, "author_assessment", "likely"), (ATTRIBUTION, "author_assessment", "asserted")]
    kind, status, sure = F, F, F
    for k, (pattern, claim, state) in enumerate(pairs):
        kind, status = (x.when(text.rlike(pattern), v) for x, v in ((kind, claim), (status, state)))
    kind, status = kind.otherwise("direct_observation"), status.otherwise("asserted")
    for level, pattern in CONFIDENCE:
        sure = sure.when(text.rlike(pattern), level)
    sure = sure.otherwise("not_stated")
    judged = status.isin("likely") | kind.isin("author_inference", "author_assessment")
    strength = (
        F.when(F.coalesce(text, F.lit("")) == "", "unknown")
        .when(status == "denied", "strong")
        .when(text.rlike(CONFIRMED) & (status == "asserted"), "confirmed")
        .when(status.isin("possible", "speculative"), "weak")
        .when(judged, F.when(sure == "explicit_high", "strong").otherwise("moderate"))
        .otherwise("strong")
    )
    return F.struct(kind.alias("claim_type"), status.alias("assertion_status"), sure.alias("author_confidence"), strength.alias("strength"))


def dictionary_terms(blocks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, entity_type, term: the report terms in each block, bounded by other characters than letters, digits, _ and -."""
    held = F.array(
        *(
            F.when(F.col(text).rlike(rf"(?i)(?<![\w-])\Q{term}\E(?![\w-])"), F.struct(F.lit(kind).alias("entity_type"), F.lit(term).alias("term")))
            for kind, terms in REPORT_TERMS.items()
            for term in terms
        )
    )
    return blocks.select(*keys, F.inline(F.array_compact(held)))


def event_type(text: Column) -> Column:
    """The kind of event that a text speaks of, by a ladder of words."""
    low = F.lower(text)
    has = lambda *words: F.greatest(*(F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) == 1
    ransom, shell = has("ransomware", "勒索软件"), has("reverse shell", "反向 shell", "反向shell")
    return (
        F.when(has("cyber espionage"), "cyber_espionage")
        .when(has("android", "安卓") & has("malware", "恶意软件"), "malware_operation")
        .when(ransom & shell, "malware_operation")
        .when(ransom, "ransomware")
        .when(has("malware", "dropper", "data miner", "credential stealer", "reverse shell", "恶意软件", "恶意程序"), "malware_operation")
        .when(has("intrusion", "compromise multiple systems"), "intrusion")
        .when(has("proof of concept", "proof-of-concept"), "proof_of_concept")
        .otherwise("unknown")
    )


def first_match(blocks: DataFrame, keys: list[str], pattern: str, order: str = "index", text: str = "text") -> DataFrame:
    """keys, order of the first block whose text has the pattern, and the match."""
    hits = blocks.filter(F.col(text).rlike(pattern))
    best = hits.groupBy(*keys).agg(F.min_by(F.struct(order, F.regexp_extract(text, pattern, 0).alias("match")), order).alias("b"))
    return best.select(*keys, "b.*")


def capped(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first cap rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")
