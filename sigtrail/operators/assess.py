"""Gates, triage and selection: what a finding, a status, an override or a target event is worth, and which one is taken."""

from __future__ import annotations

import functools
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.functions import scalars as S

# Status rules in order of priority, and wording that denies an observation.
STATUS_RULES = [
    ("proof_of_concept", r"(?i)proof[- ]of[- ]concept|(?<![A-Za-z0-9])PoC(?![A-Za-z0-9])|概念验证"),
    ("observed_in_operations", r"(?i)live operations|observed in operations|in the wild|used during a ransomware attack"),
    ("development_or_testing", r"(?i)development or testing phase|research and development phase"),
    ("experimental", r"(?i)experimental"),
    ("confirmed_intrusion", r"(?i)successful intrusions|compromise multiple systems|confirmed intrusion"),
]
#: Parts of words in small letters, one of which is in whatever a rule of the status finds, in the order of `grounded_status`.
STATUS_CUES = [
    ["observed"], ["in operations"], ["proof", "poc", "概念验证"], ["live operations", "observed in operations", "in the wild", "used during a ransomware attack"], ["development"], ["experimental"],
    ["successful intrusions", "compromise multiple systems", "confirmed intrusion"],
]
DENIED = r"(?i)not |not being|as opposed to|does not|without"
#: Characters of text, and blocks, that a status may be away from a name of its event; longest block without a name that counts.
NEAR_CHARS, NEAR_BLOCKS, SHORT_BLOCK, BEFORE = 220, 3, 400, 60
# Hosts of sources by tier, and cues of prompts.
TIERS = [("government_cert", ["cert.gov.ua"]), ("primary_vendor", ["cloud.google.com", "anthropic.com", "microsoft.com", "ibm.com"]), ("security_research", ["sentinelone.com", "hunt.io", "checkpoint.com"])]
INSTRUCTION = r"(?is)(?:^\s*[\"']?(?:you are (?:an? |the |going to act as)|(?:generate|create|write|make) (?:a |an |the )|return only|output only|given a |请|你是)|\b(?:your task is|you need to|please (?:determine|respond|provide))\b)"
TASK = r"(?is)(?:\b(?:code|scripts?|commands?|json|response|analysis|instructions|files|screen|click|task|summary|summarize|assistant|validator)\b|代码|脚本|回答|输出|分析)"
SECRET = r"\b(?:sk-[A-Za-z0-9_-]{12,}|hf_[A-Za-z0-9]{12,})\b"
REPORT_FLAGS = {
    "role_definition": "act as|you are|persona", "output_only": "output only|only (?:the )?output", "code_only": "only (?:the )?code|code itself",
    "single_line_command": "one-line|single-line|one line", "self_modification": "rewrite.*(?:source code|malware)|self-modif|regenerat",
    "evasion": "evasion|evade|bypass detection|obfuscat", "jailbreak": "jailbreak|ignore previous|bypass safeguards", "safety_framing": "authorized|research|ctf|educational",
}
COMPLETE = ["complete_static_template", "full_text", "static_template", "legacy_complete_text"]
COMPONENT = ["static_component", "decoded_static_component", "decoded_constant", "string_constant", "static_components_only"]
AI_MARKERS = [
    "llm_query", "['choices'][0]['message']['content']", '"role": "user"', '"role":"user"', "generating image with prompt", "authorization tokens", "llm_api_url", "image_api_url",
    "exec(complete_str)", "exec (complete_str", "f .write (complete_str",
]
GENERIC_MARKERS = ["exec(", "exec (", "api_url", "os.system(filename)", "malicious="]


# --- scalar gates ---------------------------------------------------------------------------------------------------------


def dashed_model(x: Column) -> Column:
    """A model name in lower case with single dashes for white space and underscores, without "-latest"."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(S.normalize_space(x)), "[_ ]", "-"), "-+", "-"), "-latest$", "")


def virus_total_hash(url: Column) -> Column:
    """The SHA-256 of a file page of VirusTotal; null for any other address."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/[^?#]*)?/file/([a-fA-F0-9]{64})(?:[/?#]|$)", 1))
    return F.when(S.url_host(url).isin("virustotal.com", "www.virustotal.com") & (found != ""), found)


def display_name(name: Column, fallback: Column) -> Column:
    """The last part of a path, without control characters, at most 255 characters."""
    last = F.trim(F.regexp_extract(F.regexp_replace(F.coalesce(name, F.lit("")), "/+$", ""), r"[^/]*$", 0))
    return F.left(F.regexp_replace(F.when(last == "", fallback).otherwise(last), r"[\x00-\x1f]", "_"), F.lit(255))


def source_tier(host: Column) -> Column:
    low, out = F.lower(F.coalesce(host, F.lit(""))), F
    for tier, ends in TIERS:
        out = out.when(F.greatest(*(F.endswith(low, F.lit(e)).cast("int") for e in ends), F.lit(0)) == 1, tier)
    return out.otherwise("unknown")


def surface_mentioned(value: Column, excerpt: Column) -> Column:
    """Whether an excerpt names a value: as it is, or by letters and digits only if these are four or more."""
    plain = lambda x: F.lower(S.normalize_space(x))
    compact = lambda x: F.regexp_replace(plain(x), r"[^\p{L}\p{N}]", "")
    return ((plain(value) != "") & F.contains(plain(excerpt), plain(value))) | ((F.length(compact(value)) >= 4) & F.contains(compact(excerpt), compact(value)))


def report_date(raw: Column) -> Column:
    """Struct value, precision of a date text: a full date, else a year, else unknown."""
    day = r"(20\d{2})[-/]([01]?\d)[-/]([0-3]?\d)"
    part = lambda k, n: F.lpad(F.regexp_extract(raw, day, k), n, "0")
    year = F.regexp_extract(raw, r"(20\d{2})", 1)
    return F.struct(
        F.when(raw.rlike(day), F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))).when(year != "", year).alias("value"),
        F.when(raw.rlike(day), "day").when(year != "", "year").otherwise("unknown").alias("precision"),
    )


def natural_prompt(text: Column, longest: int = 65_536) -> Column:
    """Whether an unbound text reads as a prompt: long enough, printable, no secret, an instruction and a task."""
    hidden = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\p{Cs}\p{Co}\p{Cn}]", ""))  # few match, so little is copied
    return F.coalesce((F.length(text) >= 32) & (F.length(text) <= longest) & ~text.rlike(SECRET) & (hidden <= 0.02 * F.length(text)) & text.rlike(INSTRUCTION) & text.rlike(TASK), F.lit(False))


def weak_prompt(text: Column, patterns: dict[str, str]) -> Column:
    """Whether a text of 32 characters or more has one of the patterns."""
    return (F.length(text) >= 32) & (F.greatest(*(text.rlike(p).cast("int") for p in patterns.values()), F.lit(0)) == 1)


def report_flags(text: Column) -> Column:
    """Map of the eight flags of a prompt that a report speaks of."""
    return F.create_map(*chain.from_iterable((F.lit(n), F.lower(text).rlike(p)) for n, p in REPORT_FLAGS.items()))


def true_flags(flags: Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(flags, lambda _, v: F.coalesce(v, F.lit(False)))))


def probabilities(histogram: Column) -> Column:
    """A map of counts as shares; counts that aren't positive don't count, null if none is left."""
    kept = F.map_filter(histogram, lambda _, v: v > 0)
    total = F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(kept) > 0, F.transform_values(kept, lambda _, v: v / total))


def prompt_scope(completeness: Column) -> Column:
    value = F.coalesce(F.nullif(completeness, F.lit("")), F.lit("legacy_complete_text"))
    return F.when(value.isin(COMPLETE), "complete_template").when(value.isin(COMPONENT), "component").otherwise("fragment")


def code_reason(parse_error: Column, source: Column, language: Column, n_metrics: Column, has_ast: Column, least: int = 3) -> Column:
    """Why code can't be compared, by the first reason that applies; null if it can."""
    return (
        F.when(F.coalesce(parse_error, F.lit("")) != "", "parse_error").when(~F.coalesce(source == "original_source", F.lit(False)), "not_original_source")
        .when(~S.meaningful(language), "unknown_language").when(F.coalesce(n_metrics, F.lit(0)) == 0, "missing_metrics")
        .when((F.lower(F.trim(language)) == "python") & ~F.coalesce(has_ast, F.lit(False)), "python_ast_unavailable").when(n_metrics < least, "insufficient_metrics")
    )


def triage(group: Column, raw: Column, model: Column, sdk: Column, endpoint: Column) -> Column:
    """Struct verdict, reason of a fact that a model found."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    has = lambda text, words: F.greatest(*(F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) == 1
    route = F.lower(F.when(some(endpoint), endpoint).otherwise(F.coalesce(raw, F.lit(""))))
    compact = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", "")
    decoded = F.when((F.length(compact) >= 80) & compact.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.try_to_binary(compact, F.lit("base64")))
    shown = F.length(F.regexp_replace(F.decode(decoded, "ISO-8859-1"), r"[^\x20-\x7e]", ""))
    verdicts = [
        ((group == "toolchain") & some(model), "ai_relevant_candidate", "explicit_model_or_cli_identifier"), ((group == "toolchain") & (F.lower(sdk) == "openai"), "ai_relevant_candidate", "known_ai_sdk"),
        ((group == "toolchain") & F.contains(route, F.lit("router.huggingface.co/")) & has(route, ["chat/completions", "images/generations"]), "ai_relevant_candidate", "known_ai_service_route"),
        (group == "toolchain", "non_ai_or_misclassified", "generic_sdk_endpoint_ioc_or_build_component"),
        ((group == "prompt") & F.contains(low, F.lit("there is no need to analyze this file")), "non_ai_or_misclassified", "analyzer_directive_not_application_prompt"),
        ((group == "prompt") & (low == "what should not be on the image"), "non_ai_or_misclassified", "ui_label_not_prompt_content"),
        ((group == "prompt") & F.coalesce(shown >= 0.8 * F.octet_length(decoded), F.lit(False)), "needs_normalization", "base64_prompt_not_decoded"),
        (group == "prompt", "ai_relevant_candidate", "instruction_or_role_text"),
        ((group == "code_observation") & has(low, AI_MARKERS), "ai_relevant_candidate", "ai_request_response_or_generated_code_flow"),
        ((group == "code_observation") & low.isin(GENERIC_MARKERS), "needs_manual_review", "generic_marker_requires_relation_context"),
        (group == "code_observation", "non_ai_or_misclassified", "generic_code_or_malware_behavior"),
    ]
    out = F
    for test, verdict, reason in verdicts:
        out = out.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(F.lit("needs_manual_review").alias("verdict"), F.lit("unknown_signal_group").alias("reason")))


# --- status of events -----------------------------------------------------------------------------------------------------


def grounded_status(blocks: DataFrame, key: str, term: str, name: str = "event") -> DataFrame:
    """key, status, index: the first status rule whose first block is near a name of the event and isn't denied.

    blocks: key, index, text, and a column `term` with a pattern of the event's names. A block with a name must have both
    within NEAR_CHARS characters; a short one without must be within NEAR_BLOCKS of a block that has. "unknown" without any.
    """
    named = F.regexp_count("text", F.col(term)) > 0
    by_key = Window.partitionBy(key).orderBy("index").rangeBetween(-NEAR_BLOCKS, NEAR_BLOCKS)
    rules = [("observed_in_operations", r"(?s)\bObserved\b"), ("observed_in_operations", r"(?s)\bin operations\b"), *STATUS_RULES]
    # Both of the first two must hold; they are told apart by their number. Patterns only read texts with a cue, and only texts with a hit go on.
    cued = lambda n: functools.reduce(Column.__or__, (F.contains(F.col("_low"), F.lit(c)) for c in STATUS_CUES[n]))
    at = lambda n, p: F.when(cued(n), F.regexp_instr("text", F.lit(p if p.startswith("(?i)") else f"(?i){p}"))).otherwise(0)
    hit = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(v).alias("value"), at(n, p).alias("at")) for n, (v, p) in enumerate(rules)))
    marked = blocks.withColumn("_low", F.lower("text")).select(key, "index", "text", term, named.alias("named"), F.filter(hit, lambda h: h["at"] > 0).alias("hits"))
    held = F.size("hits") > 0
    marked = marked.select(key, "index", F.when(held, F.col("text")).alias("text"), F.when(held, F.col(term)).alias(term), "named", "hits")
    hits = marked.withColumn("close", F.max("named").over(by_key)).select(key, "index", "text", term, "named", "close", F.inline("hits"))
    first = hits.groupBy(key, "n").agg(F.min_by(F.struct("index", "text", term, "named", "close", "value", "at"), "index").alias("b")).select(key, "n", "b.*")
    # Distances from a match to each place of a name: the text is split by names, and pieces' lengths add up.
    window = F.substring(F.col("text"), F.greatest(F.col("at") - NEAR_CHARS - 200, F.lit(1)), F.lit(2 * NEAR_CHARS + 400))
    shift = F.greatest(F.col("at") - NEAR_CHARS - 200, F.lit(1)) - 1
    gaps, names = F.split(window, F.col(term), -1), F.regexp_extract_all(window, F.col(term), F.lit(0))
    starts = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.aggregate(F.slice(gaps, F.lit(1), k), F.lit(0), lambda s, g: s + F.length(g)) + F.aggregate(F.slice(names, F.lit(1), k - 1), F.lit(0), lambda s, g: s + F.length(g)))
    close = F.when(F.size(names) > 0, F.exists(starts, lambda s: F.abs(s + shift + 1 - F.col("at")) <= NEAR_CHARS)).otherwise(False)
    grounded = F.when(F.col("named"), close).otherwise((F.length("text") <= SHORT_BLOCK) & F.col("close"))
    before = F.substring(F.col("text"), F.greatest(F.col("at") - BEFORE, F.lit(1)), F.least(F.col("at") - 1, F.lit(BEFORE)))
    denied = (F.col("n") >= 2) & (F.col("value") == "observed_in_operations") & (before.rlike(DENIED) | F.contains(F.lower("text"), F.lit("does not")))
    good = first.filter(grounded & ~denied)
    pair = good.filter("n < 2").groupBy(key).agg(F.count(F.lit(1)).alias("both"), F.min("index").alias("index")).filter("both = 2").select(key, F.lit(-1).alias("n"), F.lit("observed_in_operations").alias("value"), "index")
    best = good.filter("n >= 2").select(key, "n", "value", "index").unionByName(pair).groupBy(key).agg(F.min_by(F.struct("value", "index"), "n").alias("b"))
    return blocks.select(key).distinct().join(best, key, "left").select(key, F.coalesce("b.value", F.lit("unknown")).alias("status"), F.col("b.index").alias("index"))


def marker_segments(markers: DataFrame, key: str, last: str) -> DataFrame:
    """markers (key, index, name, last: blocks of the document) with segment_end: the next marker's index, or the document's end."""
    following = F.lead("index").over(Window.partitionBy(key).orderBy("index"))
    return markers.withColumn("segment_end", F.coalesce(following, F.col(last)))


# --- selections -----------------------------------------------------------------------------------------------------------


def target_event(events: DataFrame, targets: DataFrame) -> DataFrame:
    """family, report, event, method: the event of a report that a family means: by its name, else an alias, else an artifact's family.

    events: report, event, pos, name, aliases, artifact_names; targets: family, report, aliases. Keys are compared; of several
    events the first counts. A family without any has null.
    """
    keys = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), S.family_key)
    e = events.select("report", "event", "pos", S.family_key(F.col("name")).alias("k"), keys(F.col("aliases")).alias("ks"), keys(F.col("artifact_names")).alias("fs"))
    t = targets.select("family", "report", S.family_key(F.col("family")).alias("t"), F.array_union(F.array(S.family_key(F.col("family"))), keys(F.col("aliases"))).alias("ts"))
    ways = [("identity_exact", F.array("k"), F.array("t")), ("identity_alias", F.array_union(F.array("k"), "ks"), F.col("ts")), ("artifact_family", F.col("fs"), F.array("t"))]
    found = None
    for n, (method, ours, theirs) in enumerate(ways):
        left, right = e.select("report", "event", "pos", F.explode(F.array_distinct(ours)).alias("key")), t.select("family", "report", F.explode(F.array_distinct(theirs)).alias("key"))
        hit = left.filter("key <> ''").join(right, ["report", "key"]).select("family", "report", "event", "pos", F.lit(method).alias("method"), F.lit(n).alias("n"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("family", "report").agg(F.min_by(F.struct("event", "method"), F.struct("n", "pos", "event")).alias("b"))
    return targets.select("family", "report").join(best, ["family", "report"], "left").select("family", "report", F.col("b.event").alias("event"), F.col("b.method").alias("method"))


def best_paths(files: DataFrame, samples: DataFrame) -> DataFrame:
    """sha256, path, n_paths: of the files with a sample's hash the one named by it, then the shortest, then the first by name."""
    name = F.lower(F.regexp_extract("path", r"[^/]*$", 0))
    order = F.struct((name != F.col("sha256")).alias("a"), F.length("path").alias("b"), F.lower("path").alias("c"), F.col("path").alias("d"))
    return samples.select(F.lower("sha256").alias("sha256")).join(files.withColumn("sha256", F.lower("sha256")), "sha256", "left").groupBy("sha256").agg(F.min_by("path", order).alias("path"), F.count("path").alias("n_paths"))


def logical_events(reports: DataFrame, events: DataFrame) -> DataFrame:
    """logical, name_key, event: events of reports that are logically the same, the first of each canonical name. events: report, event, name, pos."""
    rows = events.join(reports.select("report", "logical"), "report").withColumn("name_key", S.canonical_key(F.col("name")))
    return rows.groupBy("logical", "name_key").agg(F.min_by("event", F.struct("report", "pos")).alias("event"))


def valid_overrides(rows: DataFrame, values: str, most: int = 50, longest: int = 200) -> DataFrame:
    """rows with clean (trimmed, first of each in any case) and error: too many values, too long, control characters; null if good."""
    trimmed = F.transform(values, lambda v: F.trim(v))
    bad = F.when(F.size(values) > most, "too_many").when(F.exists(trimmed, lambda v: F.length(v) > longest), "too_long").when(F.exists(trimmed, lambda v: v.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")), "control_character")
    first = lambda v, i: F.array_position(F.transform(trimmed, lambda w: F.lower(w)), F.lower(v)) == i + 1
    return rows.withColumn("error", bad).withColumn("clean", F.when(bad.isNull(), F.filter(F.filter(trimmed, first), lambda v: v != "")))


def overlay(extracted: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """extracted with the columns of an override in place of its own, whole records at a time, and where they come from."""
    own = overrides.select(key, F.struct(*columns).alias("_o"))
    out = extracted.join(own, key, "left")
    return out.withColumns({c: F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(c)) for c in columns}).withColumn("context_source", F.when(F.col("_o").isNotNull(), "manual").otherwise("extracted")).drop("_o")


def prompt_records(prompts: DataFrame, key: str) -> DataFrame:
    """key, record, exact, fuzzy, scope: comparable prompts of an artifact, each once: by exact hash, else by SimHash.

    prompts: key, pos, text_hash, fuzzy_hash (16 hex digits), completeness, comparison_eligible. The first of equal ones
    stays, or the first with a SimHash.
    """
    exact = F.when(F.lower("text_hash").rlike("^(sha256:)?[a-f0-9]{64}$"), F.lower("text_hash"))
    fuzzy = F.when(F.lower("fuzzy_hash").rlike("^(simhash64:)?[a-f0-9]{16}$"), F.right(F.lower("fuzzy_hash"), F.lit(16)))
    rows = prompts.filter(F.coalesce("comparison_eligible", F.lit(True))).select(key, "pos", exact.alias("exact"), fuzzy.alias("fuzzy"), prompt_scope(F.col("completeness")).alias("scope"))
    rows = rows.withColumn("record", F.coalesce("exact", F.concat(F.lit("simhash64:"), "fuzzy"))).filter("record is not null")
    return rows.groupBy(key, "record").agg(F.min_by(F.struct("exact", "fuzzy", "scope"), F.struct(F.col("fuzzy").isNull(), "pos")).alias("b")).select(key, "record", "b.*")


def old_and_new(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The new rows with their old values (null if there was none) and whether any changed."""
    before = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in columns))
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return new.select(*keys, *columns).join(before, keys, "left").withColumn("changed", changed)


def added_after(before: Column, after: Column) -> Column:
    """What a refresh put after an unchanged list; null if it changed what was there."""
    n = F.size(before)
    return F.when(F.slice(after, F.lit(1), F.greatest(n, F.lit(1))) == before, F.slice(after, n + 1, F.greatest(F.size(after) - n, F.lit(0)))).when(n == 0, after)


def best_assignment(scores: list[list[float]]) -> float:
    """Greatest total of a one-to-one assignment of rows to columns, by shortest augmenting paths."""
    if not scores or not scores[0]:
        return 0.0
    if len(scores) > len(scores[0]):
        scores = [list(c) for c in zip(*scores, strict=True)]
    n, m, inf = len(scores), len(scores[0]), float("inf")
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for row in range(1, n + 1):
        owner[0], at, way, least, used = row, 0, [0] * (m + 1), [inf] * (m + 1), [False] * (m + 1)
        while owner[at]:
            used[at] = True
            i, step, to = owner[at], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    if (cost := -scores[i - 1][j - 1] - u[i] - v[j]) < least[j]:
                        least[j], way[j] = cost, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    return sum(scores[owner[j] - 1][j - 1] for j in range(1, m + 1) if owner[j])
