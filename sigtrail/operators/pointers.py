"""Nested reports as rows: every node by its JSON pointer, facts that carry evidence, what is at risk, and how strong it is."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.operators import rules
from sigtrail.operators.store import written

# Fields that need a review, values that say nothing, and the predicates of claims that may speak of a field.
AT_RISK = [
    r"/identity/event_type", r"/status/value", r"/time/(?:start|end)", r"/ai_involvement/(?:autonomy_level|output_handling)", r"/attribution/actors/\d+/(?:name|actor_type|country_or_region|confidence)",
    r"/targets/\d+/(?:name|sector|country_or_region|status)", r"/ai_signals/toolchain/\d+/(?:provider|family|model|service|endpoint|sdk_or_library|agent_or_protocol|deployment)",
    r"/ai_signals/prompts/\d+/effectiveness", r"/ai_signals/prompts/\d+/structural_features/[^/]+",
]
SAYS_NOTHING = ["", "unknown", "not_stated"]
FIELD_PREDICATES = {
    "time": ["observed_during"], "status": ["has_operational_status"], "artifacts": ["has_artifact", "has_indicator", "affects_platform", "uses_tool"], "attribution": ["attributed_to", "associated_with_region"],
    "targets": ["targets"], "ai_involvement": ["has_ai_role", "has_autonomy_level", "has_human_role", "has_ai_work_share"], "ai_signals.toolchain": ["uses_model", "uses_provider", "uses_agent", "uses_tool"],
    "ai_signals.prompts": ["uses_prompt"], "ai_signals.code_style": ["has_code_style_feature"], "key_behaviors": ["performs_technique"], "limitations": ["limits_or_contradicts"],
}
CLAIM_TYPES = ["negative_evidence", "direct_observation", "author_assessment", "author_inference", "methodology", "limitation"]
CLAIM_STATES = ["denied", "asserted", "likely", "possible", "speculative", "unknown"]
CLAIM_CONFIDENCE = ["explicit_high", "explicit_medium", "explicit_low", "implicit"]
#: Objects of a report that are assessed, and the fields that each stands for (the object itself without one).
ASSESSED = [("/identity", ["event_name", "event_type"]), ("/time", []), ("/status", []), ("/ai_involvement", [])]
ASSESSED_LISTS = ["artifacts", "attribution/actors", "targets", "ai_signals/toolchain", "ai_signals/prompts", "ai_signals/code_style", "key_behaviors", "outcomes", "limitations"]
METHODS = [("hybrid", 0.85), ("model_candidate", 0.75), ("deterministic_rule", 0.9)]


#: Levels that are opened in one pass, before what is left to open is written.
PASS_LEVELS = 4
_PLACE = ["_doc", "pointer", "name", "kind", "in_list", "item"]


def _kind(v: Column) -> Column:
    kind = F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    return F.when(kind.isin("object", "array", "string", "boolean"), kind).when(kind == "void", "null").otherwise("number")


def _next_level(rows: DataFrame, skip: tuple[str, ...], entered: Column) -> DataFrame:
    """rows (_PLACE, v, known, done) with the members of each container that is entered and wasn't done; known is only of given rows."""
    ready = ~F.col("done") & entered
    rows = rows.withColumn("_child", F.explode(F.when(ready, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).withColumn("_outer", F.when(F.col("_child"), F.col("v")))
    opened = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_outer").outer()))
    child, listed, part = F.col("_child"), F.col("kind") == "array", F.coalesce(F.col("key"), F.col("pos").cast("string"))
    opened = opened.filter(~child | (part.isNotNull() & (listed | ~part.isin(list(skip)))))
    at = F.concat("pointer", F.lit("/"), F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    new = {"pointer": at, "name": part, "kind": _kind(F.col("value")), "in_list": F.coalesce("in_list", F.when(listed, F.col("pointer"))), "item": F.coalesce("item", F.when(listed, at)), "v": F.col("value")}
    return opened.select("_doc", *(F.when(child, x).otherwise(F.col(c)).alias(c) for c, x in new.items()), (F.col("known") & ~child).alias("known"), (~child & (F.col("done") | entered)).alias("done"))


def opened(docs: DataFrame, key: str = "artifact", json: str = "event", skip: tuple[str, ...] = (), items: bool = True, texts: bool = True) -> DataFrame:
    """key, pointer, name, kind, evidence_ids, in_list, item, v: the rows of `nodes`, and as a variant what they hold.

    v is there for scalars, and with texts for items of outermost lists and their members. Without items, these are told but not
    entered. PASS_LEVELS levels are opened in one pass over all documents, so that a text is written once for each pass, not for each level;
    what is still to be opened then goes on to the next pass, until nothing is left.
    """
    v, container = F.col("v"), F.col("kind").isin("object", "array")
    entered = container if items else container & F.col("item").isNull()
    rows = docs.select(F.col(key).alias("_doc"), F.lit("").alias("pointer"), *(F.lit(None).cast("string").alias(c) for c in ("name", "in_list", "item")), F.try_parse_json(json).alias("v")).filter("v is not null")
    rows, found = rows.withColumns({"kind": _kind(v), "known": F.lit(False)}), None
    own = ~container | (F.col("item") == F.col("pointer")) | (F.col("item") == F.regexp_replace("pointer", "/[^/]*$", "")) if texts else ~container
    ids = F.when(F.col("kind") == "object", F.filter(F.try_variant_get("v", "$.evidence_ids", "array<string>"), lambda x: x.isNotNull()))
    while True:
        rows = rows.withColumn("done", F.lit(False))
        for _ in range(PASS_LEVELS):
            rows = _next_level(rows, skip, entered)
        left = entered & ~F.col("done")
        table = written(rows.filter(~F.col("known")).select(*_PLACE, ids.alias("evidence_ids"), left.alias("left"), F.when(own | left, v).alias("v")), "nodes")
        part = table.select(F.col("_doc").alias(key), "pointer", "name", "kind", "evidence_ids", "in_list", "item", F.when(own, v).alias("v"))
        found = part if found is None else found.unionByName(part)
        rows = table.filter("left").select(*_PLACE, "v", F.lit(True).alias("known"))
        if rows.isEmpty():
            return found


def scalar(kind: str = "kind", v: str = "v") -> Column:
    """The text of a scalar that a variant holds; null for null."""
    return F.when(F.col(kind).isin("string", "number", "boolean"), F.try_variant_get(v, "$", "string"))


def nodes(docs: DataFrame, key: str = "artifact", json: str = "event", skip: tuple[str, ...] = (), items: bool = True, texts: bool = True) -> DataFrame:
    """key, pointer, name, kind, value, evidence_ids, in_list, item, json: every node of each document, also the document itself (pointer "").

    in_list and item: the outermost list around a node, and the item of it that holds the node; json is the node's own text, of scalars
    and (with texts) of items of such lists and their members. kind is object, array, string, number, boolean or null; value is a
    scalar's text. Members named in skip aren't entered, nor without items what is in an item. Any depth works (`opened`). Pointers
    escape ~ and / as ~0 and ~1. Text that isn't JSON (also with a member twice) or is null has no rows.
    """
    found = opened(docs, key, json, skip, items, texts)
    return found.select(key, "pointer", "name", "kind", scalar().alias("value"), "evidence_ids", "in_list", "item", F.when(F.col("v").isNotNull(), F.to_json("v")).alias("json"))


def at_pointers(found: DataFrame, wanted: DataFrame, key: str = "artifact") -> DataFrame:
    """wanted (key, pointer) with kind and value of the node that each points at; null where there is none."""
    return wanted.join(found.select(key, "pointer", "kind", "value"), [key, "pointer"], "left")


def fact_objects(docs: DataFrame, key: str = "artifact", json: str = "event") -> DataFrame:
    """key, pointer, evidence_ids: the objects that name evidence, at any depth. The report's list of evidence isn't searched."""
    found = nodes(docs, key, json, skip=("evidence", "evidence_ids"), texts=False)
    return found.filter(F.size("evidence_ids") > 0).select(key, "pointer", "evidence_ids")


def high_risk(found: DataFrame, key: str = "artifact") -> DataFrame:
    """key, pointer, value: scalars that need a review, as far as they say anything. found: `nodes`. A flag counts if it is true."""
    pattern = "^(?:" + "|".join(AT_RISK) + ")$"
    told = ~F.col("kind").isin("object", "array", "null") & ~F.col("value").isin(SAYS_NOTHING) & ~((F.col("kind") == "boolean") & (F.col("value") == "false"))
    return found.filter(F.col("pointer").rlike(pattern) & told).select(key, "pointer", "value")


def _field_path(pointer: Column) -> Column:
    """/a/b/0 as event.a.b[0]."""
    return F.concat(F.lit("event"), F.regexp_replace(F.regexp_replace(pointer, r"/(\d+)(?=/|$)", "[$1]"), "/", "."))


def _first_of(values: list[str], held: Column) -> Column:
    return F.coalesce(*(F.when(F.array_contains(held, v), v) for v in values))


def assess_fields(docs: DataFrame, key: str = "artifact", json: str = "event", claims: DataFrame | None = None, by_rules: DataFrame | None = None) -> DataFrame:
    """key, field_path, evidence_ids, claim_type, assertion_status, author_confidence, evidence_strength, extractor_method, extractor_confidence.

    One row for each assessed field of a report whose object names evidence. What is judged are the excerpts that its ids name, in the
    report's order. A status told as possible is an inference, even beside a denial; denials come before anything else. claims (key,
    evidence_id, predicate, claim_type, assertion_status, author_confidence) of the field's predicates then decide type and status;
    by_rules (key, evidence_id) is what rules have found. Ids that name no evidence add no text, and without any text the strength is unknown.
    """
    found = written(nodes(docs, key, json, skip=("evidence_ids",), texts=False), "report-nodes")
    of_evidence = lambda name: found.filter(F.col("pointer").rlike(rf"^/evidence/\d+/{name}$")).select(key, F.regexp_extract("pointer", r"^/evidence/(\d+)", 1).cast("long").alias("n"), "value")
    single = "|".join(p for p, _ in ASSESSED)
    listed = "|".join(rf"/{p}/\d+" for p in ASSESSED_LISTS)
    objects = found.filter((F.size("evidence_ids") > 0) & F.col("pointer").rlike(f"^(?:{single}|{listed})$")).select(key, "pointer", "evidence_ids")
    sure = found.filter(F.col("pointer").rlike(r"^/attribution/actors/\d+/confidence$")).select(key, F.regexp_replace("pointer", "/confidence$", "").alias("pointer"), F.col("value").alias("actor_confidence"))
    objects = objects.join(sure, [key, "pointer"], "left")
    each = objects.select(key, "pointer", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    named = each.join(of_evidence("evidence_id").withColumnRenamed("value", "evidence_id"), [key, "evidence_id"]).groupBy(key, "pointer").agg(F.sort_array(F.collect_list("n")).alias("ns"))
    named = written(named, "field-excerpts")
    wording = _wording(named.select(key, "ns").distinct(), of_evidence("excerpt"), key)
    objects = objects.join(named, [key, "pointer"], "left").join(wording, [key, "ns"], "left")
    fields = F.coalesce(*(F.when(F.col("pointer") == p, F.array(*(F.lit(f"{p}/{f}") for f in names))) for p, names in ASSESSED if names), F.array("pointer"))
    rows = objects.withColumn("field_path", F.explode(fields))
    rows = rows.withColumn("field_path", _field_path(F.col("field_path")))
    base = F.regexp_replace(F.regexp_replace("field_path", r"\[\d+\]", ""), r"^event\.", "")
    topic = F.coalesce(*(F.when((base == p) | base.startswith(f"{p}."), p) for p in FIELD_PREDICATES))
    rows = rows.withColumn("topic", topic)
    none = F.array().cast("array<string>")
    if claims is None:
        rows = rows.withColumns({"types": none, "states": none, "levels": none})
    else:
        allowed = docs.sparkSession.createDataFrame([(t, p) for t, ps in FIELD_PREDICATES.items() for p in ps], "topic string, predicate string")
        said = rows.select(key, "field_path", "topic", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id")).join(claims, [key, "evidence_id"])
        said = said.join(F.broadcast(allowed.withColumn("_ok", F.lit(True))), ["topic", "predicate"], "left").filter(F.col("topic").isNull() | F.col("_ok"))  # fixed and small
        told = said.groupBy(key, "field_path").agg(F.collect_set("claim_type").alias("types"), F.collect_set("assertion_status").alias("states"), F.collect_set("author_confidence").alias("levels"), F.lit(True).alias("claimed"))
        rows = rows.join(told, [key, "field_path"], "left").withColumns({c: F.coalesce(c, none) for c in ("types", "states", "levels")})
    claimed = F.coalesce(F.col("claimed"), F.lit(False)) if claims is not None else F.lit(False)
    if by_rules is None:
        ruled = F.lit(False)
    else:
        held = rows.select(key, "field_path", F.explode("evidence_ids").alias("evidence_id")).join(by_rules.select(key, "evidence_id").distinct(), [key, "evidence_id"], "left_semi").select(key, "field_path").distinct()
        rows = rows.join(held.withColumn("ruled", F.lit(True)), [key, "field_path"], "left")
        ruled = F.coalesce("ruled", F.lit(False))
    rows = rows.withColumn("j", judged(F.col("says"), F.col("field_path"), F.col("actor_confidence"), claimed, F.col("types"), F.col("states"), F.col("levels")))
    method = F.when(claimed & ruled, METHODS[0][0]).when(claimed, METHODS[1][0]).otherwise(METHODS[2][0])
    rows = rows.withColumn("extractor_method", method)
    certain = F.coalesce(*(F.when(F.col("extractor_method") == m, F.lit(c)) for m, c in METHODS))
    return rows.select(key, "field_path", F.array_distinct("evidence_ids").alias("evidence_ids"), "j.*", "extractor_method", certain.alias("extractor_confidence"))


#: Wordings that decide how a field is judged.
WORDINGS = {"possible": rules.POSSIBLE, "negative": rules.NEGATIVE, "speculative": rules.SPECULATIVE, "likely": rules.LIKELY, "attribution": rules.ATTRIBUTION, "confirmed": rules.CONFIRMED, **dict(rules.CONFIDENCE)}
#: Parts of words in small letters, one of which is in whatever the pattern of a wording finds.
CUES = {
    "possible": ["may", "might", "could", "possibl", "potential", "appear", "seem", "可能", "或许", "疑似", "推"], "negative": ["evidence", "observe", "confirm", "证据", "未", "无法", "不能"],
    "speculative": ["speculat", "hypothes", "猜测", "假设"], "likely": ["likely", "probably", "assess", "believe", "suspect", "可能", "研判", "认为", "据信"],
    "attribution": ["attribut", "associated", "linked", "state-spons", "government", "归因", "关联", "国家支持", "政府支持"], "confirmed": ["confirmed", "verified", "observed", "demonstrated", "identified", "detected", "确认", "证实", "验证", "到", "发现"],
    "explicit_high": ["high", "高"], "explicit_medium": ["medium", "中"], "explicit_low": ["low", "低"],
}


def with_wording(rows: DataFrame, column: str) -> DataFrame:
    """rows with says instead of column: a struct of which WORDINGS the text has, and whether there is any text (filled).

    Most texts have no cue of a wording; patterns only read those that have one.
    """
    low, text = F.col("_low"), F.col(column)
    cued = lambda name: functools.reduce(Column.__or__, (F.contains(low, F.lit(c)) for c in CUES[name]))
    says = F.struct((text != "").alias("filled"), *((cued(n) & text.rlike(p)).alias(n) for n, p in WORDINGS.items()))
    return rows.withColumn("_low", F.lower(column)).withColumn("says", says).drop("_low", column)


def _wording(sets: DataFrame, excerpts: DataFrame, key: str) -> DataFrame:
    """sets (key, ns: numbers of excerpts) with says, the wording of these excerpts as one text; excerpts: key, n, value.

    Patterns read each text once, in a table of its own, however many fields it stands for. One excerpt is judged where it
    lies; only sets of several put their texts together.
    """
    filled = excerpts.withColumn("value", F.coalesce("value", F.lit("")))
    alone = written(with_wording(filled, "value"), "excerpt-wording")
    one = sets.filter(F.size("ns") == 1).withColumn("n", F.get("ns", F.lit(0))).join(alone, [key, "n"]).drop("n")
    parts = sets.filter(F.size("ns") > 1).select(key, "ns", F.posexplode("ns").alias("_nth", "n")).join(filled, [key, "n"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_nth", "value"))), lambda e: e["value"]), " ")
    together = parts.groupBy(key, "ns").agg(text.alias("text"))
    return one.unionByName(written(with_wording(together, "text"), "excerpts-wording"))


def judged(says: Column, path: Column, actor: Column, claimed: Column, types: Column, states: Column, levels: Column) -> Column:
    """Struct claim_type, assertion_status, author_confidence, evidence_strength of a field by the wording (`with_wording`) of its evidence, null for none, and claims."""
    has = lambda name: F.coalesce(says[name], F.lit(False))
    attributed = path.startswith("event.attribution") | has("attribution")
    ladder = [
        ((path == "event.status") & has("possible"), "author_inference", "possible"), (has("negative"), "negative_evidence", "denied"),
        (claimed, F.coalesce(_first_of(CLAIM_TYPES, types), F.lit("author_assessment")), F.coalesce(_first_of(CLAIM_STATES, states), F.lit("unknown"))),
        (has("speculative"), "author_inference", "speculative"), (has("possible"), "author_inference", "possible"), (has("likely"), "author_assessment", "likely"), (attributed, "author_assessment", "asserted"),
    ]
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    kind, state = F, F
    for test, claim, status in ladder:
        kind, state = kind.when(test, as_column(claim)), state.when(test, as_column(status))
    kind, state = kind.otherwise("direct_observation"), state.otherwise("asserted")
    sure = F.coalesce(_first_of(CLAIM_CONFIDENCE, levels), *(F.when(has(level) | (actor == level.removeprefix("explicit_")), level) for level, _ in rules.CONFIDENCE), F.lit("not_stated"))
    high = sure == "explicit_high"
    strength = (
        F.when(~has("filled"), "unknown").when(state == "denied", "strong").when(has("confirmed") & (state == "asserted"), "confirmed").when(state.isin("possible", "speculative"), "weak")
        .when((state == "likely") | kind.isin("author_inference", "author_assessment"), F.when(high, "strong").otherwise("moderate")).when(state == "asserted", "strong").otherwise("unknown")
    )
    return F.struct(kind.alias("claim_type"), state.alias("assertion_status"), sure.alias("author_confidence"), strength.alias("evidence_strength"))
