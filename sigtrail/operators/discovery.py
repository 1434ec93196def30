"""Events that reports name: candidates by patterns, repeated tokens and targets, merged over their aliases, and what belongs to each.

Blocks are rows (key, index, text; optionally kind, section, page), index counting a document's blocks. What is said of an
event stays in rows: mentions, contexts and hits are joined on (key, index), names of one event are a connected component.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.functions import scalars as S
from sigtrail.operators import assess, events, rules
from sigtrail.operators.similarity import components
from sigtrail.operators.store import written

# Names that are no events, and patterns of names. A rule: number, pattern, group of the name, of the hint (or the
# hint), of an alias, group that must be empty, only the first match of a block, only in headings.
NO_NAMES = ["LLM", "API", "GTIG", "MCP", "AI", "CVE", "MOF", "CERT-UA", "NCSA", "ICT"]
NAME_RULES = [
    (0, r"\b([A-Z][A-Z0-9-]{3,30})\s+(Reverse Shell|Dropper|Ransomware|Data Miner|Credential Stealer)\b", 1, 2, None, None, False, False),
    (1, r"(?i)\b([A-Z][A-Z0-9-]{3,30})\s+is\s+(?:an?\s+)?(?:experimental\s+)?(reverse shell|dropper|ransomware|data miner|credential stealer|malware)\b", 1, 2, None, None, False, False),
    (2, r"(?i)((?:\b(?:group|actor|operators?)\s+)?)\b(?:tracked as|designated|dubbed)\s+[‘'\"]?([A-Z][A-Za-z0-9-]{3,30})", 2, None, None, 1, False, False),
    (3, r"\b(GTG-\d{3,6})\b", 1, "campaign", None, None, False, False),
    (4, r"(?i)track as\s+([A-Z][A-Z0-9-]+).*?reported.*?as\s+([A-Z][A-Z0-9-]+)", 1, "malware", 2, None, True, False),
    (5, r"(?i)Targeted With\s+([A-Z][A-Za-z0-9-]+)\s+AI Agent", 1, "intrusion", 1, None, True, False),
    (6, r"([A-Z][A-Za-z0-9-]+)/([A-Z][A-Z0-9-]{3,})", 2, "malware", 1, None, True, True),
    (7, r"\b([A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+)\b", 1, "malware", None, None, False, True),
]
AGENT_RULE, CAMEL_RULE = 5, 7
CAMEL_WORDS = r"(?i)prompt|terminal|malware|ransom"
TOKEN, NO_TOKEN = r"\b[A-Z][A-Z0-9-]{4,30}\b", r"^(?:APT\d+|UAC-\d+|T\d+)$"
TOKEN_WORDS = r"(?i)PROMPT|SHELL$|VAULT$|LOCK$|STEAL$|FLUX$|MAL$"
NEAR_WORDS = ["malware", "dropper", "ransomware", "data miner", "credential stealer", "reverse shell", "AI prompt", "LLM"]
NEAR_TOKEN = "(?i)" + "|".join(NEAR_WORDS)
#: The halves of those of two words, which may be the end of one block and the begin of the next.
NEAR_HALVES = [tuple(w.split(" ")) for w in NEAR_WORDS if " " in w]
ALSO_KNOWN = r"(?i)([A-Z][A-Za-z0-9-]{3,})\s*\(\s*(?:aka|also known as)\s+([A-Z][A-Za-z0-9-]{3,})"
#: Parts of words in small letters, one of which is in whatever a name rule, ALSO_KNOWN (after a bracket) or, in capitals, TOKEN_WORDS finds. Rules of headings have none.
KINDS = ["reverse shell", "dropper", "ransomware", "data miner", "credential stealer"]
NAME_CUES = {0: KINDS, 1: [*KINDS, "malware"], 2: ["tracked as", "designated", "dubbed"], 3: ["gtg-"], 4: ["track as"], 5: ["targeted with"]}
ALSO_CUES, TOKEN_CUES = ["aka", "also known as"], ["PROMPT", "SHELL", "VAULT", "LOCK", "STEAL", "FLUX", "MAL"]
QUOTES = "'\"‘’“”.,:;()[]"
ROLES = [
    ("Reverse Shell", "reverse_shell"), ("Dropper", "dropper"), ("Ransomware", "ransomware"), ("Data Miner", "data_miner"), ("Credential Stealer", "credential_stealer"),
    ("implant", "implant"), ("malware generator", "malware_generator"), ("AI agent", "agent"),
]
LANGUAGES = ["VBScript", "PowerShell", "Python", "JavaScript", "Golang", "Go", "Lua"]
FAMILY_TYPES = ["malware_operation", "ransomware", "proof_of_concept"]
IMPLANT = r"(?i)(?:implant|payload).*?(?:refers to as|named)\s+[\"']?([A-Z][A-Za-z0-9-]{3,})"
SHA256 = r"\b[a-fA-F0-9]{64}\b"
PROMPT_CUES = r"(?i)output|generate|rewrite|act as|command|bypass|YOLO|persona|leverages"
PROMPT_WORKED = r"(?i)blindly executed|then executes|able to induce|logs show"
#: Blocks around a repeated token; reach of an anchor; blocks before the first hit of a lone event; blocks of which a role is
#: read, and characters between a name and its role; prompts of an event.
NEAR_BLOCKS, REACH, BEFORE_FIRST, ROLE_BLOCKS, ROLE_CHARS, MOST_PROMPTS = 2, 15, 10, 80, 80, 4
_PAGELESS = {"kind": "string", "section": "string", "page": "long"}


def _filled(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({c: F.lit(None).cast(t) for c, t in _PAGELESS.items() if c not in blocks.columns})


def _clean(name: Column) -> Column:
    return F.btrim(S.normalize_space(name), F.lit(QUOTES))


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


# --- candidates -----------------------------------------------------------------------------------------------------------


def _matches(pattern: str, *groups: int | None) -> Column:
    """The matches of a pattern as structs g0, g1, ... of its groups; null for a group that isn't named."""
    found = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in groups if g is not None]
    at = iter(range(len(found)))
    places = [None if g is None else next(at) for g in groups]
    part = lambda i: F.struct(*(F.lit(None).cast("string").alias(f"g{k}") if p is None else F.get(found[p], i).alias(f"g{k}") for k, p in enumerate(places)))
    return F.when(F.size(found[0]) > 0, F.transform(F.sequence(F.lit(0), F.size(found[0]) - 1), part)).otherwise(F.array().cast("array<struct<" + ",".join(f"g{k}: string" for k in range(len(groups))) + ">>"))


def _any_of(text: Column, words: list[str]) -> Column:
    return functools.reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def _pattern_mentions(blocks: DataFrame, key: str) -> DataFrame:
    """key, index, ord, name, alias, hint: what the name rules find, in one pass over the blocks; patterns only read what has a cue."""
    is_heading = F.col("kind").eqNullSafe("heading")
    blocks = blocks.withColumn("_low", F.lower("text")).filter(is_heading | _any_of(F.col("_low"), sorted({c for cues in NAME_CUES.values() for c in cues})))
    parts = []
    for rule, pattern, name, hint, alias, empty, first, heading in NAME_RULES:
        found = _matches(pattern, name, hint if isinstance(hint, int) else None, alias, empty)
        found = F.slice(found, 1, 1) if first else found
        kept = F.when(is_heading, found) if heading else F.when(_any_of(F.col("_low"), NAME_CUES[rule]) & F.col("text").rlike(pattern), found)
        parts.append(F.transform(F.coalesce(kept, F.array().cast("array<struct<g0: string, g1: string, g2: string, g3: string>>")), _as_mention(rule, hint)))
    rows = blocks.select(key, "index", F.posexplode(F.flatten(F.array(*parts))).alias("n", "m")).select(key, "index", "n", "m.*")
    rows = rows.filter(F.coalesce(F.col("unless"), F.lit("")) == "").filter((F.col("rule") != CAMEL_RULE) | F.col("name").rlike(CAMEL_WORDS))
    name = F.when(F.col("rule") == AGENT_RULE, F.concat("name", F.lit(" intrusion"))).otherwise(F.col("name"))
    return rows.select(key, "index", F.struct(F.lit(0).alias("stage"), "index", "n").alias("ord"), name.alias("name"), "alias", "hint")


def _as_mention(rule: int, hint: int | str | None):
    said = lambda x: x["g1"] if isinstance(hint, int) else F.lit(hint).cast("string")
    return lambda x: F.struct(F.lit(rule).alias("rule"), x["g0"].alias("name"), said(x).alias("hint"), x["g2"].alias("alias"), x["g3"].alias("unless"))


def _repeated_tokens(blocks: DataFrame, key: str) -> DataFrame:
    """Tokens that a document repeats, with words of malware within NEAR_BLOCKS blocks of one of their places."""
    tokens = blocks.filter(_any_of(F.col("text"), TOKEN_CUES) & F.col("text").rlike(TOKEN)).select(key, "index", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("name"))
    tokens = tokens.filter(~F.col("name").isin(NO_NAMES) & ~F.col("name").rlike(NO_TOKEN) & F.col("name").rlike(TOKEN_WORDS))
    twice = tokens.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("first")).filter("n > 1").drop("n")
    places = tokens.distinct().join(twice, [key, "name"])
    reach = places.select(key, "name", "first", F.col("index").alias("at"), F.explode(F.sequence(F.col("index") - NEAR_BLOCKS, F.col("index") + NEAR_BLOCKS)).alias("index"))
    # Of a block only goes along what may be part of a match: such a word, or the halves that it begins and ends with.
    halves, longest = (["|".join(h[k] for h in NEAR_HALVES) for k in (0, 1)], max(len(x) for h in NEAR_HALVES for x in h))
    whole = _any_of(F.lower("text"), [w.lower() for w in NEAR_WORDS]) & F.col("text").rlike(NEAR_TOKEN)
    begins, ends = F.regexp_extract(F.left("text", F.lit(longest)), f"(?i)^(?:{halves[1]})", 0), F.regexp_extract(F.right("text", F.lit(longest)), rf"(?i)(?:{halves[0]})\z", 0)
    brief = F.when(whole, F.lit(NEAR_WORDS[0])).otherwise(F.concat(begins, F.lit("\x1f"), ends))
    near = reach.join(blocks.select(key, "index", brief.alias("text")), [key, "index"]).groupBy(key, "name", "first", "at")
    around = near.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "text"))), lambda b: b["text"]), " ").alias("around"))
    said = around.filter(F.col("around").rlike(NEAR_TOKEN)).select(key, "name", "first").distinct()
    none = F.lit(None).cast("string").alias("alias")
    return said.select(key, F.col("first").alias("index"), F.struct(F.lit(1).alias("stage"), F.col("first").alias("index"), F.lit(0).alias("n")).alias("ord"), "name", none, F.lit("malware").alias("hint"))


def _targets(blocks: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Targets (key, name, aliases, hint) that a document's text or sections name as a word."""
    rows = blocks.select(key, "index", "text", "section").join(targets.select(key, _clean(F.col("name")).alias("name"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), _clean).alias("aliases"), "hint"), key)
    terms = F.filter(F.concat(F.array("name"), "aliases"), lambda t: t != "")
    word = lambda t: F.concat(F.lit("(?i)(?<![A-Za-z0-9])\\Q"), t, F.lit("\\E(?![A-Za-z0-9])"))
    held = F.exists(terms, lambda t: F.regexp_like("text", word(t)) | F.coalesce(F.regexp_like("section", word(t)), F.lit(False)))
    ord_ = F.struct(F.lit(2).alias("stage"), "index", F.coalesce("pos", F.lit(0)).alias("n")).alias("ord")
    found = rows.filter(held).select(key, "index", "name", "hint", F.posexplode_outer("aliases").alias("pos", "alias"))
    return found.select(key, "index", ord_, "name", "alias", F.coalesce("hint", F.lit("target_family")).alias("hint"))


def mentions(blocks: DataFrame, key: str = "artifact", targets: DataFrame | None = None) -> DataFrame:
    """key, index, ord, name, name_key, alias, hint: each place that makes a name a candidate. Names of less than four characters are none."""
    blocks = _filled(blocks)
    rows = _pattern_mentions(blocks, key).unionByName(_repeated_tokens(blocks, key))
    rows = rows if targets is None else rows.unionByName(_targets(blocks, targets, key))
    rows = rows.withColumn("name", _clean(F.col("name"))).withColumn("alias", _clean(F.col("alias")))
    return rows.filter((F.length("name") >= 4) & ~F.upper("name").isin(NO_NAMES)).withColumn("name_key", name_key(F.col("name")))


def also_known(blocks: DataFrame, key: str = "artifact") -> DataFrame:
    """key, index, ord, a, b: names that a text says are of one thing."""
    cued = F.contains("text", F.lit("(")) & _any_of(F.lower("text"), ALSO_CUES)
    rows = blocks.filter(cued & F.col("text").rlike(ALSO_KNOWN)).select(key, "index", F.posexplode(_matches(ALSO_KNOWN, 1, 2)).alias("n", "m"))
    return rows.select(key, "index", F.struct(F.lit(3).alias("stage"), "index", "n").alias("ord"), F.col("m.g0").alias("a"), F.col("m.g1").alias("b"))


def discover(blocks: DataFrame, key: str = "artifact", targets: DataFrame | None = None) -> DataFrame:
    """key, name_key, name, aliases, hints, first_index, n_anchors: the events of each document.

    A name is what its first mention calls it. Names that "aka" connects, also over further names, are one event: the first one in
    capitals is its name (else the first), all others are aliases. aliases and hints are in the order in which they are said, each
    once; an alias that only differs from the name in case is none. n_anchors counts the blocks that mention it. Blocks without text
    name nothing; a document without names has no row. Only names, not blocks, are collected for an event.
    """
    said = written(mentions(blocks.filter(F.col("text").isNotNull()), key, targets), "mentions")  # the texts are read once for it
    first = said.groupBy(key, "name_key").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"), F.min("index").alias("first_index"))
    node = lambda name: F.concat_ws("\x1f", F.col(key).cast("string"), F.lower(name))
    pairs = written(also_known(blocks, key), "aliases")
    named = components(pairs.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    first = first.withColumn("node", node(F.col("name"))).join(named, "node", "left").withColumn("group", F.coalesce("component", "node"))
    lead = first.groupBy(key, "group").agg(F.min_by(F.struct("name_key", "name"), F.struct(~((F.upper("name") == F.col("name")) & F.col("name").rlike("[A-Z]")), "first_index", "ord")).alias("lead"))
    members = first.select(key, "name_key", "group")
    every = said.join(members, [key, "name_key"])
    known = pairs.select(key, "ord", F.explode(F.array("a", "b")).alias("alias")).withColumn("node", node(F.col("alias"))).join(named, "node").select(key, F.col("component").alias("group"), "alias", "ord")
    aliases = every.filter("alias <> ''").select(key, "group", "alias", "ord").unionByName(first.select(key, "group", F.col("name").alias("alias"), "ord")).unionByName(known)
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("ord", c))), lambda x: x[c])
    aliases = aliases.groupBy(key, "group", "alias").agg(F.min("ord").alias("ord")).join(lead, [key, "group"]).filter(F.lower("alias") != F.lower("lead.name")).groupBy(key, "group").agg(in_order("alias").alias("aliases"))
    hints = every.filter(F.col("hint").isNotNull()).groupBy(key, "group", "hint").agg(F.min("ord").alias("ord")).groupBy(key, "group").agg(in_order("hint").alias("hints"))
    anchors = every.groupBy(key, "group").agg(F.min("index").alias("first_index"), F.countDistinct("index").alias("n_anchors"))
    out = lead.join(anchors, [key, "group"]).join(aliases, [key, "group"], "left").join(hints, [key, "group"], "left")
    none = F.array().cast("array<string>")
    return out.select(key, "lead.name_key", "lead.name", F.coalesce("aliases", none).alias("aliases"), F.coalesce("hints", none).alias("hints"), "first_index", "n_anchors")


# --- what belongs to an event ---------------------------------------------------------------------------------------------


def contexts(blocks: DataFrame, candidates: DataFrame, key: str = "artifact") -> DataFrame:
    """key, name_key, index, text, section: the blocks of each event.

    Of a document with one event: from BEFORE_FIRST blocks before its first mention to the last section "summary" (to the end
    without one; all blocks, if it is nowhere mentioned by name). With several: a block whose section, else whose text names one of
    them is its; one that names several is nobody's; any other goes to the only event with the nearest mention within REACH blocks,
    of its own page where it has one. Names, aliases and the name's first word count, in any case.
    """
    blocks = _filled(blocks).select(key, "index", "text", "section", "page")
    terms = F.array_distinct(F.filter(F.concat(F.array("name"), "aliases", F.array(F.get(F.split("name", r"\s+"), F.lit(0)))), lambda t: t != ""))
    known = candidates.select(key, F.struct("name_key", F.transform(terms, F.lower).alias("terms")).alias("c")).groupBy(key).agg(F.collect_list("c").alias("events"))
    has = lambda text, c: F.exists(c["terms"], lambda t: F.contains(text, t))
    owners = lambda text: F.transform(F.filter("events", lambda c: F.coalesce(has(F.col(text), c), F.lit(False))), lambda c: c["name_key"])
    rows = blocks.join(known, key).withColumns({"low_section": F.lower("section"), "low_text": F.lower("text")}).withColumn("by_section", owners("low_section")).withColumn("by_text", owners("low_text"))
    rows = rows.withColumn("owners", F.when(F.size("by_section") > 0, F.col("by_section")).otherwise(F.col("by_text")))
    summary = F.coalesce(F.lower(S.normalize_space(F.col("section"))) == "summary", F.lit(False)).alias("summary")
    only = F.when(F.size("events") == 1, F.get("events", F.lit(0))["name_key"]).alias("only")
    rows = rows.select(key, "index", "text", "section", "page", summary, only, "owners", F.array_distinct(F.concat("by_section", "by_text")).alias("named"))
    # A document's blocks are in one task by now, so all else is windows over them.
    in_order = Window.partitionBy(key).orderBy("index")
    whole, reach = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), in_order.rangeBetween(-REACH, REACH)
    names_some = F.size("named") > 0
    rows = rows.select(
        "*", F.min(F.when(names_some, F.col("index"))).over(whole).alias("first"), F.max(F.when(F.col("summary"), F.col("index"))).over(whole).alias("last"),
        F.collect_list(F.when(names_some, F.struct(F.col("index").alias("at"), "page", "named"))).over(reach).alias("near"),
    )
    inside = F.col("first").isNull() | ((F.col("index") >= F.col("first") - BEFORE_FIRST) & (F.col("last").isNull() | (F.col("index") <= F.col("last"))))
    away = lambda a: F.abs(a["at"] - F.col("index"))
    rows = rows.withColumn("near", F.when(F.col("only").isNull() & (F.size("owners") == 0), F.filter("near", lambda a: F.col("page").isNull() | (a["page"] == F.col("page")))))
    rows = rows.withColumn("least", F.array_min(F.transform("near", away)))
    rows = rows.withColumn("nearest", F.array_distinct(F.flatten(F.transform(F.filter("near", lambda a: away(a) == F.col("least")), lambda a: a["named"]))))
    single = lambda names: F.when(F.size(names) == 1, F.get(names, F.lit(0)))
    owner = F.when(F.col("only").isNotNull(), F.when(inside, F.col("only"))).when(F.size("owners") > 0, single("owners")).otherwise(single("nearest"))
    return rows.select(key, owner.alias("name_key"), "index", "text", "section").filter("name_key is not null")


def with_terms(context: DataFrame, candidates: DataFrame, key: str = "artifact") -> DataFrame:
    """context with event_id, name and term, a pattern of the event's names as words."""
    names = F.array_distinct(F.filter(F.concat(F.array("name"), "aliases"), lambda t: t != ""))
    term = F.concat(F.lit("(?i)(?<![A-Za-z0-9])(?:"), F.array_join(F.transform(names, lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E"))), "|"), F.lit(")(?![A-Za-z0-9])"))
    # All events of a document are one row: blocks that are together by document aren't shuffled again.
    known = candidates.select(key, F.struct("name_key", "name", "aliases", "hints", term.alias("term")).alias("c")).groupBy(key).agg(F.collect_list("c").alias("events"))
    rows = context.join(known, key).withColumn("c", F.get(F.filter("events", lambda c: c["name_key"] == F.col("name_key")), F.lit(0))).filter(F.col("c").isNotNull())
    return rows.select(*context.columns, "c.name", "c.aliases", "c.hints", "c.term").withColumn("event_id", S.stable_id("event", F.col(key), F.col("name_key")))


def assembled(context: DataFrame, key: str = "artifact") -> DataFrame:
    """One nested event for each event_id of context (`with_terms`): facts with their evidence, grounded status, time and type."""
    found = events.facts(context, "event_id")
    status = assess.grounded_status(context, "event_id", "term").select("event_id", "status")
    kinds = context.groupBy("event_id", key, "name").agg(F.min_by(rules.event_type(F.col("text")), F.struct(rules.event_type(F.col("text")) == "unknown", "index")).alias("event_type"))
    return kinds.join(events.assemble(found, events.first_month(context, "event_id"), status, "event_id"), "event_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def _places(text: Column, term: Column) -> Column:
    """Where a term begins in a text (from 0), in any case, matches not overlapping."""
    pieces = F.split(F.lower(text), F.concat(F.lit("\\Q"), F.lower(term), F.lit("\\E")), F.lit(-1))
    step = lambda s, p: F.struct((s["at"] + F.length(p) + F.length(term)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(p))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda s: s["out"])


def artifacts(context: DataFrame, events_of: DataFrame, key: str = "artifact") -> DataFrame:
    """event_id, family, aliases, sha256, scope, role, language, packer: what an event's texts say of its files.

    context: `with_terms`; events_of: event_id, event_type. An event of a type or hint of malware has its family as an artifact; an
    implant or payload that is named is another. Hashes count in blocks that name the artifact, in their order, each once; of the last
    such block more than one hash makes it a set of samples, one an exact sample. A role must be within ROLE_CHARS characters of the
    name in the event's first ROLE_BLOCKS blocks, read as one line; the first role of the list counts. That is a join of places in
    buckets, so that no event's text is put together.
    """
    hinted = F.exists("hints", lambda h: F.contains(F.lit(" ".join(label for label, _ in ROLES).lower()), F.lower(h)))
    heads = context.groupBy("event_id").agg(F.min_by(F.struct("name", "aliases", hinted.alias("hinted")), "index").alias("e")).select("event_id", "e.*").join(events_of, "event_id")
    family = heads.filter(F.col("event_type").isin(FAMILY_TYPES) | F.col("hinted")).select("event_id", F.lit(0).alias("part"), F.col("name").alias("family"), "aliases", F.lit("family").alias("scope"), F.lit(None).cast("string").alias("role"))
    named = context.filter(F.col("text").rlike(IMPLANT)).groupBy("event_id").agg(F.min_by(F.regexp_extract("text", IMPLANT, 1), "index").alias("family"))
    implant = named.select("event_id", F.lit(1).alias("part"), "family", F.array().cast("array<string>").alias("aliases"), F.lit("artifact_only").alias("scope"), F.lit("implant").alias("role"))
    known = family.unionByName(implant)
    rows = context.select("event_id", "index", "text").join(known.select("event_id", "part", "family", "aliases"), "event_id")
    about = rows.filter(F.exists(F.concat(F.array("family"), "aliases"), lambda t: F.contains(F.lower("text"), F.lower(t))))
    hashed = about.withColumn("h", F.transform(F.regexp_extract_all("text", F.lit(SHA256), F.lit(0)), F.lower)).filter(F.size("h") > 0)
    scope = hashed.groupBy("event_id", "part").agg(F.max_by(F.when(F.size("h") > 1, "sample_set").otherwise("exact_sample"), "index").alias("found_scope"))
    each = hashed.select("event_id", "part", "index", F.posexplode("h").alias("n", "hash")).groupBy("event_id", "part", "hash").agg(F.min(F.struct("index", "n")).alias("at"))
    hashes = each.groupBy("event_id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]).alias("sha256"))
    # Places in the first blocks, as if these were one line with a space between blocks.
    upto = Window.partitionBy("event_id").orderBy("index")
    line = context.select("event_id", "index", "text", F.row_number().over(upto).alias("nth"), (F.sum(F.length("text") + 1).over(upto) - F.length("text") - 1).alias("start")).filter(F.col("nth") <= ROLE_BLOCKS)
    labels = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(len(label)).alias("size"), _places(F.col("text"), F.lit(label)).alias("at")) for k, (label, _) in enumerate(ROLES)))
    label_at = line.select("event_id", "start", F.inline(F.filter(labels, lambda x: F.size(x["at"]) > 0))).select("event_id", "n", "size", "start", F.explode("at").alias("l")).withColumn("l", F.col("start") + F.col("l")).drop("start")
    name_at = line.join(known.select("event_id", "part", "family"), "event_id").select("event_id", "part", F.length("family").alias("length"), "start", F.explode(_places(F.col("text"), F.col("family"))).alias("f"))
    width = 256
    name_at = name_at.withColumn("f", F.col("start") + F.col("f")).drop("start").withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.expr(f"f div {width}") + d)))
    close = name_at.join(label_at.withColumn("bucket", F.expr(f"l div {width}")), ["event_id", "bucket"])
    gap = F.greatest(F.col("l") - F.col("f") - F.col("length"), F.col("f") - F.col("l") - F.col("size"))
    role = close.filter((gap >= 0) & (gap <= ROLE_CHARS)).groupBy("event_id", "part").agg(F.min("n").alias("role_no"))
    tests = [F.max(F.contains("text", F.lit("PyInstaller"))).alias("packed"), *(F.max(F.col("text").rlike(rf"(?i)(?:written|compiled) in {x}")).alias(f"in_{x}") for x in LANGUAGES)]
    words = line.groupBy("event_id").agg(*tests)
    language = F.coalesce(*(F.when(F.col(f"in_{x}"), F.lit("Go" if x == "Golang" else x)) for x in LANGUAGES))
    names = F.element_at(F.array(*(F.lit(r) for _, r in ROLES)), F.col("role_no") + 1)
    out = known.join(scope, ["event_id", "part"], "left").join(hashes, ["event_id", "part"], "left").join(role, ["event_id", "part"], "left").join(words, "event_id")
    return out.select(
        "event_id", "family", "aliases", F.coalesce("sha256", F.array().cast("array<string>")).alias("sha256"), F.coalesce("found_scope", "scope").alias("scope"),
        F.when(F.col("role_no").isNotNull(), names).otherwise(F.col("role")).alias("role"), language.alias("language"), F.when(F.col("packed"), "PyInstaller").alias("packer"),
    )


def prompt_mentions(context: DataFrame) -> DataFrame:
    """event_id, purpose, index, n_blocks, constraints, evasion, effectiveness: prompts that an event's blocks describe.

    Blocks of one purpose are one prompt; what its first block says counts. Of an event the first MOST_PROMPTS purposes are kept, with
    the blocks up to the one that completes them.
    """
    has = lambda flag: F.lower("text").rlike(assess.REPORT_FLAGS[flag])
    rows = context.filter(F.lower("text").contains("prompt") & F.col("text").rlike(PROMPT_CUES))
    purpose = F.coalesce(events.purpose(F.col("text")), F.when(has("evasion"), "analysis_evasion").when(F.lower("text").contains("collect"), "data_collection"), F.lit(""))
    kept = ["output_only", "code_only", "single_line_command", "role_definition"]
    rows = rows.select(
        "event_id", "index", purpose.alias("purpose"), F.array_compact(F.array(*(F.when(has(c), c) for c in ["role_definition", *kept[:3]]))).alias("constraints"), has("evasion").alias("evasion"),
        F.when(F.col("text").rlike(PROMPT_WORKED), "succeeded").otherwise("unknown").alias("effectiveness"),
    )
    first = rows.groupBy("event_id", "purpose").agg(F.min("index").alias("first"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("event_id").orderBy("first"))).filter(F.col("nth") <= MOST_PROMPTS)
    last = first.filter(F.col("nth") == MOST_PROMPTS).select("event_id", F.col("first").alias("last"))
    held = rows.join(first, ["event_id", "purpose"]).join(last, "event_id", "left").filter(F.col("last").isNull() | (F.col("index") <= F.col("last")))
    out = held.groupBy("event_id", "purpose").agg(F.min_by(F.struct("constraints", "evasion", "effectiveness"), "index").alias("p"), F.min("index").alias("index"), F.count(F.lit(1)).alias("n_blocks"))
    return out.select("event_id", F.when(F.col("purpose") != "", F.col("purpose")).alias("purpose"), "index", "n_blocks", "p.*")
