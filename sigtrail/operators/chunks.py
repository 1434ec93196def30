"""One event from the events of a report's chunks: scalars, lists and evidence merged by JSON pointer, and put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrail.operators.pointers import opened, scalar
from sigtrail.operators.store import written

# What says nothing, fields that a conflict makes unknown (others become null), and members that tell no items apart.
SAYS_NOTHING = ["", "unknown"]
UNKNOWN_FIELDS = r"/(?:event_type|precision|value|autonomy_level|output_handling)$"
NOT_IDENTITY = ["evidence_ids", "artifact_id"]
CONFLICT = "cross_chunk_conflict"


def _flat(chunks: DataFrame, key: str, chunk: str, event: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is outside of lists, the items of the outermost lists as they are (both: key, chunk, pointer, kind, evidence_ids, in_list, item, v),
    and the lists (key, pointer) whose items don't count."""
    keyed = chunks.select(F.struct(F.col(key).alias("key"), F.col(chunk).alias("chunk")).alias("k"), F.col(event).alias("event"))
    flat = opened(keyed, "k", "event", items=False).select("k.key", "k.chunk", "pointer", "kind", "evidence_ids", "in_list", "item", "v")
    outside, items = flat.filter("in_list is null"), flat.filter("item = pointer")
    shape = F.when(F.col("kind").isin("object", "array"), F.col("kind")).otherwise("scalar")
    kinds = outside.filter("kind <> 'null'").groupBy("key", "pointer").agg(F.collect_set(shape).alias("kinds"), F.min("chunk").alias("chunk")).filter(F.size("kinds") > 1)
    kinds = written(kinds, "chunk-shapes")
    # What isn't one shape in all chunks says nothing but that: one text for each shape, and nothing from below it.
    parts = F.split("pointer", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    below = outside.select("key", "pointer").distinct().withColumn("at", F.explode(above)).join(kinds.select("key", F.col("pointer").alias("at")), ["key", "at"], "left_semi").select("key", "pointer").distinct()
    below = written(below, "chunk-below")
    said = kinds.select("key", "chunk", "pointer", F.explode(F.sort_array("kinds")).alias("value"))
    none = {"evidence_ids": "array<string>", "in_list": "string", "item": "string"}
    said = said.withColumns({"kind": F.lit("string"), "v": F.parse_json(F.concat(F.lit('"'), "value", F.lit('"'))), **{c: F.lit(None).cast(t) for c, t in none.items()}}).drop("value")
    return written(outside.join(below, ["key", "pointer"], "left_anti").unionByName(said), "chunk-nodes"), items, below


def _scalars(outside: DataFrame) -> DataFrame:
    """key, pointer, json, known: the scalars outside lists; known holds the different values that say something, in order of chunks."""
    rows = outside.filter("kind not in ('object', 'array')").withColumn("json", F.to_json("v"))
    says = ~F.col("kind").eqNullSafe("null") & ~F.coalesce(scalar(), F.lit("")).isin(SAYS_NOTHING)
    each = rows.groupBy("key", "pointer", "json").agg(F.min("chunk").alias("first"), F.max(says).alias("says"))
    known = F.transform(F.sort_array(F.collect_list(F.when(F.col("says"), F.struct("first", "json")))), lambda x: x["json"])
    out = each.groupBy("key", "pointer").agg(known.alias("known"), F.min_by("json", F.struct("first", "json")).alias("first_json"))
    clash = F.when(F.col("pointer").rlike(UNKNOWN_FIELDS), F.lit('"unknown"')).otherwise(F.lit("null"))
    return out.select("key", "pointer", "known", F.when(F.size("known") > 1, clash).otherwise(F.coalesce(F.get("known", F.lit(0)), F.col("first_json"))).alias("json"))


def merged_items(items: DataFrame) -> DataFrame:
    """key, in_list, identity, kind, members, json, has_ids, ids, at: the different items of the outermost lists, with the evidence of all their copies.

    Items are equal if all but evidence_ids and artifact_id are (identity: a hash of that); the first one counts (at: its chunk and
    place). An object is told by its members in order of name, anything else by its json.
    """
    heads = items.select("key", "chunk", "in_list", "kind", "evidence_ids", "v", F.regexp_extract("item", r"(\d+)$", 1).cast("long").alias("place"))
    is_object = F.col("kind") == "object"
    member = lambda m: F.struct(m["key"].alias("name"), F.coalesce(F.to_json(m["value"]), F.lit("null")).alias("json"))
    members = F.sort_array(F.transform(F.map_entries(F.try_variant_get(F.when(is_object, F.col("v")), "$", "map<string, variant>")), member))
    rows = heads.withColumn("members", members).withColumn("json", F.when(~is_object, F.to_json("v"))).drop("v")
    told = F.filter("members", lambda m: ~m["name"].isin(NOT_IDENTITY))
    identity = F.concat("kind", F.lit(":"), F.when(is_object, F.to_json(told)).otherwise(F.col("json")))
    rows = rows.withColumn("identity", F.sha2(identity, 256)).withColumn("at", F.struct("chunk", "place"))
    first = rows.groupBy("key", "in_list", "identity").agg(F.min_by(F.struct("kind", "members", "json", F.col("evidence_ids").isNotNull().alias("has_ids")), "at").alias("i"), F.min("at").alias("at"))
    each = rows.select("key", "in_list", "identity", "at", F.posexplode("evidence_ids").alias("n", "id")).groupBy("key", "in_list", "identity", "id").agg(F.min(F.struct("at", "n")).alias("first"))
    ids = each.groupBy("key", "in_list", "identity").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "id"))), lambda x: x["id"]).alias("ids"))
    return first.join(ids, ["key", "in_list", "identity"], "left").select("key", "in_list", "identity", "i.*", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), "at")


def conflicts(outside: DataFrame) -> DataFrame:
    """key, pointer, values: scalars of which chunks say different things."""
    return _scalars(outside).filter(F.size("known") > 1).select("key", "pointer", F.col("known").alias("values"))


def _object(members) -> F.Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(members, lambda m: F.concat(F.to_json(F.struct(m["name"].alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(m["name"].alias("x")))) - 6), F.lit(":"), m["json"])), ","), F.lit("}"))


def merge_events(chunks: DataFrame, key: str = "artifact", chunk: str = "chunk", event: str = "event") -> tuple[DataFrame, DataFrame]:
    """(key, event) and (key, pointer, values): the merged event of each report as JSON, and its conflicts.

    Objects merge member by member, outermost lists by different items (`merged_items`), scalars that differ (null, "" and "unknown" say
    nothing) become "unknown" or null, and each such conflict is added to the report's limitations, with all its evidence. Levels are put
    together from the deepest up, so any depth works. Members come in order of name. Chunks that aren't JSON, or null, add
    nothing. A path that is an object, a list or a scalar in one chunk and something else in another is a conflict of these shapes.
    """
    outside, heads, below = _flat(chunks, key, chunk, event)
    items = merged_items(heads)
    quoted = F.to_json("ids")
    members = F.sort_array(F.concat(F.filter("members", lambda m: m["name"] != "evidence_ids"), F.when(F.col("has_ids"), F.array(F.struct(F.lit("evidence_ids").alias("name"), quoted.alias("json")))).otherwise(F.array().cast("array<struct<name: string, json: string>>"))))
    items = items.select("key", "in_list", "at", F.when(F.col("kind") == "object", F.coalesce(_object(members), F.lit("{}"))).otherwise(F.col("json")).alias("json"))
    clash = written(conflicts(outside), "chunk-clashes")
    void = below.select("key", F.col("pointer").alias("in_list"))
    evidence = heads.filter("in_list = '/evidence'").select("key", "chunk", "in_list", F.regexp_extract("item", r"(\d+)$", 1).cast("long").alias("place"), F.try_variant_get("v", "$.evidence_id", "variant").alias("v"))
    evidence = evidence.filter("v is not null").select("key", "chunk", "in_list", "place", F.try_variant_get("v", "$", "string").alias("value")).join(void, ["key", "in_list"], "left_anti")
    refs = evidence.groupBy("key", "value").agg(F.min(F.struct("chunk", "place")).alias("at"))
    refs = refs.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("refs"))
    said = F.concat(F.lit("chunks disagree: event"), "pointer", F.lit(" = ["), F.array_join("values", ","), F.lit("]"))
    limits = clash.join(refs, "key", "left").select(
        "key", F.lit("/limitations").alias("in_list"), F.struct(F.lit(None).cast(chunks.schema[chunk].dataType).alias("chunk"), F.lit(None).cast("long").alias("place")).alias("at"),
        F.to_json(F.struct(said.alias("description"), F.coalesce("refs", F.array().cast("array<string>")).alias("evidence_ids"), F.lit(CONFLICT).alias("type"))).alias("json"),
    )
    every = items.unionByName(limits).withColumn("late", F.col("at.chunk").isNull())
    lists = every.groupBy("key", "in_list").agg(F.collect_list(F.struct("late", "at", "json")).alias("items")).join(void.withColumn("void", F.lit(True)), ["key", "in_list"], "left")
    counted = F.filter(F.sort_array("items"), lambda x: x["late"] | F.col("void").isNull())
    lists = lists.select("key", F.col("in_list").alias("pointer"), counted.alias("items")).filter(F.size("items") > 0)
    lists = lists.select("key", "pointer", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["json"]), ","), F.lit("]")).alias("json"))
    filled = heads.select("key", "in_list").distinct().join(void, ["key", "in_list"], "left_anti").unionByName(limits.select("key", "in_list")).select("key", F.col("in_list").alias("pointer")).distinct()
    filled = written(filled, "chunk-lists")
    empty = outside.filter("kind = 'array'").select("key", "pointer").distinct().join(filled, ["key", "pointer"], "left_anti").withColumn("json", F.lit("[]"))
    hollow = outside.filter("kind = 'object' and pointer = ''").select("key").distinct().withColumn("json", F.lit("{}"))
    deep = lambda df: df.withColumn("depth", F.size(F.split("pointer", "/")) - 1)
    parts = written(deep(_scalars(outside).select("key", "pointer", "json").unionByName(empty)), "chunk-parts")
    places = parts.select("key", "depth").unionByName(deep(filled).select("key", "depth"))
    deepest = places.agg(F.max("depth")).first()[0] or 0
    at_depth = lambda k: parts.filter(F.col("depth") == k).drop("depth").unionByName(deep(lists).filter(F.col("depth") == k).drop("depth"))
    level = at_depth(deepest)
    for depth in range(deepest, 0, -1):
        last = F.replace(F.replace(F.regexp_extract("pointer", "([^/]*)$", 1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        members = level.select("key", F.regexp_replace("pointer", "/[^/]*$", "").alias("pointer"), F.struct(last.alias("name"), "json").alias("m"))
        made = members.groupBy("key", "pointer").agg(_object(F.sort_array(F.collect_list("m"))).alias("json"))
        made = written(made, "chunk-parts") if depth > 1 else made  # whole events are read lazily
        level = at_depth(depth - 1).unionByName(made)
    whole = level.select("key", "json").unionByName(hollow.join(places.select("key").distinct(), "key", "left_anti").select("key", "json"))
    return whole.select(F.col("key").alias(key), F.col("json").alias(event)), clash.select(F.col("key").alias(key), "pointer", "values")
