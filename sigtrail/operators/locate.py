"""Rule hits with their places in the file: of extracted strings, of raw bytes, and both as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.operators.rules import GROUPS, MATCH_CAP, has_cue


def places(text: Column, pattern: str, cap: int) -> Column:
    """array of (value, at): the first cap matches and the code points before each; the pieces between matches add up to it."""
    found = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, cap)
    none = F.array().cast("array<struct<value:string,at:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        before = F.when(F.size(done) > 0, last["at"] + F.char_length(last["value"])).otherwise(0)
        return F.concat(done, F.array(F.struct(x["v"].alias("value"), (before + F.char_length(x["p"])).alias("at"))))

    def placed(values: Column) -> Column:
        pairs = F.arrays_zip(values.alias("v"), F.slice(F.split(text, pattern, cap + 1), 1, F.size(values)).alias("p"))
        return F.when(F.size(values) > 0, F.aggregate(pairs, none, step)).otherwise(none)

    return F.element_at(F.transform(F.array(found), placed), 1)  # so that the matches are found once, not wherever they are spoken of


def _hits(rows: DataFrame, keep: list[str], text: str, cap: int) -> DataFrame:
    """keep, type, rule_id, confidence, value, at. Rules are constant patterns, read where a text has their cue; only rows with a match are expanded."""
    rows = rows.withColumn("_low", F.lower(text))
    found = F.array(*(
        F.struct(F.lit(kind).alias("type"), F.lit(rule[0]).alias("rule_id"), F.lit(rule[-1]).alias("confidence"), F.when(has_cue(F.col("_low"), rule[0]) & F.col(text).rlike(rule[1]), places(F.col(text), rule[1], cap)).alias("places"))
        for kind, rules in GROUPS for rule in rules
    ))
    rows = rows.select(*keep, F.explode(F.filter(found, lambda r: F.size(r["places"]) > 0)).alias("r"))
    return rows.select(*keep, "r.type", "r.rule_id", "r.confidence", F.explode("r.places").alias("x")).select(*keep, "type", "rule_id", "confidence", "x.value", "x.at")


def scan_strings(strings: DataFrame, key: str = "artifact", cap: int = MATCH_CAP) -> DataFrame:
    """key, type, rule_id, confidence, value, source, offset, string_offset, match_char_offset, match_byte_offset, byte_length.

    strings: key, value, encoding (ascii, utf8 or utf16le), offset of the string's first byte. A rule counts up to cap matches of
    an artifact, in order of the strings. Null values have none.
    """
    wide = F.col("encoding") == "utf16le"
    size = lambda x: F.when(wide, F.octet_length(F.encode(x, "UTF-16LE"))).otherwise(F.octet_length(x))
    rows = strings.select(key, F.col("offset").cast("long").alias("string_offset"), "encoding", F.col("value").alias("_text"))
    hits = _hits(rows, [key, "string_offset", "encoding", "_text"], "_text", cap)
    hits = hits.withColumn("match_byte_offset", size(F.substring(F.col("_text"), F.lit(1), F.col("at"))).cast("long")).drop("_text")
    nth = F.row_number().over(Window.partitionBy(key, "type", "rule_id").orderBy("string_offset", "encoding", "at"))
    hits = hits.withColumn("_n", nth).filter(F.col("_n") <= cap)  # a task keeps its first cap rows before the shuffle
    return hits.select(
        key, "type", "rule_id", "confidence", "value", F.concat(F.lit("strings:"), "encoding").alias("source"), (F.col("string_offset") + F.col("match_byte_offset")).alias("offset"), "string_offset",
        F.col("at").cast("long").alias("match_char_offset"), "match_byte_offset", size(F.col("value")).cast("long").alias("byte_length"),
    )


def scan_bytes(files: DataFrame, key: str = "artifact", content: str = "content", cap: int = MATCH_CAP) -> DataFrame:
    """The same columns for matches in the bytes of a file, each byte as one character; source is raw_byte_scan. One row a key."""
    rows = files.select(key, F.decode(F.col(content), "ISO-8859-1").alias("_text"))
    at, none = F.col("at").cast("long"), F.lit(None).cast("long")
    return _hits(rows, [key], "_text", cap).select(
        key, "type", "rule_id", "confidence", "value", F.lit("raw_byte_scan").alias("source"), at.alias("offset"), none.alias("string_offset"), none.alias("match_char_offset"), none.alias("match_byte_offset"),
        F.char_length("value").cast("long").alias("byte_length"),
    )


def merged_evidence(strings: DataFrame, raw: DataFrame, key: str = "artifact") -> DataFrame:
    """Hits of both scans, one row for each type, place and value of an artifact; a string's hit comes before one of raw bytes."""
    both = strings.unionByName(raw)
    order = Window.partitionBy(key, "type", "offset", "value").orderBy(F.col("source") == "raw_byte_scan", "source", "rule_id")
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
