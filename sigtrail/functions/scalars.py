"""Scalar functions as column expressions, evaluated in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as no value, families that a specific model may belong to, generic default ports.
PLACEHOLDERS = ["", "unknown", "none", "null", "n/a", "na", "—", "-"]
GENERIC_FAMILIES = ["gemini", "gpt", "gptoss", "claude", "qwen"]


def normalize_space(x: Column) -> Column:
    """Runs of white space (Unicode) as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def canonical_key(x: Column) -> Column:
    """Letters and digits of any script, in lower case."""
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def model_key(x: Column) -> Column:
    """ASCII letters and digits in lower case, without a "-latest" ending."""
    return F.regexp_replace(F.regexp_replace(F.lower(normalize_space(x)), "-latest$", ""), "[^a-z0-9]", "")


def models_match(sample: Column, report: Column) -> Column:
    """exact_model, family_to_specific or none. Empty keys match nothing (see README, deviations)."""
    s, r = model_key(sample), model_key(report)
    full = (s != "") & (r != "")
    prefix = (r.isin(GENERIC_FAMILIES) & s.startswith(r)) | (s.isin(GENERIC_FAMILIES) & r.startswith(s))
    return F.when(full & (s == r), "exact_model").when(full & prefix, "family_to_specific").otherwise("none")


def meaningful(x: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(x)).isin(PLACEHOLDERS), F.lit(False))


def first_meaningful(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(x != "", x) for x in xs))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix, a colon and 20 hex digits of SHA-256 over the parts joined by the unit separator; null reads "None"."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, 20))


def is_sha256(x: Column) -> Column:
    return F.coalesce(x.rlike("^[a-f0-9]{64}$"), F.lit(False))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def date_by_precision(x: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as found at the start of the text, else null."""
    t = F.trim(x)
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10))
        .when(t.rlike(r"^\d{4}-\d{2}$"), t)
        .when(t.rlike(r"^\d{4}$"), t)
    )


def in_range(x: Column, start: str | None, end: str | None) -> Column:
    """Whether a date of full precision lies in the closed range; a partial date never does."""
    full = x.rlike(r"^\d{4}-\d{2}-\d{2}")
    tests = [full] + ([F.substring(x, 1, 10) >= start] if start else []) + ([F.substring(x, 1, 10) <= end] if end else [])
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if start or end else F.lit(True)


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.octet_length(x) + 2) / 3)).cast("long")


def excerpt(x: Column, start: Column, end: Column, radius: int = 220) -> Column:
    """The text from radius before start to radius after end (both count from 0), trimmed."""
    left = F.greatest(F.lit(0), start - radius)
    return F.trim(F.substring(x, (left + 1).cast("int"), (end + radius - left).cast("int")))


def name_and_alias(x: Column) -> tuple[Column, Column]:
    """A name and the alias in parentheses after it, null without one."""
    alias = F.regexp_extract(x, r"[(（]([^()（）]+)[)）]", 1)
    return F.trim(F.regexp_replace(x, r"[(（].*$", "")), F.when(alias != "", F.trim(alias))


def family_key(x: Column) -> Column:
    """ASCII letters and digits of the name before a parenthesis, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"[(（].*$", ""), "[^A-Za-z0-9]", ""))


def url_host(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/:?#]+)", 1))


def url_normalized(x: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, "/" as the least path."""
    t = F.regexp_replace(F.trim(x), "#.*$", "")
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    port = F.regexp_extract(t, r"^[^/]*//[^/?]*?(:\d+)(?:[/?]|$)", 1)
    default = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    rest = F.regexp_extract(t, r"^[^/]*//[^/?]*(.*)$", 1)
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), url_host(t), F.when(default, "").otherwise(port), path)).otherwise(t)


def endpoint_label(x: Column) -> Column:
    """Host and path of an endpoint, without credentials and query."""
    path = F.regexp_extract(x, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]*([^?#]*)", 1)
    return F.concat(url_host(x), path)


def member_role(path: Column) -> Column:
    """dependency, example, test or application, by the folders of an archive member."""
    folders = F.split(F.lower(path), r"[/\\]")
    has = lambda *names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    return (
        F.when(has("vendor", "node_modules", "site-packages", "dist-packages", "third_party", "lib"), "dependency")
        .when(has("examples", "example", "samples", "docs"), "example")
        .when(has("tests", "test"), "test")
        .otherwise("application")
    )


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two maps of weights; 0 if both are empty."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.lit(0.0)).alias("y"))))
    low = F.aggregate(both, F.lit(0.0), lambda s, v: s + F.least(v["x"], v["y"]))
    high = F.aggregate(both, F.lit(0.0), lambda s, v: s + F.greatest(v["x"], v["y"]))
    return F.when(high > 0, low / high).otherwise(0.0)


def ratio_similarity(a: Column, b: Column) -> Column:
    """Lesser over greater; null if both are zero, as shared absence is no evidence."""
    return F.when((a == 0) & (b == 0), None).otherwise(F.least(a, b) / F.greatest(a, b))
