"""Aggregates: histograms, growth, quantiles by index, metrics and matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def month_histogram(rows: DataFrame, date: str) -> DataFrame:
    """month, n: rows by YYYY-MM; dates without a month are left out."""
    return rows.filter(F.col(date).rlike("^[0-9]{4}-[0-9]{2}")).groupBy(F.substring(date, 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def growth(rows: DataFrame, date: str, as_of: str) -> DataFrame:
    """current, previous, growth of the month of as_of over the month before; growth is null if there was nothing."""
    month = F.substring(F.col(date), 1, 7)
    at = F.date_format(F.lit(as_of).cast("date"), "yyyy-MM")
    before = F.date_format(F.add_months(F.lit(as_of).cast("date"), -1), "yyyy-MM")
    sums = rows.agg(F.count_if(month == at).alias("current"), F.count_if(month == before).alias("previous"))
    return sums.withColumn("growth", F.when(F.col("previous") > 0, F.round((F.col("current") - F.col("previous")) / F.col("previous"), 6)))


def quantile_by_index(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys, n, q: the value at index floor(n * share) - 1, at least 0, of the sorted values.

    Counts of equal values are combined before the window, so that a group's window holds distinct values only.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(value))
    total = F.sum("c").over(Window.partitionBy(*keys))
    at = F.greatest(F.lit(1).cast("long"), F.floor(total * F.lit(share)))
    ranked = counts.select(*keys, value, "c", upto.alias("upto"), total.alias("n"), at.alias("at"))
    return ranked.filter((F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("c") < F.col("at"))).select(*keys, "n", F.col(value).alias("q"))


def precision_recall(expected: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall of a set against the expected one; null where a denominator is zero."""
    e, d = expected.select(*keys).distinct().withColumn("_e", F.lit(1)), detected.select(*keys).distinct().withColumn("_d", F.lit(1))
    both = e.join(d, keys, "full").agg(
        F.count_if(F.col("_e").isNotNull() & F.col("_d").isNotNull()).alias("tp"), F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_d").isNull()).alias("fn")
    )
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return both.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def evaluation(cases: DataFrame, expected: DataFrame, detected: DataFrame, units: DataFrame) -> DataFrame:
    """One row of metrics of a detector over labelled cases; a rate is null where nothing was counted.

    cases: case, text, expected_role, failed, requests, tokens, latency (null where no source was analysed: not part of averages). expected: case, kind (model, prompt,
    vendor, toolchain, negative), value. detected: case, kind (model, prompt, tool), value, vendor, role, bound. units: case, role.
    Values count once for a case, citations and relations once for a row. Rows of no case don't count. Null values aren't counted.
    """
    want = expected.select("case", "kind", "value").distinct()
    found = detected.join(cases.select("case", "text", "expected_role"), "case")
    vendors = found.filter("vendor is not null").select("case", F.lit("vendor").alias("kind"), F.col("vendor").alias("value"))
    got = found.filter("kind in ('model', 'prompt') and value <> ''").select("case", "kind", "value").unionByName(vendors).distinct()
    both = want.filter("kind in ('model', 'prompt', 'vendor')").withColumn("_w", F.lit(1)).join(got.withColumn("_g", F.lit(1)), ["case", "kind", "value"], "full")
    of = lambda kind, w, g: F.count_if((F.col("kind") == kind) & (F.col("_w").isNotNull() == w) & (F.col("_g").isNotNull() == g))
    sets = both.agg(*(of(k, w, g).alias(f"{k}_{n}") for k in ("model", "prompt", "vendor") for n, w, g in (("tp", True, True), ("fp", False, True), ("fn", True, False))))

    values = got.filter("kind <> 'vendor'").select("case", "value").distinct().withColumn("_g", F.lit(1))
    decoys = want.filter("kind = 'negative'").join(values, ["case", "value"], "left").agg(F.count(F.lit(1)).alias("decoys"), F.count("_g").alias("decoy_hits"))

    right = want.filter("kind in ('model', 'prompt', 'toolchain')").select("case", "value").distinct().withColumn("_r", F.lit(1))
    application = F.col("expected_role") == "application"
    rows = found.join(right, ["case", "value"], "left").agg(
        F.count(F.lit(1)).alias("citations"), F.count_if(F.contains("text", "value")).alias("valid_citations"), F.count_if("bound").alias("relations"), F.count_if(F.col("bound") & F.col("_r").isNotNull()).alias("valid_relations"),
        F.count_if(F.col("kind") == "prompt").alias("prompts"), F.count_if((F.col("kind") == "prompt") & F.col("bound")).alias("bound_prompts"),
        F.count_if(application).alias("app_checks"), F.count_if(application & F.coalesce(F.col("role") != "application", F.lit(True))).alias("app_errors"),
    )
    held = units.select("case", F.col("role").alias("expected_role"), F.lit(1).alias("_u")).distinct()
    runs = cases.join(held, ["case", "expected_role"], "left").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("failed").alias("failures"), F.count("requests").alias("asked"), F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"), F.avg("latency").alias("average_latency"),
        F.count_if(F.col("expected_role").isin("dependency", "example")).alias("unit_checks"), F.count_if(F.col("expected_role").isin("dependency", "example") & F.col("_u").isNull()).alias("unit_errors"),
    )
    counts = None  # one row for each count of each part, as the parts are single rows
    for part in (sets, decoys, rows, runs):
        named = part.select(F.explode(F.array(*(F.struct(F.lit(x).alias("k"), F.col(x).cast("double").alias("v")) for x in part.columns))).alias("x")).select("x.k", "x.v")
        counts = named if counts is None else counts.union(named)
    names = [x for part in (sets, decoys, rows, runs) for x in part.columns]
    one = counts.agg(*(F.sum(F.when(F.col("k") == x, F.col("v"))).alias(x) for x in names))
    c = F.col
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return one.select(
        rate(c("model_tp"), c("model_tp") + c("model_fp")).alias("model_identifier_precision"), rate(c("model_tp"), c("model_tp") + c("model_fn")).alias("model_identifier_recall"),
        rate(c("vendor_fp"), c("vendor_tp") + c("vendor_fp")).alias("model_vendor_false_attribution_rate"),
        rate(c("prompt_tp"), c("prompt_tp") + c("prompt_fp")).alias("prompt_component_precision"), rate(c("prompt_tp"), c("prompt_tp") + c("prompt_fn")).alias("prompt_component_recall"),
        rate(c("bound_prompts"), c("prompts")).alias("prompt_call_binding_precision"), rate(c("decoy_hits"), c("decoys")).alias("decoy_false_positive_rate"),
        rate(c("app_errors") + c("unit_errors"), c("app_checks") + c("unit_checks")).alias("role_error_rate"), rate(c("valid_citations"), c("citations")).alias("citation_validity_rate"),
        rate(c("valid_relations"), c("relations")).alias("relation_verified_precision"), rate(c("failures"), c("cases")).alias("analysis_failure_rate"),
        rate(c("requests"), c("asked")).alias("average_requests"), rate(c("tokens"), c("asked")).alias("average_tokens"), F.round("average_latency", 6).alias("average_latency"),
    )


def inventory(rows: DataFrame, keys: list[str], tests: dict[str, Column]) -> DataFrame:
    """How many rows pass each test, in one pass."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(t).alias(name) for name, t in tests.items()))


def with_totals(rows: DataFrame, key: str, aggregates: list[Column]) -> DataFrame:
    """The aggregates for each key and, with a null key, for all. Rollup is an extension: the reference makes two passes."""
    return rows.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), *aggregates)


def transitions(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """label_from, label_to, n of the rows in both."""
    pairs = old.select(key, F.col(label).alias("label_from")).join(new.select(key, F.col(label).alias("label_to")), key)
    return pairs.groupBy("label_from", "label_to").agg(F.count(F.lit(1)).alias("n"))


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).dictionary_encode(null_encoding="encode")
        sums = np.zeros((len(keys.dictionary), 256), np.int64)
        for code, x in zip(keys.indices.to_numpy(), batch.column(1), strict=True):
            sums[code] += np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256)
        row, value = np.nonzero(sums)
        offsets = pa.array(np.searchsorted(row, np.arange(len(sums) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (value.astype(np.int16), sums[row, value])]
        yield pa.record_batch([keys.dictionary, *lists], names=["key", "b", "c"])


def char_entropy(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, entropy in bits of the bytes of a text, however long.

    Bytes are counted in the worker, by key within a batch: at most 256 counts of a text are shuffled, in one row and once.
    """
    blobs = rows.filter(F.octet_length(text) > 0).select(F.col(key).alias("key"), F.encode(text, "UTF-8").alias("blob"))
    schema = T.StructType([T.StructField("key", blobs.schema["key"].dataType), T.StructField("b", T.ArrayType(T.ShortType())), T.StructField("c", T.ArrayType(T.LongType()))])
    parts = blobs.mapInArrow(_byte_counts, schema).repartition("key")
    counts = parts.select("key", F.inline(F.arrays_zip("b", "c"))).groupBy("key", "b").agg(F.sum("c").alias("c"))
    sums = counts.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return sums.select(F.col("key").alias(key), F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))
