"""Cross-checks of report claims and events against artifacts: links, claim relations, providers, prompts and context.

All are equi-joins on a report's entity keys or on the artifact; what is compared with what is picked by aggregates, so that no
group is collected. The pairs that are compared are those that a link names, never all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.functions import scalars as S
from sigtrail.operators.assess import dashed_model

# How sure a link is, what completes a claim, and texts that are no whole prompt.
CONFIDENCE = {"sha256_exact": 1.0, "family_only": 0.55}
COMPLEMENTING = ["has_ai_role", "has_autonomy_level", "has_ai_work_share", "has_operational_status"]
PARTIAL = ["window_excerpt", "excerpt_only", "description"]


def _contains_either(a: Column, b: Column) -> Column:
    """One holds the other; empty or null ones match nothing (see README, deviations)."""
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def link_samples(entities: DataFrame, samples: DataFrame) -> DataFrame:
    """report, artifact, entity, method, confidence, propagates: the best link of a report to an artifact.

    entities: report, pos, entity, type, name, normalized. samples: artifact (SHA-256), family. An indicator that is the hash
    comes before a malware family of that name; of several the first by pos. Pairs without a link aren't listed: they'd be all.
    Artifacts that are no SHA-256 link with nothing. Null names match nothing.
    """
    low = lambda c: F.lower(S.normalize_space(F.col(c)))
    indicators = entities.filter("type = 'indicator'").select("report", "pos", "entity", F.lit("sha256_exact").alias("method"), F.lower("normalized").alias("key"))
    families = entities.filter("type = 'malware_family'").select("report", "pos", "entity", F.lit("family_only").alias("method"), F.explode(F.array_distinct(F.array(low("name"), low("normalized")))).alias("key"))
    valid = samples.filter(F.lower("artifact").rlike("^[a-f0-9]{64}$")).select("artifact", "family").distinct()
    hashes = valid.select("artifact", F.lit("sha256_exact").alias("method"), F.lower("artifact").alias("key"))
    named = valid.filter("family <> ''").select("artifact", F.lit("family_only"), low("family"))
    pairs = indicators.unionByName(families).join(hashes.union(named).distinct(), ["method", "key"])
    best = pairs.groupBy("report", "artifact").agg(F.min(F.struct((F.col("method") != "sha256_exact").alias("weak"), "pos", "entity", "method")).alias("b"))
    sure = F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), F.col("b.method"))
    return best.select("report", "artifact", "b.entity", "b.method", sure.alias("confidence"), (F.col("b.method") == "sha256_exact").alias("propagates"))


def compare_claims(claims: DataFrame, entities: DataFrame, links: DataFrame, signals: DataFrame) -> DataFrame:
    """report, claim, artifact, relation, path, decision: what an artifact says to the claims of what it is linked with.

    claims: report, claim, subject, predicate, object (an entity or null). signals: artifact, pos, kind (model or provider), path,
    value. A link by family concerns claims of the family, one by hash those of the subjects that have the indicator. Another
    model contradicts only by hash; a provider never contradicts. Null values match nothing.
    """
    family = links.filter("method = 'family_only'").select("report", "artifact", "method", "propagates", F.col("entity").alias("subject"))
    owners = claims.filter("predicate = 'has_indicator'").select("report", F.col("object").alias("entity"), "subject").distinct()
    exact = links.filter("method = 'sha256_exact'").join(owners, ["report", "entity"]).select("report", "artifact", "method", "propagates", "subject")
    asked = claims.filter(F.col("predicate").isin("uses_model", "uses_provider", *COMPLEMENTING))
    about = asked.join(family.unionByName(exact).distinct(), ["report", "subject"])
    names = entities.select("report", F.col("entity").alias("object"), F.coalesce(F.nullif("normalized", F.lit("")), F.col("name")).alias("said"))
    named = about.filter(F.col("predicate").isin("uses_model", "uses_provider")).join(names, ["report", "object"])
    named = named.withColumn("kind", F.when(F.col("predicate") == "uses_model", "model").otherwise("provider"))
    keys = ["report", "claim", "artifact", "method", "propagates", "kind"]
    rows = named.select(*keys, "said").join(signals.select("artifact", "kind", "pos", "path", "value"), ["artifact", "kind"], "left")
    equal = (dashed_model(F.col("value")) == dashed_model(F.col("said"))) & (dashed_model(F.col("said")) != "")
    close = _contains_either(F.lower("value"), F.lower(S.normalize_space(F.col("said"))))
    hit = F.when(F.col("kind") == "model", equal).otherwise(close)
    found = rows.groupBy(*keys).agg(F.min_by("path", F.when(hit, F.col("pos"))).alias("hit"), F.min_by("path", "pos").alias("first"))
    model = F.col("kind") == "model"
    against = model & F.col("first").isNotNull() & (F.col("method") == "sha256_exact")
    relation = F.when(F.col("hit").isNotNull(), "supports").when(against, "contradicts").otherwise("inconclusive")
    path = F.coalesce("hit", F.when(model, F.coalesce("first", F.lit("classification.model_attribution"))).otherwise("features.toolchain.evidence"))
    compared = found.select("report", "claim", "artifact", relation.alias("relation"), path.alias("path"), "propagates")
    more = about.filter(F.col("predicate").isin(COMPLEMENTING)).select("report", "claim", "artifact", F.lit("complements"), F.lit("classification.llm_involvement"), "propagates")
    decision = F.when(F.col("propagates") & (F.col("relation") != "contradicts"), "auto").otherwise("needs_review")
    return compared.union(more).withColumn("decision", decision).drop("propagates")


def compare_providers(report: DataFrame, sample: DataFrame, links: DataFrame) -> DataFrame:
    """event, artifact, provider, relation, sample_value, review: the first row of each provider of an event and each linked artifact.

    report: event, pos, provider. sample: artifact, pos, provider. links: event, artifact, method.
    """
    key = lambda c: S.model_key(F.col(c))
    first = Window.partitionBy("event", key("provider")).orderBy("pos")
    asked = report.filter("provider <> ''").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    rows = asked.join(links, "event").join(sample.select("artifact", F.col("pos").alias("s_pos"), F.col("provider").alias("s_value")), "artifact", "left")
    hit = F.when(_contains_either(key("s_value"), key("provider")), F.col("s_pos"))
    out = rows.groupBy("event", "artifact", "provider", "method").agg(F.min_by("s_value", hit).alias("sample_value"))
    return _reviewed(out, F.when(F.col("sample_value").isNotNull(), "supports").otherwise("inconclusive"), "provider", "sample_value")


def compare_prompts(report: DataFrame, sample: DataFrame, observed: DataFrame, links: DataFrame) -> DataFrame:
    """event, artifact, pos, relation, review: a report's prompts against those of linked artifacts.

    report: event, pos, text_hash, availability, flags (array). sample: artifact, text_hash, completeness, eligible (null counts
    as true). observed: artifact, flags. Equal hashes of whole texts support; a prompt that is only described complements; else
    its flags support if there are some and the artifact has them all.
    """
    whole = ~F.coalesce("completeness", F.lit("legacy_complete_text")).isin(PARTIAL) & F.coalesce("eligible", F.lit(True))
    held = sample.filter(whole & F.col("text_hash").isNotNull()).select("artifact", "text_hash", F.lit(True).alias("_same")).distinct()
    rows = report.join(links, "event").join(held, ["artifact", "text_hash"], "left").join(observed.select("artifact", F.col("flags").alias("_seen")), "artifact", "left")
    none = F.array().cast("array<string>")
    expected, seen = F.coalesce("flags", none), F.coalesce("_seen", none)
    covered = (F.size(expected) > 0) & (F.size(F.array_except(expected, seen)) == 0)
    relation = F.when(F.col("_same"), "supports").when(F.col("availability") == "described_only", "complements").when(covered, "supports").otherwise("inconclusive")
    return _reviewed(rows, relation, "pos")


def complement(facts: DataFrame, links: DataFrame) -> DataFrame:
    """event, artifact, group, name, value, relation, review: what a report adds that an artifact can't show: purposes, styles, context.

    facts: event, group, name, value, n_evidence; those without a value or evidence are left out.
    """
    rows = facts.filter("value <> '' AND n_evidence > 0").join(links, "event")
    return _reviewed(rows, F.lit("complements"), "group", "name", "value")


def _reviewed(rows: DataFrame, relation: Column, *keep: str) -> DataFrame:
    review = F.when((F.col("method") == "sha256_exact") & (F.col("relation") == "supports"), "not_reviewed").otherwise("needs_review")
    return rows.withColumn("relation", relation).withColumn("review", review).select("event", "artifact", *keep, "relation", "review")
