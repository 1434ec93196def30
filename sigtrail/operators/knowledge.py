"""Knowledge search, the statistics report and case states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.functions import scalars as S


def matches(columns: list[str], query: str) -> Column:
    """Whether any column has the query, in any case; % and _ in it keep their meaning."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in columns])


def search(samples: DataFrame, reports: DataFrame, events: DataFrame, case_links: DataFrame, event_links: DataFrame, query: str) -> DataFrame:
    """family, samples, reports, events, reasons: what a query finds, grown to whole families.

    samples: sha256, family, name. reports: report_id, title. events: event_id, event_name, report_id. case_links: sha256,
    report_id. event_links: event_id, sha256. Every step is a semi-join on keys; the disjunction of ways in is a union of keys.
    """
    s, r, e = samples.filter(matches(["family", "name", "sha256"], query)), reports.filter(matches(["title"], query)), events.filter(matches(["event_name"], query))
    seeds = [
        s.select("sha256", F.lit("sample").alias("reason")),
        case_links.join(r.select("report_id"), "report_id", "left_semi").select("sha256", F.lit("case_report").alias("reason")),
        event_links.join(e.select("event_id"), "event_id", "left_semi").select("sha256", F.lit("linked_event").alias("reason")),
        samples.withColumn("k", S.family_key(F.col("family"))).join(e.select(S.family_key(F.col("event_name")).alias("k")).distinct(), "k", "left_semi").select("sha256", F.lit("event_name").alias("reason")),
    ]
    found = reduce(DataFrame.unionByName, seeds).distinct()
    keyed = samples.withColumn("k", F.when(S.family_key(F.coalesce("family", F.lit(""))) != "", S.family_key(F.col("family"))).otherwise(F.col("sha256")))
    why = keyed.join(found, "sha256").groupBy("k").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    members = keyed.join(why.select("k"), "k", "left_semi").select("k", "sha256", "family")
    own = members.groupBy("k").agg(F.first("family").alias("family"), F.sort_array(F.collect_set("sha256")).alias("samples"))
    rep = members.join(case_links, "sha256").groupBy("k").agg(F.sort_array(F.collect_set("report_id")).alias("reports"))
    by_link = members.join(event_links, "sha256").select("k", "event_id")
    by_name = events.select(S.family_key(F.col("event_name")).alias("k"), "event_id").join(why.select("k"), "k", "left_semi")
    evs = by_link.unionByName(by_name).groupBy("k").agg(F.sort_array(F.collect_set("event_id")).alias("events"))
    none = F.array().cast("array<string>")
    out = own.join(why, "k").join(rep, "k", "left").join(evs, "k", "left")
    return out.select("family", "samples", F.coalesce("reports", none).alias("reports"), F.coalesce("events", none).alias("events"), "reasons")


def case_state(n_samples: Column, n_reports: Column, n_events: Column, validated: Column, failed: Column) -> Column:
    """The state of an analysis case by what it has."""
    return (
        F.when(failed, "report_analysis_failed")
        .when((n_samples == 0) & (n_reports == 0), "empty")
        .when(n_reports == 0, "waiting_for_report")
        .when(n_samples == 0, "waiting_for_sample")
        .when(validated, "ready_for_review")
        .when(n_events > 1, "event_selection_required")
        .otherwise("validation_pending")
    )


def markdown_report(overview: DataFrame, tables: dict[str, DataFrame], title: str) -> str:
    """The statistics as Markdown text. overview has one row, and each table is a distribution; of more than 100 rows the
    first 100 are shown, and the number of the others."""
    row = overview.first().asDict()
    lines = [f"# {title}", "", *(f"- {k}: {'n/a' if v is None else v}" for k, v in row.items())]
    for name, df in tables.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        rows = df.limit(101).collect()
        lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows[:100]]
        if len(rows) > 100:
            lines += ["", f"{df.count() - 100} more rows"]
    return "\n".join(lines) + "\n"
