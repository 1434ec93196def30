"""Queries over readers, parsers and other operators that need Python; SQL can't express most, so tests hold their values."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtrail.functions import python as P
from sigtrail.operators import batches, knowledge, provenance
from sigtrail.plans.planted import planted, with_planted
from sigtrail.sources import readers


def simhash(spark, sf_dir):
    return planted(spark, sf_dir).select("artifact", P.simhash64("text").alias("simhash"))


def redaction(spark, sf_dir):
    return planted(spark, sf_dir).select("artifact", P.redact("text").alias("r")).select("artifact", F.col("r.n").cast("long").alias("n_secrets"), F.sha2("r.text", 256).alias("text_sha256"))


def normalized(spark, sf_dir):
    return planted(spark, sf_dir).select("artifact", F.sha2(P.nfkc("text"), 256).alias("nfkc_sha256"))


def strings(spark, sf_dir):
    rows = planted(spark, sf_dir).select("artifact", F.encode("signal", "UTF-8").alias("content"))
    return readers.strings(rows)


def page_blocks(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return readers.html_blocks(pages).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


_SOURCE = "from openai import OpenAI\nclient = OpenAI()\nPREFIX = 'Sort '\ndef ask(m, t):\n    return client.chat.completions.create(model=m, messages=[{'role': 'user', 'content': PREFIX + t}])\nask('model-%d', 'record %d')\n"


def call_constants(spark, sf_dir):
    source = F.format_string(_SOURCE, F.col("doc_id") % 7, F.col("doc_id"))
    return provenance.reaching_constants(planted(spark, sf_dir).select("artifact", source.alias("text"))).select("artifact", "role", "value")


def token_batches(spark, sf_dir):
    p = planted(spark, sf_dir).select("family", "doc_id", (F.octet_length("text") / 3).cast("long").alias("cost"))
    return batches.budget_batches(p, "family", "doc_id", "cost", 6000).groupBy("family").agg((F.max("batch") + 1).alias("n_batches"))


def comment_directives(spark, sf_dir):
    source = F.concat(F.lit("$a = 1 # "), F.col("signal"), F.lit("\n$b = 'x # no comment'\n<# two\nlines #>\n"))
    rows = planted(spark, sf_dir).select("artifact", P.mask_powershell(source).alias("m"))
    return rows.select("artifact", F.size("m.comments").cast("long").alias("n_comments"), F.length("m.code").cast("long").alias("n_code"), F.trim(F.substring(F.get("m.comments", F.lit(0)), 2, 1000)).alias("first"))


def knowledge_search(spark, sf_dir):
    p = planted(spark, sf_dir)
    samples = p.select(F.col("artifact").alias("sha256"), "family", F.concat(F.lit("file"), F.col("doc_id")).alias("name"))
    reports = p.filter("doc_id % 25 = 0").select(F.concat(F.lit("r"), F.col("doc_id")).alias("report_id"), F.concat(F.lit("Report on "), F.col("family")).alias("title"))
    events = p.filter("doc_id % 40 = 0").select(F.concat(F.lit("e"), F.col("doc_id")).alias("event_id"), F.col("family").alias("event_name"), F.concat(F.lit("r"), F.col("doc_id")).alias("report_id"))
    case_links = p.filter("doc_id % 25 = 0").select(F.col("artifact").alias("sha256"), F.concat(F.lit("r"), F.col("doc_id")).alias("report_id"))
    event_links = p.filter("doc_id % 40 = 1").select(F.concat(F.lit("e"), F.col("doc_id") - 1).alias("event_id"), F.col("artifact").alias("sha256"))
    found = knowledge.search(samples, reports, events, case_links, event_links, "src1")
    return found.select("family", F.size("samples").cast("long").alias("n_samples"), F.size("reports").cast("long").alias("n_reports"), F.size("events").cast("long").alias("n_events"), F.array_join("reasons", ",").alias("reasons"))


def case_states(spark, sf_dir):
    p = planted(spark, sf_dir)
    m = lambda k: F.col("doc_id") % k
    return p.groupBy(knowledge.case_state(m(2), m(3), m(4), m(5) == 0, m(11) == 0).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def windowed_events(spark, sf_dir):
    from sigtrail.streaming.ingest import windowed_counts

    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


QUERIES = {
    "q_simhash_blake2": simhash, "q_redaction": redaction, "q_normalized": normalized, "q_strings": strings, "q_page_blocks": page_blocks, "q_ast_evidence": call_constants,
    "q_token_batches": token_batches, "q_pslex": comment_directives, "q_knowledge_search": knowledge_search, "q_case_states": case_states, "q_windowed_events": windowed_events,
}

ORACLE_SQL = {
    "q_strings": with_planted("SELECT artifact, 'ascii' AS encoding, 0::BIGINT AS \"offset\", signal AS value FROM planted WHERE length(signal) >= 4"),
    "q_ast_evidence": with_planted(
        "SELECT artifact, unnest(['model', 'prompt', 'prompt']) AS role, unnest(['model-' || (doc_id % 7), 'Sort ', 'record ' || doc_id]) AS value FROM planted"
    ),
    "q_pslex": with_planted("SELECT artifact, 2::BIGINT AS n_comments, (9 + length(signal) + 1 + 21 + 1 + 15 + 1)::BIGINT AS n_code, trim(signal) AS first FROM planted"),
    "q_knowledge_search": with_planted(
        """f AS (SELECT DISTINCT family FROM planted WHERE family ILIKE '%src1%'),
n AS (SELECT family, count(*) AS n_samples FROM planted GROUP BY 1), s AS (SELECT family, list_sort(list(DISTINCT r)) AS reasons FROM (
  SELECT family, 'sample' AS r FROM f UNION SELECT family, 'case_report' FROM planted WHERE doc_id % 25 = 0 AND family ILIKE '%src1%'
  UNION SELECT p.family, 'linked_event' FROM planted p JOIN planted e ON e.doc_id = p.doc_id - 1 WHERE p.doc_id % 40 = 1 AND e.family ILIKE '%src1%'
  UNION SELECT family, 'event_name' FROM planted WHERE doc_id % 40 = 0 AND family ILIKE '%src1%') GROUP BY 1),
r AS (SELECT family, count(DISTINCT doc_id) AS n FROM planted WHERE doc_id % 25 = 0 GROUP BY 1),
e AS (SELECT family, count(DISTINCT ev) AS n FROM (SELECT family, doc_id - 1 AS ev FROM planted WHERE doc_id % 40 = 1 UNION SELECT family, doc_id FROM planted WHERE doc_id % 40 = 0) GROUP BY 1)
SELECT family, n_samples, coalesce(r.n, 0) AS n_reports, coalesce(e.n, 0) AS n_events, array_to_string(reasons, ',') AS reasons FROM s JOIN n USING (family) LEFT JOIN r USING (family) LEFT JOIN e USING (family)"""
    ),
    "q_case_states": with_planted(
        """SELECT CASE WHEN doc_id % 11 = 0 THEN 'report_analysis_failed' WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'empty' WHEN doc_id % 3 = 0 THEN 'waiting_for_report' WHEN doc_id % 2 = 0 THEN 'waiting_for_sample'
WHEN doc_id % 5 = 0 THEN 'ready_for_review' WHEN doc_id % 4 > 1 THEN 'event_selection_required' ELSE 'validation_pending' END AS state, count(*) AS n FROM planted GROUP BY 1"""
    ),
    "q_windowed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
