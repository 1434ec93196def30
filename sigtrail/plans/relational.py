"""Queries over joins, windows, aggregates, blocks and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.functions import scalars as S
from sigtrail.operators import blocks as B
from sigtrail.operators import joins as J
from sigtrail.operators import stats, store
from sigtrail.plans.planted import planted, with_planted


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- dates, histograms, statistics -------------------------------------------------------------------------------------


def month_histogram(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("d"))
    return stats.month_histogram(rows, "d")


def growth(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return stats.growth(rows, "d", "1995-03-15")


def precision_date(spark, sf_dir):
    rows = planted(spark, sf_dir).select("artifact", S.date_by_precision(F.col("event_date")).alias("event_date"))
    return rows.select("artifact", "event_date", S.in_range(F.col("event_date"), "2025-01-01", "2025-12-31").alias("in_range"))


def family_distribution(spark, sf_dir):
    return planted(spark, sf_dir).filter(F.length(F.trim("family")) > 0).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("n_lang"))


def label_distribution(spark, sf_dir):
    docs, labels = planted(spark, sf_dir).select("doc_id"), _t(spark, sf_dir, "labels")
    label = F.coalesce(F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good"), F.lit("unknown"))
    return docs.join(labels, "doc_id", "left").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def overview(spark, sf_dir):
    """The statistics overview: one pass for each table, dates by parameter."""
    p = planted(spark, sf_dir)
    inside = S.in_range(F.col("event_date"), "2025-01-01", None)
    return p.agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("family").alias("families"), F.count_if(inside).alias("dated"),
        F.count_if(F.col("signal") != "").alias("with_signal"), F.countDistinct(S.canonical_key(F.col("text"))).alias("logical"),
    )


def logical_reports(spark, sf_dir):
    rows = planted(spark, sf_dir).withColumn("logical", F.sha2(S.canonical_key(F.split("text", "\n")[0]), 256))
    return rows.groupBy("logical").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_id")).filter("n_copies > 1")


def p95_index(spark, sf_dir):
    return stats.quantile_by_index(_t(spark, sf_dir, "events").select("event_type", F.round("value", 2).alias("value")), ["event_type"], "value", 0.95)


def eval_metrics(spark, sf_dir):
    p = planted(spark, sf_dir)
    expected = p.filter(F.col("doc_id") % 19 < 5).select("artifact")
    detected = p.filter(F.col("text").rlike("(?i)gpt-|gemini-")).select("artifact")
    return stats.precision_recall(expected, detected, ["artifact"])


def inventory(spark, sf_dir):
    p = planted(spark, sf_dir)
    return stats.inventory(p, ["lang"], {"n_model": F.col("text").rlike("gpt-"), "n_prompt": F.col("text").rlike("You are an"), "n_long": F.col("n_chars") > 2000})


def family_totals(spark, sf_dir):
    return stats.with_totals(planted(spark, sf_dir), "lang", [F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("chars")])


def transitions(spark, sf_dir):
    docs = planted(spark, sf_dir)
    old = docs.select("artifact", F.when(F.col("doc_id") % 3 == 0, "confirmed").otherwise("unknown").alias("label"))
    new = docs.select("artifact", F.when(F.col("doc_id") % 4 == 0, "probable").otherwise("unknown").alias("label"))
    return stats.transitions(old, new, "artifact", "label")


def entropy(spark, sf_dir):
    return stats.char_entropy(planted(spark, sf_dir), "artifact", "text")


# --- joins ----------------------------------------------------------------------------------------------------------------


def case_bridge(spark, sf_dir):
    o, c, n = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_cases"), F.countDistinct("c_custkey").alias("n_samples"))


def case_counts(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    orders = _t(spark, sf_dir, "orders")
    n1 = orders.groupBy(F.col("o_custkey").alias("case_id")).agg(F.count(F.lit(1)).alias("n1"))
    n2 = orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count(F.lit(1)).alias("n2"))
    return c.join(n1, "case_id", "left").join(n2, "case_id", "left").select("case_id", F.coalesce("n1", F.lit(0)).alias("n_reports"), F.coalesce("n2", F.lit(0)).alias("n_closed"))


def search_union(spark, sf_dir):
    p = planted(spark, sf_dir)
    direct = p.filter(F.col("text").ilike("%promptflux%")).select("artifact")
    by_label = p.join(_t(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("artifact")
    seeds = J.any_of(p.select("artifact", "family"), "artifact", [direct, by_label])
    families = seeds.groupBy("family").agg(F.count(F.lit(1)).alias("n_seed"))
    return p.join(families, "family").groupBy("family", "n_seed").agg(F.count(F.lit(1)).alias("n_members"))


def unlinked(spark, sf_dir):
    p = planted(spark, sf_dir)
    return p.join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("family").agg(F.count(F.lit(1)).alias("n_unlinked"))


def range_units(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber"), F.col("l_partkey").alias("point"))
    part = _t(spark, sf_dir, "supplier").select(F.lit(1).alias("g"), F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") * 7).alias("lo"), (F.col("s_suppkey") * 7 + 10).alias("hi"))
    found = J.range_join(line.withColumn("g", F.lit(1)), part, "g", "point", "lo", "hi", 16)
    best = J.smallest_span(found, ["l_orderkey", "l_linenumber"], "lo", "hi", "unit")
    return best.groupBy("unit").agg(F.count(F.lit(1)).alias("n_points"))


def hex_intervals(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.lit(1).alias("g"), "p_partkey", F.conv(F.lower(F.hex(F.col("p_partkey") * 16 + 4198400)), 16, 10).cast("long").alias("address"))
    f = _t(spark, sf_dir, "supplier").select(F.lit(1).alias("g"), "s_suppkey", (F.col("s_suppkey") * 256 + 4198400).alias("lo"), (F.col("s_suppkey") * 256 + 4198400 + 79).alias("hi"))
    return J.range_join(p, f, "g", "address", "lo", "hi", 256).select("p_partkey", "s_suppkey")


def unique_calls(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.lit(1).alias("g"), "c_custkey", (F.col("c_custkey") % 500).cast("string").alias("name"))
    s = _t(spark, sf_dir, "supplier").select(F.lit(1).alias("g"), (F.col("s_suppkey") % 60).cast("string").alias("name"), F.col("s_suppkey").alias("target"))
    return J.unique_match(c, s, "g", "name", "target").select("c_custkey", "target")


def selection_cascade(spark, sf_dir):
    p = planted(spark, sf_dir).select("artifact", "family", "doc_id")
    reports = p.select(F.col("artifact").alias("r_hash"), F.col("family").alias("r_family"), F.col("doc_id").alias("event_id")).filter("event_id % 10 = 3")
    exact = p.join(reports, F.col("artifact") == F.col("r_hash")).select("artifact", "event_id")
    one = reports.groupBy("r_family").agg(F.count(F.lit(1)).alias("k"), F.min("event_id").alias("event_id")).filter("k <= 4")
    family = p.join(one, F.col("family") == F.col("r_family")).select("artifact", "event_id")
    return J.by_priority([("sha256_exact", 1.0, exact), ("family_only", 0.55, family)], ["artifact"], "event_id").groupBy("method", "confidence").agg(F.count(F.lit(1)).alias("n"))


def associations(spark, sf_dir):
    e = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100).alias("b"), F.col("o_totalprice").alias("s"))
    both = J.other_end(e, "a", "b").filter("node <> other").groupBy("node", "other").agg(F.max("s").alias("s"))
    from sigtrail.operators.rules import capped

    return capped(both, ["node"], [F.desc("s"), F.col("other")], 3).select("node", "other", "s")


def set_deltas(spark, sf_dir):
    p = planted(spark, sf_dir)
    old = p.filter(F.col("doc_id") % 3 != 0).select("family", "lang")
    new = p.filter(F.col("doc_id") % 4 != 1).select("family", F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("lang")).alias("lang"))
    return J.set_delta(old, new, ["family", "lang"])


def unit_frontier(spark, sf_dir):
    edges = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("src"), (F.col("l_partkey") % 200).alias("dst"))
    start = spark.createDataFrame([(1, 7), (2, 90)], "root int, node long")
    reached = J.frontier(edges, start, 3, 8)
    return reached.groupBy("root", "hop").agg(F.count(F.lit(1)).alias("n"), F.sum("node").alias("total"))


# --- blocks ---------------------------------------------------------------------------------------------------------------


def _blocks(spark, sf_dir):
    return B.line_blocks(planted(spark, sf_dir))


def sections(spark, sf_dir):
    s = B.with_sections(_blocks(spark, sf_dir), "artifact", F.length("text") <= 12)
    return s.groupBy("artifact").agg(F.count(F.lit(1)).alias("n_blocks"), F.count("section").alias("n_in_section"), F.countDistinct("section").alias("n_sections"))


def adjacent_repeats(spark, sf_dir):
    b = _blocks(spark, sf_dir).withColumn("text", F.left("text", F.lit(1)))
    return B.without_adjacent_repeats(b, "artifact").groupBy("artifact").agg(F.count(F.lit(1)).alias("n_kept"))


def _hits(spark, sf_dir):
    return _blocks(spark, sf_dir).filter(F.contains(F.lower("text"), F.lit("the ")) & (F.col("index") % 5 != 1))


def context_clusters(spark, sf_dir):
    return B.hit_clusters(_hits(spark, sf_dir).select("artifact", "index"), "artifact").select("artifact", F.col("cluster").cast("long"), F.col("first").cast("long"), F.col("last").cast("long"), "n")


def cluster_context(spark, sf_dir):
    clusters = B.hit_clusters(_hits(spark, sf_dir).filter("index % 4 = 0").select("artifact", "index"), "artifact")
    return B.cluster_context(clusters, _blocks(spark, sf_dir), "artifact").groupBy("artifact").agg(F.count(F.lit(1)).alias("n_context"))


def neighborhood(spark, sf_dir):
    hits = _blocks(spark, sf_dir).filter("index % 9 = 4").select("artifact", "index")
    return J.neighborhood(hits, _blocks(spark, sf_dir), "artifact", "index", 2).groupBy("artifact").agg(F.count(F.lit(1)).alias("n_near"))


def nearest_anchor(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    event = F.when(F.col("index") % 17 == 3, "e1").when(F.col("index") % 23 == 11, "e2")
    anchors = b.select("artifact", "index", event.alias("event")).filter("event is not null")
    return B.nearest_anchor(b, anchors, "artifact").groupBy("event", F.col("distance").cast("long").alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def evidence_quotes(spark, sf_dir):
    b = _blocks(spark, sf_dir).select("artifact", "index", "text")
    excerpt = F.when(F.col("index") % 3 == 0, F.concat(F.substring("text", 2, 9), F.lit("~"))).otherwise(F.substring("text", 2, 9))
    quotes = b.select("artifact", (F.col("index") + F.when(F.col("index") % 7 == 0, 1000).otherwise(0)).alias("index"), excerpt.alias("excerpt"))
    return B.quote_holds(quotes, b, ["artifact", "index"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- stores -----------------------------------------------------------------------------------------------------------------


def latest_validation(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.round(F.col("value") * 100).cast("long").alias("v"))
    last = store.nth_newest(e, ["user_id", "event_type"], [F.desc("at"), F.desc("event_id")], 1)
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


def upsert_latest(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("name"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return store.latest(e, ["user_id"], [F.col("event_id")], ["name"]).select("user_id", "event_id", "name", "v")


def merge_links(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 4 == 1, F.col("event_id") * 10).alias("sample"))
    return store.merge_links(e, ["user_id", "event_type"], "sample", "event_id").select("user_id", "event_type", "sample", "event_id")


def report_identity(spark, sf_dir):
    r = planted(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content"), S.canonical_key(F.left("text", F.lit(40))).alias("title"), (F.lit(100000) - F.col("doc_id")).alias("created"))
    return store.report_identity(r, "content", "title", "created", "doc_id").select("doc_id", "canon")


def table_fingerprint(spark, sf_dir):
    return store.fingerprint(_t(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


def seed_groups(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", S.url_host(F.col("url")).alias("host"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("page_id")), 1, 5), lambda x: x.cast("string")), ",").alias("first_pages"))


QUERIES = {
    "q_month_histogram": month_histogram, "q_growth": growth, "q_precision_date": precision_date, "q_family_distribution": family_distribution,
    "q_label_distribution": label_distribution, "q_overview": overview, "q_logical_reports": logical_reports, "q_p95_index": p95_index, "q_eval_metrics": eval_metrics,
    "q_inventory": inventory, "q_family_totals": family_totals, "q_transitions": transitions, "q_entropy": entropy, "q_case_bridge": case_bridge, "q_case_counts": case_counts,
    "q_search_union": search_union, "q_unlinked": unlinked, "q_range_units": range_units, "q_hex_intervals": hex_intervals, "q_unique_calls": unique_calls,
    "q_selection_cascade": selection_cascade, "q_associations": associations, "q_set_deltas": set_deltas, "q_unit_frontier": unit_frontier, "q_sections": sections,
    "q_adjacent_dups": adjacent_repeats, "q_context_clusters": context_clusters, "q_cluster_context": cluster_context, "q_neighborhood": neighborhood, "q_nearest_anchor": nearest_anchor,
    "q_evidence_quotes": evidence_quotes, "q_latest_validation": latest_validation, "q_upsert_latest": upsert_latest, "q_merge_links": merge_links, "q_report_identity": report_identity,
    "q_table_fingerprint": table_fingerprint, "q_seed_groups": seed_groups,
}

_LINES = r"""lines AS (SELECT artifact, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS index FROM (
  SELECT artifact, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM planted))"""
_CLUSTERS = """w AS (SELECT artifact, index, CASE WHEN index - lag(index) OVER (PARTITION BY artifact ORDER BY index) > 3 THEN 1 ELSE 0 END AS new FROM hits),
c AS (SELECT artifact, index, sum(new) OVER (PARTITION BY artifact ORDER BY index) AS cluster FROM w),
cl AS (SELECT artifact, cluster, min(index) AS first, max(index) AS last, count(*) AS n FROM c GROUP BY 1, 2)"""

ORACLE_SQL = {
    "q_month_histogram": "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1",
    "q_growth": """WITH s AS (SELECT count(*) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = '1995-03') AS current, count(*) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = '1995-02') AS previous FROM orders)
SELECT current, previous, CASE WHEN previous > 0 THEN round((current - previous)::DOUBLE / previous, 6) END AS growth FROM s""",
    "q_precision_date": with_planted("SELECT artifact, event_date, coalesce(event_date BETWEEN '2025-01-01' AND '2025-12-31' AND length(event_date) = 10, false) AS in_range FROM planted"),
    "q_family_distribution": with_planted("SELECT family, count(*) AS n, count(DISTINCT lang) AS n_lang FROM planted WHERE trim(family) <> '' GROUP BY 1"),
    "q_label_distribution": "SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'unknown' END AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "q_overview": with_planted(
        r"SELECT count(*) AS samples, count(DISTINCT family) AS families, count(*) FILTER (WHERE length(event_date) = 10 AND event_date >= '2025-01-01') AS dated, count(*) FILTER (WHERE signal <> '') AS with_signal, count(DISTINCT lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS logical FROM planted"
    ),
    "q_logical_reports": with_planted(
        r"SELECT sha256(lower(regexp_replace(string_split(text, chr(10))[1], '[^\p{L}\p{N}]', '', 'g'))) AS logical, count(*) AS n_copies, min(doc_id) AS first_id FROM planted GROUP BY 1 HAVING count(*) > 1"
    ),
    "q_p95_index": """WITH r AS (SELECT event_type, round(value, 2) AS q, row_number() OVER (PARTITION BY event_type ORDER BY round(value, 2)) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, n, q FROM r WHERE k = greatest(1, floor(n * 0.95)::BIGINT)""",
    "q_eval_metrics": with_planted(
        """e AS (SELECT artifact FROM planted WHERE doc_id % 19 < 5), d AS (SELECT artifact FROM planted WHERE regexp_matches(text, '(?i)gpt-|gemini-')),
s AS (SELECT count(*) FILTER (WHERE e.artifact IS NOT NULL AND d.artifact IS NOT NULL) AS tp, count(*) FILTER (WHERE e.artifact IS NULL) AS fp, count(*) FILTER (WHERE d.artifact IS NULL) AS fn FROM e FULL JOIN d ON e.artifact = d.artifact)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) END AS recall FROM s"""
    ),
    "q_inventory": with_planted("SELECT lang, count(*) AS n, count(*) FILTER (WHERE contains(text, 'gpt-')) AS n_model, count(*) FILTER (WHERE contains(text, 'You are an')) AS n_prompt, count(*) FILTER (WHERE n_chars > 2000) AS n_long FROM planted GROUP BY 1"),
    "q_family_totals": with_planted("SELECT lang, grouping(lang)::INTEGER AS is_total, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM planted GROUP BY ROLLUP (lang)"),
    "q_transitions": with_planted("SELECT CASE WHEN doc_id % 3 = 0 THEN 'confirmed' ELSE 'unknown' END AS label_from, CASE WHEN doc_id % 4 = 0 THEN 'probable' ELSE 'unknown' END AS label_to, count(*) AS n FROM planted GROUP BY 1, 2"),
    "q_entropy": with_planted(
        """b AS (SELECT artifact, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM planted),
c AS (SELECT artifact, b, count(*) AS c FROM b GROUP BY 1, 2) SELECT artifact, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM c GROUP BY 1"""
    ),
    "q_case_bridge": "SELECT n_name, o_orderstatus, count(*) AS n_cases, count(DISTINCT c_custkey) AS n_samples FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "q_case_counts": "SELECT c_custkey AS case_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_reports, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_closed FROM customer",
    "q_search_union": with_planted(
        "s AS (SELECT family FROM planted WHERE text ILIKE '%promptflux%' OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)), f AS (SELECT family, count(*) AS n_seed FROM s GROUP BY 1) SELECT family, n_seed, count(*) AS n_members FROM planted JOIN f USING (family) GROUP BY 1, 2"
    ),
    "q_unlinked": with_planted("SELECT family, count(*) AS n_unlinked FROM planted WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"),
    "q_range_units": """WITH m AS (SELECT l_orderkey, l_linenumber, s_suppkey AS unit, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY 10, s_suppkey) AS k FROM lineitem JOIN supplier ON l_partkey BETWEEN s_suppkey * 7 AND s_suppkey * 7 + 10)
SELECT unit, count(*) AS n_points FROM m WHERE k = 1 GROUP BY 1""",
    "q_hex_intervals": "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey * 16 BETWEEN s_suppkey * 256 AND s_suppkey * 256 + 79",
    "q_unique_calls": "WITH s AS (SELECT s_suppkey % 60 AS name, min(s_suppkey) AS target FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT c_custkey, target FROM customer LEFT JOIN s ON c_custkey % 500 = name",
    "q_selection_cascade": with_planted(
        """r AS (SELECT * FROM planted WHERE doc_id % 10 = 3), one AS (SELECT family FROM r GROUP BY 1 HAVING count(*) <= 4),
m AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'sha256_exact' WHEN family IN (SELECT family FROM one) THEN 'family_only' END AS method FROM planted)
SELECT method, CASE method WHEN 'sha256_exact' THEN 1.0 ELSE 0.55 END::DOUBLE AS confidence, count(*) AS n FROM m WHERE method IS NOT NULL GROUP BY 1, 2"""
    ),
    "q_associations": """WITH e AS (SELECT o_custkey AS a, o_orderkey % 100 AS b, o_totalprice AS s FROM orders), u AS (SELECT a AS node, b AS other, s FROM e UNION ALL SELECT b, a, s FROM e),
m AS (SELECT node, other, max(s) AS s FROM u WHERE node <> other GROUP BY 1, 2) SELECT node, other, s FROM m QUALIFY row_number() OVER (PARTITION BY node ORDER BY s DESC, other) <= 3""",
    "q_set_deltas": with_planted(
        """o AS (SELECT DISTINCT family, lang FROM planted WHERE doc_id % 3 <> 0), n AS (SELECT DISTINCT family, CASE WHEN doc_id % 50 = 0 THEN 'xx' ELSE lang END AS lang FROM planted WHERE doc_id % 4 <> 1)
SELECT family, lang, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT family, lang, 'missing' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)"""
    ),
    "q_sections": with_planted(
        f"{_LINES}, s AS (SELECT artifact, last_value(CASE WHEN length(text) <= 12 THEN text END IGNORE NULLS) OVER (PARTITION BY artifact ORDER BY index) AS section FROM lines) SELECT artifact, count(*) AS n_blocks, count(section) AS n_in_section, count(DISTINCT section) AS n_sections FROM s GROUP BY 1"
    ),
    "q_adjacent_dups": with_planted(f"{_LINES}, s AS (SELECT artifact, left(text, 1) AS t, lag(left(text, 1)) OVER (PARTITION BY artifact ORDER BY index) AS b FROM lines) SELECT artifact, count(*) AS n_kept FROM s WHERE b IS NULL OR b <> t GROUP BY 1"),
    "q_context_clusters": with_planted(f"{_LINES}, hits AS (SELECT artifact, index FROM lines WHERE contains(lower(text), 'the ') AND index % 5 <> 1), {_CLUSTERS} SELECT artifact, cluster::BIGINT AS cluster, first::BIGINT AS first, last::BIGINT AS last, n FROM cl"),
    "q_cluster_context": with_planted(
        f"{_LINES}, hits AS (SELECT artifact, index FROM lines WHERE contains(lower(text), 'the ') AND index % 5 <> 1 AND index % 4 = 0), {_CLUSTERS} SELECT artifact, count(DISTINCT index) AS n_context FROM lines JOIN cl USING (artifact) WHERE index BETWEEN first - 1 AND last + CASE WHEN n > 1 THEN 3 ELSE 1 END GROUP BY 1"
    ),
    "q_neighborhood": with_planted(f"{_LINES} SELECT a.artifact, count(DISTINCT a.index) AS n_near FROM lines a JOIN lines b ON a.artifact = b.artifact AND b.index % 9 = 4 AND abs(a.index - b.index) <= 2 GROUP BY 1"),
    "q_nearest_anchor": with_planted(
        f"""{_LINES}, a AS (SELECT artifact, index AS pos, CASE WHEN index % 17 = 3 THEN 'e1' ELSE 'e2' END AS event FROM lines WHERE index % 17 = 3 OR index % 23 = 11),
d AS (SELECT l.artifact, l.index, event, min(abs(l.index - pos)) AS distance FROM lines l JOIN a ON l.artifact = a.artifact AND abs(l.index - pos) <= 15 GROUP BY 1, 2, 3),
r AS (SELECT *, min(distance) OVER (PARTITION BY artifact, index) AS least FROM d), u AS (SELECT *, count(*) OVER (PARTITION BY artifact, index) AS k FROM r WHERE distance = least)
SELECT event, distance, count(*) AS n FROM u WHERE k = 1 GROUP BY 1, 2"""
    ),
    "q_evidence_quotes": with_planted(
        f"""{_LINES}, q AS (SELECT artifact, index + CASE WHEN index % 7 = 0 THEN 1000 ELSE 0 END AS index, CASE WHEN index % 3 = 0 THEN substr(text, 2, 9) || '~' ELSE substr(text, 2, 9) END AS excerpt FROM lines)
SELECT CASE WHEN l.text IS NULL THEN 'missing_block' WHEN contains(l.text, excerpt) THEN 'ok' ELSE 'not_in_block' END AS status, count(*) AS n FROM q LEFT JOIN lines l ON q.artifact = l.artifact AND q.index = l.index GROUP BY 1"""
    ),
    "q_latest_validation": """WITH r AS (SELECT event_type, round(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, event_id DESC) AS k FROM events)
SELECT event_type, count(*) AS n, sum(v)::BIGINT AS total FROM r WHERE k = 1 GROUP BY 1""",
    "q_upsert_latest": """SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) FILTER (WHERE event_id % 3 = 0) AS name, max_by(round(value * 100)::BIGINT, event_id) AS v FROM events GROUP BY 1""",
    "q_merge_links": "SELECT user_id, event_type, max(event_id * 10) FILTER (WHERE event_id % 4 = 1) AS sample, max(event_id) AS event_id FROM events GROUP BY 1, 2",
    "q_report_identity": with_planted(
        r"""r AS (SELECT doc_id, sha256(text) AS content, lower(regexp_replace(left(text, 40), '[^\p{L}\p{N}]', '', 'g')) AS title FROM planted),
e AS (SELECT content, max(doc_id) AS ex FROM r GROUP BY 1), l AS (SELECT title, max(doc_id) AS lo FROM r GROUP BY 1)
SELECT doc_id, CASE WHEN ex <> doc_id THEN ex ELSE coalesce(lo, ex, doc_id) END AS canon FROM r JOIN e USING (content) JOIN l USING (title)"""
    ),
    "q_seed_groups": r"SELECT lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host, count(*) AS n_pages, array_to_string(list_sort(list(page_id))[1:5], ',') AS first_pages FROM pages GROUP BY 1",
}
