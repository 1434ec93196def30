"""Average linkage of large components against clustering one by one, caps over an artifact's texts, and long report tables."""

import random

from sigtrail.operators import knowledge, rules, similarity


def test_large_components_have_the_same_clusters(spark):
    rng = random.Random(11)
    names = [f"n{k:02d}" for k in range(24)]
    pairs = [(a, b, rng.choice([0.5, 0.75, 0.9, rng.random()])) for k, a in enumerate(names) for b in names[k + 1 :] if rng.random() < 0.6]
    nodes = spark.createDataFrame([(x,) for x in [*names, "alone"]], "artifact string")
    scores = spark.createDataFrame(pairs, "a string, b string, score double")
    small = {tuple(r) for r in similarity.cluster(nodes, scores).collect()}
    large = {tuple(r) for r in similarity.cluster(nodes, scores, largest=1).collect()}
    assert small == large and len({r[1] for r in small}) > 3 and max(r[2] for r in small) > 2


def test_cap_holds_for_all_texts_of_an_artifact(spark):
    texts = [("a", 2, "gpt-4o gpt-4o"), ("a", 1, "gpt-4o-mini"), ("b", 1, "gpt-4o"), ("b", 2, None)]
    df = spark.createDataFrame(texts, "artifact string, place int, text string")
    got = [(r.artifact, r.place, r.ordinal) for r in rules.scan_rules(df, cap=2, position="place").filter("rule_id = 'openai_gpt_family'").orderBy("artifact", "place", "ordinal").collect()]
    assert got == [("a", 1, 0), ("a", 2, 0), ("b", 1, 0)]


def test_report_says_what_it_leaves_out(spark):
    text = knowledge.markdown_report(spark.range(1).selectExpr("id AS n"), {"t": spark.range(103)}, "T")
    assert "3 more rows" in text and text.count("| 9") >= 10
