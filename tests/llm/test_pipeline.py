import corpus_pipeline
import test_dedup as brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_000, "12 34", "en", "s", 5), (10_001, None, "en", "s", 0), (None, "a text without an id", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, SF), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            kept = [(i, t) for i, t in kept if t and any(c.isalpha() for c in t)]
        elif name == "exact_copies":
            last = {}
            for i, t in kept:
                last[t] = max([i, last.get(t, i)], key=brute.null_low)
            kept = [(i, t) for i, t in kept if last[t] == i]
        elif name == "near_copies":
            kept = [(i, t) for (i, t), (_, _, c) in zip(kept, brute.brute_components(kept), strict=True) if i == c]
        else:
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = [(i, t) for i, t in kept if any(x in t for x in items)]
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert held and not set(held) & set(kept)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(kept, key=str)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id or -1 for r in ids) == sorted(i or -1 for i, _ in kept)


def test_rows_that_share_an_id_are_judged_apart(spark, tmp_path):
    items = [("i0", "A train leaves the old station at 40 km per hour and meets Anna after 3 hours on the long bridge near the river.")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = lambda k: " ".join(f"word{k}x{j}" for j in range(60))
    clean = [(1, words(1)), (None, words(2)), (3, words(3)), (3, words(4)), (None, words(5))]
    rows = [*clean, (1, items[0][1]), (None, items[0][1] + " More."), (3, words(3) + " end"), (4, words(4)), (None, words(5) + " end"), (6, "12 34"), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, str(tmp_path)), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(1, words(1)), (None, words(2)), (4, words(4))} <= got and not any("train" in t for _, t in got)
    assert sum("word3" in t for _, t in got) == 1 == sum("word5" in t for _, t in got) and len(got) == 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, SF), "test-stage")
    assert docs.count() == 0
