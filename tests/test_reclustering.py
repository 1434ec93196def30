"""Clusters after each batch against clustering everything at once."""

import random

from pyspark.sql import functions as F
from sigtrail.operators import reclustering as R
from sigtrail.operators.similarity import cluster
from sigtrail.streaming.ingest import follow_clusters

FACTS = "artifact string, fact string, weight double"


def at_once(spark, rows):
    """artifact -> set of artifacts in its cluster, by one run over all classes."""
    told = R.classes(spark.createDataFrame(rows, FACTS))
    facts = R._facts_of(told.select("class", "profile"))
    found = cluster(facts.select(F.col("class").alias("artifact")).distinct(), R.class_pairs(facts, facts))
    return grouped(told.join(found.withColumnRenamed("artifact", "class"), "class", "left").select("artifact", "cluster").collect())


def grouped(rows):
    of = {}
    for r in rows:
        if r.cluster is not None:
            of.setdefault(r.cluster, set()).add(r.artifact)
    return sorted(map(sorted, of.values()))


def test_each_batch_equals_all_at_once(spark, tmp_path):
    draw = random.Random(5)
    facts = [(f"{'abcdef'[k % 6]}:{k}", 1.0 + k % 3 / 2) for k in range(24)]

    def sample(name):
        group = draw.randrange(6)
        chosen = {facts[(group * 4 + draw.randrange(5)) % 24] for _ in range(draw.randint(1, 4))}
        return [(name, f, w) for f, w in chosen]

    state, again = {}, []
    for batch in range(3):
        names = [f"s{batch}-{n}" for n in range(25)] + (draw.sample(sorted(state), 10) if state else [])
        new = {n: sample(n) for n in names}
        if batch == 2:
            new["s0-0"] = [("s0-0", None, None)]
        state.update(new)
        rows = [r for v in new.values() for r in v]
        again.append(R.add_batch(spark.createDataFrame(rows + rows[:3] + [(None, "a:0", 1.0)], FACTS), str(tmp_path), batch))
        got = R.current_clusters(spark, str(tmp_path)).collect()
        assert grouped(got) == at_once(spark, [r for v in state.values() for r in v])
        assert len(got) == len(state)
    sizes = {r.cluster: r.size for r in got}
    assert all(sizes[r.cluster] == len([x for x in got if x.cluster == r.cluster]) for r in got if r.cluster)
    last = sorted(map(str, got))
    R.add_batch(spark.createDataFrame(rows, FACTS), str(tmp_path), 2)  # the last batch once more
    assert sorted(map(str, R.current_clusters(spark, str(tmp_path)).collect())) == last


def test_untouched_components_stay_and_empty_batches(spark, tmp_path):
    folder = str(tmp_path)
    assert R.add_batch(spark.createDataFrame([], FACTS), folder, 0) == 0
    assert R.current_clusters(spark, folder).collect() == []
    far = [(f"x{n}", f"far:{n // 2}", 1.0) for n in range(20)]
    assert R.add_batch(spark.createDataFrame(far, FACTS), folder, 1) == 10
    assert R.add_batch(spark.createDataFrame([("y", "far:3", 1.0), ("z", "far:99", 1.0)], FACTS), folder, 2) == 1  # y has a known class
    assert R.add_batch(spark.createDataFrame([("x0", "far:0", 1.0), ("x0", "far:1", 1.0)], FACTS), folder, 3) == 1


def test_stream_of_evidence(spark, tmp_path):
    landing, folder, done = (str(tmp_path / n) for n in ("landing", "folder", "done"))
    schema = "artifact string, kind string, value string"
    for rows in ([("a", "model", "M"), ("b", "model", "m "), ("c", "vendor", "v")], [("c", "model", "m"), ("d", "vendor", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        follow_clusters(spark, landing, folder, done)
    got = R.current_clusters(spark, folder).collect()
    assert grouped(got) == [["a", "b", "c"]] and {r.artifact for r in got} == {"a", "b", "c", "d"}
