"""Clusters kept up to date: a batch of artifacts clusters again only the components that it touches.

Artifacts with the same facts are one class, named by a hash of the facts, and classes are clustered. What is known of a class or of a pair
of classes never changes, so both are append-only logs with a folder for each batch, as are members and clusters, of which the
newest row counts. A batch that is run again overwrites its own folders and reads only those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.operators.similarity import THRESHOLD, cluster, components
from sigtrail.operators.store import latest, written

SCHEMAS = {
    "members": "artifact string, class string",
    "facts": "class string, fact string, weight double, total double",
    "pairs": "a string, b string, score double",
    "clusters": "class string, cluster string, component string",
}


def classes(facts: DataFrame) -> DataFrame:
    """artifact, class, profile: facts (artifact, fact, weight) as one row for each artifact; null facts don't count."""
    one = facts.groupBy("artifact", "fact").agg(F.max("weight").cast("double").alias("weight"))
    listed = one.groupBy("artifact").agg(F.sort_array(F.collect_list(F.when(F.col("fact").isNotNull(), F.struct("fact", "weight")))).alias("profile"))
    return listed.select("artifact", F.when(F.size("profile") > 0, F.sha2(F.to_json("profile"), 256)).alias("class"), "profile")


def _facts_of(rows: DataFrame) -> DataFrame:
    """class, fact, weight, total of rows (class, profile): each class once."""
    total = F.aggregate("profile", F.lit(0.0), lambda s, x: s + x["weight"])
    return rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.first("profile").alias("profile")).select("class", total.alias("total"), F.inline("profile")).select("class", "fact", "weight", "total")


def class_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b (a < b), score: weighted Jaccard of the classes of left with those of right that have a common fact, each pair once."""
    x, y = (df.select(F.col("class").alias(n), "fact", F.col("weight").alias(f"w{n}"), F.col("total").alias(f"t{n}")) for df, n in ((left, "x"), (right, "y")))
    both = x.join(y, "fact").filter("x <> y").groupBy("x", "y", "tx", "ty").agg(F.sum(F.least("wx", "wy")).alias("s"))
    return both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(F.col("s") / (F.col("tx") + F.col("ty") - F.col("s"))).alias("score"))


def _read(spark: SparkSession, folder: str, name: str, before: int | None) -> DataFrame:
    """The log's rows of earlier batches with their number; none if nothing is there."""
    schema = f"{SCHEMAS[name]}, batch long"
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return log if before is None else log.filter(F.col("batch") < before)


def _append(df: DataFrame, folder: str, name: str, batch: int) -> DataFrame:
    path = f"{folder}/{name}/batch={batch}"
    df.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(SCHEMAS[name]).parquet(path)


def add_batch(facts: DataFrame, folder: str, batch: int, threshold: float = THRESHOLD) -> int:
    """Take in the artifacts of a batch (artifact, fact, weight) and return how many classes were clustered again.

    A batch has all facts of its artifacts: they replace earlier ones. An artifact with a null fact alone has none and belongs
    to no cluster. Null artifacts are left out. A class that appears touches its own component and those of its near classes, one that has lost its
    last member the component where it was; everything else stays as it is, so the result is that of clustering all at once.
    Other columns are left out.
    """
    spark = facts.sparkSession
    told = written(classes(facts.filter(F.col("artifact").isNotNull()).select("artifact", "fact", "weight")), "batch")
    before = latest(_read(spark, folder, "members", batch), ["artifact"], [F.col("batch")]).select("artifact", "class")
    after = before.join(told, "artifact", "left_anti").unionByName(told.select("artifact", "class"))
    old, new = (df.filter(F.col("class").isNotNull()).select("class").distinct() for df in (before, after))
    old, new = written(old, "live"), written(new, "live")
    appeared, gone = new.join(old, "class", "left_anti"), old.join(new, "class", "left_anti")
    known = _read(spark, folder, "facts", batch).drop("batch")
    unseen = _append(_facts_of(told.select("class", "profile")).join(known, "class", "left_anti"), folder, "facts", batch)
    made = _append(class_pairs(unseen, known.unionByName(unseen)), folder, "pairs", batch)
    pairs = _read(spark, folder, "pairs", batch).drop("batch").unionByName(made)
    last = latest(_read(spark, folder, "clusters", batch), ["class"], [F.col("batch")]).filter(F.col("cluster").isNotNull()).select("class", "component")

    near = pairs.filter(F.col("score") > 1 - threshold)
    ends = near.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("class"), F.col("a").alias("other")))
    touched = appeared.unionByName(gone).unionByName(ends.join(appeared, "class", "left_semi").select(F.col("other").alias("class"))).distinct()
    whole = last.join(last.join(touched, "class", "left_semi").select("component").distinct(), "component", "left_semi").select("class")
    affected = written(whole.unionByName(appeared).distinct().join(new, "class", "left_semi"), "affected")
    inside = pairs
    for end in ("a", "b"):
        inside = inside.join(affected.select(F.col("class").alias(end)), end, "left_semi")
    inside = written(inside, "inside")
    linked = components(inside.filter(F.col("score") > 1 - threshold).select("a", "b"))
    clustered = cluster(affected.select(F.col("class").alias("artifact")), inside, threshold, linked=linked)
    rows = clustered.select(F.col("artifact").alias("class"), "cluster").join(linked.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    dead = gone.select("class", F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("string").alias("component"))
    _append(rows.unionByName(dead), folder, "clusters", batch)
    _append(told, folder, "members", batch)
    return affected.count()


def current_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """artifact, cluster, size (artifacts of the cluster) after the last batch; null for artifacts without facts."""
    members = latest(_read(spark, folder, "members", None), ["artifact"], [F.col("batch")]).select("artifact", "class")
    last = latest(_read(spark, folder, "clusters", None), ["class"], [F.col("batch")]).select("class", "cluster")
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).join(last, "class").groupBy("cluster").agg(F.sum("n").alias("size"))
    return members.join(last, "class", "left").join(sizes, "cluster", "left").select("artifact", "cluster", "size")
