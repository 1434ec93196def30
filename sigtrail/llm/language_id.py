"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier over hashed letter n-grams (lengths 1 to 3) tells
the languages whose codewords have that bit from the others; it is a log-odds classifier, whose counts Spark gathers over all
labelled rows, every language with the same weight. The counts stay a table of languages and buckets: tasks that each hold a
few buckets of all languages fit the bits' weights, so what the driver and the broadcast hold grows with the number of bits, and
every label is learned. Decoding sums a logistic loss over the bits, weighted by how far apart
the two sides of a bit lie in training, and takes the nearest codeword; a small lead over the next one is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrail.llm.common import durable, partitions, small_batches, table, text_of

#: Hash buckets of n-grams: with the number of bits (15 for each doubling of the languages), they bound what the driver and the broadcast hold.
BUCKETS = 1 << 15
#: Languages whose counts a task holds at once, and counts that are fitted in one task, about.
HELD, FITTED = 64, 1_000_000
#: Added to each count, so that no share is 0.
SMOOTH = 0.1
#: Codes of so many languages are the best of 50 random ones; larger ones are taken as they come.
SEARCHED = 2000
#: Up to this many languages a code has every useful split; beyond, seeded bits.
EXHAUSTIVE = 6
AMBIGUOUS = 0.2
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: 0 if it is no letter, else the code point of its lower case."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def features(text: str) -> np.ndarray | None:
    """Buckets of the n-grams of a whole text, with repeats; None without a letter. Runs of other characters are one gap."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not points.any():
        return None
    points = np.concatenate(([np.uint32(0)], points, [np.uint32(0)]))
    points = points[(points != 0) | np.concatenate(([True], points[:-1] != 0))]
    a = points * np.uint32(0x9E3779B1)
    b = a[:-1] * np.uint32(31) + points[1:] * np.uint32(0x85EBCA6B)
    c = b[:-1] * np.uint32(31) + points[2:] * np.uint32(0xC2B2AE35)
    return np.concatenate([((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64) for x in (a[points != 0], b, c)])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1, all different, no bit the same for all."""
    if n <= EXHAUSTIVE:
        sides = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        return np.array([[1 if i in s else -1 for s in sides] for i in range(n)], float).reshape(n, len(sides))
    bits, rng, best = 15 * int(np.ceil(np.log2(n))), np.random.default_rng(seed), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, abs(code.sum(0)) < n]
        if n > SEARCHED:
            if len(np.unique(code, axis=0)) == n:
                return code
            continue
        alike = code @ code.T
        np.fill_diagonal(alike, -bits)
        apart = code.shape[1] - alike.max()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


class Model:
    """Weights of all bits, and decoding."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, levels: np.ndarray) -> None:
        """weights: of each bucket and bit; levels: of each language and bit, its mean weight in training."""
        self.languages, self.code, self.weights = languages, code, weights
        high, low = np.where(code > 0, levels, np.inf).min(0, initial=np.inf), np.where(code < 0, levels, -np.inf).max(0, initial=-np.inf)
        self.middle, self.gap = (high + low) / 2, np.maximum(high - low, 1e-3) / 2
        self.trust = self.gap / self.gap.sum()

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, whether the next language is near."""
        if not self.languages or (found := features(text)) is None:
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        hits = np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(hits)
        margin = np.clip((hits[at] @ self.weights[at] / len(found) - self.middle) / self.gap, -4, 4)
        loss = (np.logaddexp(0, -2 * self.code * margin) * self.trust).sum(1)
        chance = np.exp(-4 * (loss - loss.min()))
        chance /= chance.sum()
        first, second = np.argsort(-chance, kind="stable")[:2]
        return self.languages[first], float(chance[first]), bool(chance[first] - chance[second] < AMBIGUOUS)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition: a row for each language and bucket. Counts of at most HELD languages are held, then passed on."""
    sums: dict[str, np.ndarray] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for lang, hits in sums.items():
            at = np.flatnonzero(hits)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(hits[at])], names=["lang", "bucket", "n"])
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            if (found := features(text.as_py())) is not None:
                if lang not in sums:
                    if len(sums) >= HELD:
                        yield from passed()
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(found, minlength=BUCKETS)
    yield from passed()


def _fit_buckets(shared):
    """The weights of a group's buckets: log odds of the mean share among the languages with a bit and among those without."""

    def run(group: pa.Table) -> pa.Table:
        at, totals, code = shared.value
        buckets, place = np.unique(group.column("bucket").to_numpy(), return_inverse=True)
        who = np.array([at[x] for x in group.column("lang").to_pylist()])
        share = np.tile(SMOOTH / totals, (len(buckets), 1))
        share[place, who] += group.column("n").to_numpy() / totals[who]
        yes, no = (code > 0).astype(float), (code < 0).astype(float)
        weights = np.log(share @ yes / yes.sum(0)) - np.log(share @ no / no.sum(0))
        return pa.table([pa.array(buckets), pa.array(list(weights.astype(np.float32)), pa.list_(pa.float32()))], names=["bucket", "w"])

    return run


def _levels(shared, weights):
    """The mean weights of one language."""

    def run(group: pa.Table) -> pa.Table:
        at, totals, _ = shared.value
        lang = group.column("lang")[0].as_py()
        n = group.column("n").to_numpy() @ weights.value[group.column("bucket").to_numpy()] + SMOOTH * weights.value.sum(0, dtype=float)
        return pa.table([pa.array([lang]), pa.array([n / totals[at[lang]]], pa.list_(pa.float64()))], names=["lang", "levels"])

    return run


def train(labelled: DataFrame) -> Model:
    """labelled: text, lang, both not null. All its rows and labels count.

    The driver gets the labels with their totals, BUCKETS weights for each bit, and a number for each language and bit.
    """
    spark = labelled.sparkSession
    sums = labelled.select("lang", "text").mapInArrow(_bucket_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = durable(sums, "language-counts")
    rows = sorted((r["lang"], r["total"]) for r in sums.groupBy("lang").agg(F.sum("n").alias("total")).collect())
    languages, totals = [x for x, _ in rows], np.array([n for _, n in rows], float) + SMOOTH * BUCKETS
    code = codewords(len(languages)) if len(languages) > 1 else np.zeros((len(languages), 0))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, 0), np.float32), code)
    at = {x: k for k, x in enumerate(languages)}
    shared = spark.sparkContext.broadcast((at, totals, code))
    groups = max(partitions(spark), -(-len(languages) * BUCKETS // FITTED))
    fitted = sums.groupBy(F.pmod("bucket", F.lit(groups)).alias("g")).applyInArrow(_fit_buckets(shared), "bucket long, w array<float>").toArrow()
    yes, no = code > 0, code < 0
    absent = np.log((SMOOTH / totals) @ yes / yes.sum(0)) - np.log((SMOOTH / totals) @ no / no.sum(0))  # of buckets that no text has
    weights = np.tile(absent.astype(np.float32), (BUCKETS, 1))
    weights[fitted.column("bucket").to_numpy()] = fitted.column("w").combine_chunks().flatten().to_numpy().reshape(-1, code.shape[1])
    found = sums.groupBy("lang").applyInArrow(_levels(shared, spark.sparkContext.broadcast(weights)), "lang string, levels array<double>").toArrow()
    levels = np.zeros(code.shape)
    for lang, own in zip(found.column("lang").to_pylist(), found.column("levels").to_pylist(), strict=True):
        levels[at[lang]] = own
    return Model(languages, code, weights, levels)


def _predict(model, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(x.as_py()) for x in batch.column("text")]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            kept = [batch.column(f.name).cast(f.type) for f in schema if f.name not in ("lang_pred", "score", "ambiguous")]
            yield pa.record_batch([*kept, *columns], schema=schema)

    return run


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id isn't held out, and isn't learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify_language(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, and the columns in carry: one row for each row of docs.

    Without a model one is trained on the rows that aren't held out and have an id, a text and a label. Predictions use the
    text only. Texts that are null or have no letter are "und" with score 0, as are all if nothing could be learned. Rows that
    repeat get a row each. Other columns are not read. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    if model is None:
        known = ~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
        model = train(docs.filter(known).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    carried = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry or [])]  # no name clashes with those used here
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), held_out(id_col).alias("held_out"), *carried)
    fields = [base.schema["doc_id"], base.schema["held_out"], *list(base.schema)[3:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    schema = T.StructType(fields)
    out = base.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), to_arrow_schema(schema)), schema)
    return out.withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry or [])})


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
