import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sigtrail.llm import hard_negatives, merkle_manifest, quality_rules

SPACES = " \t\n\x0b\x0c\r"
low = lambda x: (x is not None, x)  # noqa: E731  nulls first


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_paths(digests):
    """The root of a list of digests, and for each the (left, right) siblings of every level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[k : k + 3] for k in range(0, len(digests), 3)]
        for k, path in enumerate(paths):
            run, slot = runs[at[k] // 3], at[k] % 3
            path.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at, digests = [a // 3 for a in at], [sha("".join(r)) for r in runs]
    return digests[0], paths


def brute_manifest(rows):
    """(doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof, folded, verified."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_paths([leaf_of(r) for r in sorted(groups[s], key=lambda r: (low(r[0]), leaf_of(r)))]) for s in order}
    root, upper = tree_paths([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        for r, path in zip(sorted(groups[s], key=lambda r: (low(r[0]), leaf_of(r))), trees[s][1], strict=True):
            whole, h = path + above, leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                h = leaf_of((*r[:4], r[4] and r[4].replace("\n", "")))
            for a, b in whole:
                h = sha(a + h + b)
            out.append((r[0], leaf_of(r), trees[s][0], root, sha("".join(a + b for a, b in whole)), h, h == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, pos long, n long, tree long, path string, tampered string, digest string, _g string"


def manifest_rows(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, "p", "t", "d", "g") for r in rows], SCHEMA)


def manifest(spark, rows):
    fields = merkle_manifest.FIELDS
    damaged = merkle_manifest.leaf_digest(*(F.col(f) for f in fields[:-1]), F.translate("text", "\n", ""))
    made = merkle_manifest.build_manifest(manifest_rows(spark, rows), carry={"tampered": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, damaged)})
    made = made.withColumn("folded", merkle_manifest.fold(F.coalesce("tampered", "leaf")))
    return [tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.siblings(), 256), "folded", F.expr("folded = root")).collect()]


def messy_rows(seed, n):
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "é", "\U0001f600", "￿", *(f"s{k}" for k in range(6))]
    pick = lambda: "big" if rng.random() < 0.5 else rng.choice(sources)
    rows = [(k, pick(), rng.choice([None, "en"]), rng.choice([None, k]), rng.choice([None, "", "x\ny\n" * rng.randint(0, 5), "é\n" * 3000])) for k in range(n)]
    return rows + [(None, "big", None, None, "a\nb"), (None, None, None, None, None), *[rows[0]] * 5, (3, rows[3][1], "en", 9, "other\n"), (-4, "big", "en", 1, "negative\nid")]


@pytest.mark.parametrize("n", [4, 400])
def test_manifest(spark, n):
    rows = messy_rows(n, n)
    order = lambda r: tuple(low(x) for x in r)
    assert sorted(manifest(spark, rows), key=order) == sorted(brute_manifest(rows), key=order)


def test_manifest_of_one_leaf_and_of_equal_rows(spark):
    row = (7, "s", "en", 1, "text")
    (got,) = manifest(spark, [row])
    assert got == (7, leaf_of(row), leaf_of(row), leaf_of(row), sha(""), leaf_of(row), True)
    same = [(8, "s", "en", 1, "equal\ntext")] * 300
    assert Counter(manifest(spark, same)) == Counter(brute_manifest(same))


def test_manifest_empty(spark):
    assert manifest(spark, []) == []


def brute_rules(rows, min_docs, min_share):
    key = lambda x: re.sub("[ \t\n\x0b\x0c\r]+", " ", re.sub("[1-9]", "0", x.translate({c: c + 32 for c in range(65, 91)}))).strip(" ")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = lambda t: [x for x in (t or "").split("\n") if x.strip(SPACES)]
    holders, texts = defaultdict(set), defaultdict(set)
    for _, s, t in rows:
        texts[s].add(t or "")
        for x in lines(t):
            holders[s, key(x)].add(t)
    out = []
    for i, s, t in rows:
        w = words(t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        gone = [x for x in lines(t) if len(holders[s, key(x)]) >= max(min_docs, min_share * len(texts[s]))]
        left = len(w) - sum(len(words(x)) for x in gone)
        failed, depleted = len(w) < 50 or 100 * len(repeated) > 50 * len(w), left < 0.5 * len(w)
        seen = lines(t)
        out.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(seen) - len(set(seen)), len(repeated), failed, len(gone), left, depleted, not failed and not depleted))
    return out


def rule_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é#*", " ", " x", "$%&|<>", "A1", "a2"]
    own = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    menu = ["Home  About\tCONTACT 1%d" % k + " word" * 40 for k in range(3)]
    rows = []
    for k in range(120):
        lines = [own(rng.randint(0, 30)) for _ in range(rng.randint(0, 6))] + [rng.choice(menu) for _ in range(rng.randint(0, 3))]
        rows.append((k, rng.choice(["hot", "hot", "s1", "s2", None]), rng.choice(["\n", "\n\n", "\r\n"]).join(lines)))
    return rows + [(200, "hot", None), (201, "s1", ""), (None, None, None), (None, "hot", menu[0]), (5, "hot", rows[5][2]), (202, "s1", "a b " * 5000), (203, "s2", "same line\n" * 4000), *[(300 + k, "copies", rows[0][2]) for k in range(40)]]


def test_quality_rules(spark):
    rows = rule_rows(1)
    schema = "doc_id long, source string, text string, host string, h string, n long, lines long, rid long, kept boolean"
    got = quality_rules.judge_documents(spark.createDataFrame([(*r, "h", "h", 1, 1, 1, True) for r in rows], schema), min_docs=4, min_share=0.1).collect()
    order = lambda r: tuple(low(x) for x in r)
    expected = brute_rules(rows, 4, 0.1)
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    assert any(r.depleted and not r.base_failed for r in got) and any(r.kept for r in got) and any(r.n_common_lines and r.kept for r in got)
    # Equal texts are one document, so copies alone make no line common.
    assert not any(r.n_common_lines for r in got if r.doc_id is not None and 300 <= r.doc_id < 340)


def test_quality_rules_empty(spark):
    assert quality_rules.judge_documents(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def brute_mining(rows):
    part = [(i, l, [int((256 * float(x)) // 1) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in part:
        if i % 100 == 0:
            others = [(-dot(v, q), j, other) for j, other, q in part if j != i]
            for score, j, _ in sorted((o for o in others if o[2] == label), key=lambda o: o[:2])[:5]:
                hard = sorted((o[:2] for o in others if o[2] != label and 80 * -score <= 100 * -o[0] <= 100 * -score), key=lambda o: o)[:5]
                out += [(i, j, k + 1, n, -score, -s) for k, (s, n) in enumerate(hard)]
    return out


def vectors(seed, n, dim=6):
    rng = random.Random(seed)
    few = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(k, rng.randint(0, 3), rng.choice(few) if rng.random() < 0.4 else [rng.uniform(-1, 1) for _ in range(dim)]) for k in range(n)]
    odd = [(None, 1, few[0]), (n, None, few[0]), (n + 1, 1, None), (n + 2, 1, [None, *few[0][1:]]), (n + 3, 1, [float("nan"), *few[0][1:]]), (n + 4, 1, [float("inf"), *few[0][1:]])]
    return rows + odd + [rows[0], rows[1], (100, 2, few[1]), (n + 5, 1, []), (n + 6, 2, [0.5]), (-100, 0, few[2]), (n + 7, 0, [300.0, *few[0][1:]])]


def mined(spark, rows, **named):
    df = spark.createDataFrame([(*r, 1, 1, "q") for r in rows], "vec_id long, label int, embedding array<float>, id long, rid long, q string")
    return sorted(map(tuple, hard_negatives.mine_hard_negatives(df, F.col("id") % 100 == 0, **named).collect()))


@pytest.mark.parametrize("tile", [4096, 97])
def test_hard_negatives(spark, tile):
    rows = [(i, l, None if v is None else [None if x is None else np.float32(x).item() for x in v]) for i, l, v in vectors(2, 350)]
    got = mined(spark, rows, tile=tile)
    assert got == sorted(brute_mining(rows)) and len(got) > 30


def test_hard_negatives_of_a_very_common_vector(spark):
    rows = [(k, k % 2, [0.5, 0.25]) for k in range(900)] + [(k, k % 3, [0.4, 0.2 + k / 4096]) for k in range(900, 1000)]
    rows = [(i, l, [np.float32(x).item() for x in v]) for i, l, v in rows]
    assert mined(spark, rows, tile=64) == sorted(brute_mining(rows))


def test_hard_negatives_limits(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, 1, [1.0])]) == []
    with pytest.raises(ValueError):
        mined(spark, [(100, 1, [1e30]), (1, 2, [1.0])])
    large = [(0, 1, [3e5, 1.0]), (1, 1, [3e5, 0.0]), (2, 2, [3e5 - 1, 0.5]), (3, 0, [2.5e5, 1.0])]
    assert mined(spark, large) == sorted(brute_mining(large))
