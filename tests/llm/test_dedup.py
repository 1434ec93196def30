import hashlib
import random
import re
from collections import defaultdict

import pytest
from sigtrail.llm import exact_dedup, jaccard_join, line_dedup

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def null_low(i):
    return (i is not None, i)


def messy(seed=3):
    rng = random.Random(seed)
    common = ["  A line that is common to many documents, number %d\t" % k for k in range(4)] + ["ÀÉ über a line of more than forty characters ſ"]
    own = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randint(0, 12)))
    texts = []
    for i in range(60):
        lines = [rng.choice([own(), rng.choice(common), rng.choice(common).upper(), "", "short"]) for _ in range(rng.randint(0, 6))]
        texts.append((i, "\n".join(lines)))
    texts += [(100, None), (101, ""), (102, "\n\n"), (None, common[0]), (None, None), (7, texts[7][1]), (7, "another\ntext"), (103, "x" * 100_000), (104, "\n".join(common * 400))]
    return texts


def brute_lines(texts, min_chars=40, min_docs=5):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    holders = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    owner = {k: max(v, key=null_low) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def same(a, b):
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, a), key=order) == sorted(map(tuple, b), key=order)


def test_line_dedup(frame):
    texts = messy()
    same(line_dedup.dedup_lines(frame(texts)).collect(), brute_lines(texts))


def test_line_dedup_in_any_partitioning(frame):
    texts = messy(5)
    same(line_dedup.dedup_lines(frame(texts).repartition(7)).collect(), brute_lines(texts))


def test_line_dedup_empty(empty):
    assert line_dedup.dedup_lines(empty).collect() == []


def test_exact_dedup(frame):
    texts = messy() + [(200 + k, "y" * 9000 + "z" * (k % 3)) for k in range(9)] + [(300, "y" * 9000), (301, "é" * 5000), (302, "é" * 5000)]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    expected = []
    for i, t in texts:
        g = groups[t or ""]
        keep = max(g, key=null_low)
        expected.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    for size in (64, 4096):
        same(exact_dedup.dedup_exact(frame(texts), block_bytes=size).collect(), expected)


def test_exact_dedup_equal_contents_across_partitions(spark, frame):
    texts = [(k, "same text") for k in range(500)] + [(1000 + k, f"own {k}") for k in range(50)]
    got = exact_dedup.dedup_exact(frame(texts).repartition(9)).collect()
    assert {r.keep_id for r in got if r.doc_id < 1000} == {499} and {r.group_size for r in got if r.doc_id < 1000} == {500}
    assert all(r.kept for r in got if r.doc_id >= 1000)


def test_exact_dedup_empty(empty):
    assert exact_dedup.dedup_exact(empty).collect() == []


def shingles(t, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute_components(texts):
    sets = [shingles(t) for _, t in texts]
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        if sets[k] and i is not None:
            least[root(k)].append(i)
    return [(i, len(sets[k]), min(least[root(k)]) if sets[k] and least[root(k)] else i) for k, (i, _) in enumerate(texts)]


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts, i = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 4, 5, 6, 8, 20, 90, 200]))]
        for _ in range(rng.randint(1, 25)):
            copy = [word() if rng.random() < rng.choice([0, 0.005, 0.01, 0.03, 0.06]) else w for w in base]
            if rng.random() < 0.3:
                copy = copy + passage
            texts.append((i, rng.choice([" ", "\n", "\t "]).join(copy)))
            i += 1
    return texts + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (None, "one two"), (5, texts[5][1]), (905, "Ärger É é"), (906, "Ärger é é")]


def test_jaccard_join(frame):
    for seed in (1, 2):
        texts = near_copies(seed)
        same(jaccard_join.shingle_components(frame(texts)).collect(), brute_components(texts))


def test_jaccard_join_in_many_partitions(frame):
    texts = near_copies(4)
    same(jaccard_join.shingle_components(frame(texts).repartition(13)).collect(), brute_components(texts))


def test_jaccard_join_with_small_parts(frame, monkeypatch):
    for name, value in (("PART", 2), ("FREQUENT", 4), ("CROSS", 10), ("BLOCK", 3), ("PIVOTS", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = near_copies(7)
    same(jaccard_join.shingle_components(frame(texts)).collect(), brute_components(texts))


def test_jaccard_join_where_identities_clash(frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ID_BITS", 5)
    texts = near_copies(3)
    same(jaccard_join.shingle_components(frame(texts)).collect(), brute_components(texts))
    monkeypatch.setattr(jaccard_join, "CLASHES", 2)
    with pytest.raises(ValueError, match="too many sets"):
        jaccard_join.shingle_components(frame(texts))


def test_jaccard_join_empty(empty, frame):
    assert jaccard_join.shingle_components(empty).collect() == []
    assert [tuple(r) for r in jaccard_join.shingle_components(frame([(1, None)])).collect()] == [(1, 0, 1)]
