"""Parts of halved texts against plain recursion, and their coverage."""

import random

import pytest
from sigtrail.operators import halving


def halved(pieces, path, budget):
    """path -> texts of the part's runs, by lists of texts."""
    total = sum(map(len, pieces))
    if total <= budget or total < 256:
        return {path: "".join(pieces)}
    middle, size = total // 2, 0
    for i, p in enumerate(pieces):
        if size + len(p) >= middle:
            break
        size += len(p)
    if len(p) > 0.6 * total:
        left, right = [*pieces[:i], p[: middle - size]], [p[middle - size :], *pieces[i + 1 :]]
    else:
        k = i if size and middle - size < size + len(p) - middle else i + 1
        left, right = pieces[:k], pieces[k:]
    n = min(500, len("".join(left)) // 8, len("".join(right)) // 8)
    more = (left + [right[0][:n]], [left[-1][-n:], *right]) if n else (left, right)
    return halved(more[0], path + "L", budget) | halved(more[1], path + "R", budget)


@pytest.mark.parametrize("budget", [100, 900])
def test_parts_against_plain_recursion(spark, budget):
    draw = random.Random(budget)
    word = lambda n: "".join(draw.choice("abcdefé ") for _ in range(n))
    texts = {k: [word(draw.choice([0, 1, 30, 200, 1500])) for _ in range(draw.randint(1, 12))] for k in range(25)}
    texts |= {90: [word(9000)], 91: [""], 92: ["", word(900), ""], 93: [word(10)] * 300}
    blocks = spark.createDataFrame([(k, n, t or None, "x", 1) for k, v in texts.items() for n, t in enumerate(v)] + [(None, 1, "no", "x", 1), (5, None, "no", "x", 1)], "artifact long, block long, text string, path string, total long")
    halves = halving.halve(blocks, budget)
    got = {}
    for r in halving.part_texts(halves, blocks).collect():
        got.setdefault(r.artifact, {})[r.path] = r.text
        assert r.fits == (len(r.text) <= budget) and (r.fits or len(r.text) < 256) and r.n_chars == len(r.text)
    assert got == {k: halved(v, "", budget) for k, v in texts.items()}
    cover = halving.coverage(halves, blocks).collect()
    assert len(cover) == sum(map(len, texts.values())) and all(r.n_missing == 0 for r in cover)


def test_missing_characters_are_told(spark):
    blocks = spark.createDataFrame([("a", 0, "0123456789"), ("a", 1, "xy")], "artifact string, block long, text string")
    runs = spark.createDataFrame([("a", 0, 1, 4), ("a", 0, 2, 3), ("a", 0, 6, 10)], "artifact string, block long, begin long, end long")
    assert {r.block: r.n_missing for r in halving.coverage(runs, blocks).collect()} == {0: 3, 1: 2}


def test_no_rows(spark):
    blocks = spark.createDataFrame([], "artifact string, block long, text string")
    halves = halving.halve(blocks, 100)
    assert halves.collect() == [] == halving.coverage(halves, blocks).collect()
