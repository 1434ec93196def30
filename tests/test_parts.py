"""Halving within rows and by windows give the same parts, and coverage comes with the parts' texts."""

import random

from sigtrail.operators import halving


def test_long_keys_have_the_same_parts_and_coverage(spark):
    draw = random.Random(3)
    texts = {k: ["é" * draw.choice([0, 1, 30, 200, 1500]) for _ in range(draw.randint(1, 9))] for k in range(12)} | {20: ["a" * 9000], 21: [""], 22: ["x"] * 700}
    rows = [(k, n, t or None) for k, v in texts.items() for n, t in enumerate(v)]
    blocks = spark.createDataFrame([*rows, (None, 1, "no"), (5, None, "no")], "artifact long, block long, text string")
    halves = halving.halve(blocks, 300)
    short = sorted(map(tuple, halves.collect()))
    assert short == sorted(map(tuple, halving.halve(blocks, 300, largest=4).select(halves.columns).collect()))
    got = halving.covered_parts(halves, blocks).collect()
    held = {r.artifact: (r.n_first, r.n_chars) for r in got if r.path is None}
    assert held == {k: (len(v), len("".join(v))) for k, v in texts.items()}
    for k, (_, size) in held.items():
        assert sum(r.n_first for r in got if r.artifact == k and r.path is not None) == size
    part = [h for h in halves.collect() if h.path][0]
    fewer = halves.filter(f"NOT (artifact = {part.artifact} AND path = '{part.path}')")
    lost = {(r.artifact, r.block): r.n_missing for r in halving.coverage(fewer, blocks).collect() if r.n_missing}
    told = halving.covered_parts(fewer, blocks).collect()
    assert lost and sum(lost.values()) == held[part.artifact][1] - sum(r.n_first for r in told if r.artifact == part.artifact and r.path is not None)
