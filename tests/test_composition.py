"""Smallest enclosing spans against a plain search, and compositions of prompts by cases."""

import random

from sigtrail.operators import composition as C

RECORD = "artifact string, record long, role string, call_binding string, text string, text_hash string, line long, end_line long, unit string"
SITE, UNIT = "artifact string, record long, call_line long, callee string", "artifact string, unit string, kind string, start_line long, end_line long"


def test_smallest_enclosing_against_plain_search(spark):
    draw = random.Random(3)
    spans = [(draw.choice("ab"), f"u{i}", s, s + draw.choice([0, 1, 7, 60, 900, 2**33])) for i in range(300) for s in [draw.randint(0, 1000)]]
    spans += [("a", "whole", 0, 2**39), ("a", "turned", 50, 40), ("a", "none", None, 9), ("b", "less", -5, 2000)]
    points = [(draw.choice("abc"), draw.choice([draw.randint(0, 2000), 2**34, None]), n) for n in range(500)] + [("a", 7, 1), ("a", 7, 1)]

    def nearest(key, p):
        around = [(e - s, u) for k, u, s, e in spans if k == key and p is not None and s is not None and 0 <= s <= p <= e]
        return min(around)[1] if around else None

    got = C.smallest_enclosing(spark.createDataFrame(points, "k string, p long, level long"), spark.createDataFrame(spans, "k string, u string, s long, e long"), ["k"], "p", "s", "e", ["u"], "u", "unit").collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(k=k, p=p, level=n, unit=nearest(k, p))).replace("Row(k", "Row(k") for k, p, n in points)


def test_compositions(spark):
    ok = ("application", "relation_verified")
    records = [
        ("a", 1, *ok, "second ", "h2", 5, 6, "x"), ("a", 2, *ok, "first ", "h1", 3, 3, "x"), ("a", 3, "system", "relation_verified", "no", "h", 1, 1, "x"), ("a", 4, "application", "candidate", "no", "h", 1, 1, "x"),
        ("a", 5, *ok, None, None, None, None, "x"), ("a", 6, None, None, "no", "h", 1, 1, "x"), ("b", 1, *ok, "other", "h", 99, 99, "x"),
    ]
    sites = [("a", 1, 12, "create"), ("a", 2, 12, "create"), ("a", 2, 12, None), ("a", 5, 12, "create"), ("a", 3, 12, "create"), ("a", 4, 12, "create"), ("a", 6, 12, "create"), ("a", 1, 99, "create"), ("a", 1, None, "x"), ("b", 1, 2, 'q"\\')]
    units = [("a", "mod", "module_init", 1, 20), ("a", "fun", "function", 1, 20), ("a", "in", "function", 10, 13), ("b", "z", None, 2, 2), ("b", "y", "module_init", 2, 2)]
    make = spark.createDataFrame
    parts = C.prompt_components(make(records, RECORD), make(sites, SITE), make(units, UNIT))
    got = {(r.artifact, r.unit, r.call_line, r.callee): (r.n_components, r.static_reconstruction, r.source_units) for r in C.prompt_compositions(parts).collect()}
    assert got == {("a", "in", 12, "create"): (3, "first second ", ["in", "fun"]), ("a", "in", 12, "unknown"): (1, "first ", ["fun"]), ("b", "z", 2, 'q"\\'): (1, "other", ["z"])}
    import hashlib
    import json

    ids = {(r.unit, r.call_line, r.callee): r.composition_id for r in C.prompt_compositions(parts).collect()}
    assert all(v == "prompt-composition:" + hashlib.sha256(json.dumps(list(k), ensure_ascii=False).encode()).hexdigest()[:20] for k, v in ids.items())
    links = {(r.artifact, r.record): len(r.composition_ids) for r in C.record_links(parts).collect()}
    assert links == {("a", 1): 1, ("a", 2): 2, ("a", 5): 1, ("b", 1): 1}


def test_no_rows(spark):
    make = spark.createDataFrame
    parts = C.prompt_components(make([], RECORD), make([], SITE), make([], UNIT))
    assert C.prompt_compositions(parts).collect() == [] == C.record_links(parts).collect()


def test_points_ask_no_blocks_beyond_the_last_end(spark):
    """Ends at and beside powers of two give what plain search gives, and a point of short keys asks few levels."""
    ends = [0, 1, 2, 3, 4, 7, 8, 15, 16, 1023, 1024, 1 << 35]
    spans = [(f"k{e}", "u", 0, e) for e in ends] + [("two", "big", 0, 64), ("two", "small", 31, 32)]
    points = [(f"k{e}", p) for e in ends for p in (0, e // 2, e, e + 1)] + [("two", p) for p in (30, 31, 32, 33, 64, 65)] + [("none", 1)]
    got = C.smallest_enclosing(spark.createDataFrame(points, "k string, p long"), spark.createDataFrame(spans, "k string, u string, s long, e long"), ["k"], "p", "s", "e", ["u"], "u", "unit")
    near = lambda k, p: min(((e - s, u) for n, u, s, e in spans if n == k and s <= p <= e), default=(0, None))[1]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, p, near(k, p)) for k, p in points), key=str)
    assert "Broadcast" not in got._jdf.queryExecution().toString() and "_last" in got._jdf.queryExecution().toString()
