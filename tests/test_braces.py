"""Units of sources with braces: equal at any size of slice, against a plain scan of the whole text."""

import random

import pytest
from sigtrail.functions import braces as T
from sigtrail.operators import braces

JAVA = """package p;
class A {
  @Deprecated public static <T> void one(int a, T b) throws E {
    if (a > 0) { call("x{", '"', "say \\"}\\" now"); } // } {
    /* void not() {
       "neither" } */
    for (;;) { Runnable r = new R() {
      public void inner() { log("in\\\\"); }
    }; }
  }
  void two() { s("over
lines"); s(""); }
  int field = f("outside");
  void open() { s("never closed");
"""


def plain(text):
    """Kind, start, end of methods and of non-empty strings within them, by one pass over the characters of the whole text."""
    state, i, stack, methods, found = None, 0, [], [], []
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if state is None:
            if two in ("//", "/*"):
                state, i = two, i + 1
            elif c in "\"'":
                state, began = c, i + 1
            elif c == "{":
                stack.append(i)
            elif c == "}" and stack:
                a = stack.pop()
                line = text.rfind("\n", 0, a) + 1
                m = T.METHOD.match(text, line)
                if m and m.end() == a + 1 and m["name"] not in T.NOT_METHODS:
                    methods.append((line, i, m["name"]))
        elif state == "//":
            state = None if c == "\n" else state
        elif state == "/*":
            if two == "*/":
                state, i = None, i + 1
        elif c == "\\":
            i += 1
        elif c == state:
            if c == '"' and i > began:
                found.append((began, i))
            state = None
        i += 1
    out = [("method", a, text[a : b + 1], name, None) for a, b, name in methods]
    for a, b in found:
        around = [(y - x, x) for x, y, _ in methods if x <= a <= y]
        if around:
            out.append(("string", a, text[a:b], None, min(around)[1]))
    return sorted(out, key=str)


def made(seed):
    draw = random.Random(seed)
    pieces = ["{", "}", '"', "'", "\\", "/", "*", "//", "/*", "*/", "\n", "a", "é", "  void f() {", "\n  int g(int a) {\n", "}\n", '"s"', "\n", "\n"]
    return "".join(draw.choice(pieces) for _ in range(draw.randint(0, 120)))


TEXTS = [JAVA, *(made(seed) for seed in range(60))]


@pytest.mark.parametrize("size", [1, 40, 100_000])
def test_units_against_plain_scan(spark, size):
    sources = spark.createDataFrame([(n, t, "x", 1) for n, t in enumerate(TEXTS)], "artifact long, text string, kind string, n long")
    got = {n: [] for n in range(len(TEXTS))}
    for r in braces.brace_units(sources, size).collect():
        if r.kind in ("method", "string"):
            got[r.artifact].append((r.kind, r.start, r.text, r.symbol, r.owner))
            assert r.start_line == TEXTS[r.artifact].count("\n", 0, r.start) + 1 and r.n_chars == len(r.text)
            assert r.kind == "string" or r.end_line == r.start_line + r.text.count("\n")
    assert {n: sorted(v, key=str) for n, v in got.items()} == {n: plain(t) for n, t in enumerate(TEXTS)}


def test_a_state_map_is_what_the_slice_does():
    for text in TEXTS:
        for size in (1, 30):
            state = T.CODE
            for _, _, _, part in T.slices(text, size):
                state = T.end_state(part, state)
            assert state == T.end_state(text, T.CODE) and "".join(p for *_, p in T.slices(text, size)) == text


def test_defined_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "artifact string, text string")
    got = braces.brace_units(make([("n", None), ("e", ""), ("c", "int x;\n"), (None, "void f() {}"), ("m", "void f() {}"), ("m", "void f() {}"), ("m", "void g() {}\n")])).collect()
    assert sorted((r.artifact, r.kind, r.symbol or "", r.n_chars, r.end_line) for r in got) == [
        ("c", "class", "", 7, 2), ("e", "class", "", 0, 1), ("m", "class_structure", "", 1, 2), ("m", "method", "f", 11, 1), ("m", "method", "g", 11, 1), ("n", "class", "", 0, 1),
    ]
    assert braces.brace_units(make([])).collect() == []


def test_no_side_is_gathered_on_the_driver(spark):
    """Units of many sources compress well and would pass for a small table, so no join may pick a broadcast by size."""
    from sigtrail.operators.braces import brace_units

    df = spark.createDataFrame([(str(k), f"void m{k}() {{\n  s(\"x{k}\");\n}}\n") for k in range(20)], "artifact string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        got = brace_units(df)
        rows = got.collect()
        assert "Broadcast" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.kind, r.text) for r in rows if r.kind == "string") == sorted(("string", f"x{k}") for k in range(20))


def test_reader_hands_over_tokens_in_parts():
    import pyarrow as pa
    from sigtrail.functions import braces as B

    one = {"artifact": "a", "n": 0, "start": 0, "line": 1, "slice": "{}" * 1500, "state": 0}
    parts = list(B.reader(["artifact"])([pa.RecordBatch.from_pylist([one] * 10)]))
    assert sum(p.num_rows for p in parts) == 30_000 and max(p.num_rows for p in parts) < 8192
