"""What is written and shuffled: texts go no further than they must, with equal results."""

import random

import pytest
from sigtrail.functions import braces as T
from sigtrail.operators import braces
from test_braces import TEXTS, plain


def kept(monkeypatch, module):
    """{label: table} of what a module writes from now on."""
    tables, write = {}, module.written

    def written(df, label):
        tables[label] = write(df, label)
        return tables[label]

    monkeypatch.setattr(module, "written", written)
    return tables


def test_sources_of_one_slice_are_read_whole(spark, monkeypatch):
    """Slices, tokens and methods are only written of sources that have several slices."""
    tables = kept(monkeypatch, braces)
    long = "".join(f"void m{k}() {{\n  s(\"x{k}\");\n}}\n" for k in range(200))
    df = spark.createDataFrame([*((str(k), f"void m{k}() {{\n  s(\"x{k}\");\n}}\n") for k in range(20)), ("long", long), ("0", "void m0() {\n  s(\"x0\");\n}\n")], "artifact string, text string")
    got = braces.brace_units(df, 1000).collect()
    assert {r.artifact for t in tables.values() for r in t.collect()} == {"long"}
    assert sorted((r.artifact, r.text) for r in got if r.kind == "string") == sorted([*((str(k), f"x{k}") for k in range(20)), *(("long", f"x{k}") for k in range(200))])


def test_units_of_a_whole_text():
    draw = random.Random(1)
    pieces = ["{", "}", '"s"', "\n", "@A(} x) void h() {", "@A(\"q\") void f() {", "\n  int g(int a) {\n", "}\n", "\n", "é", "'", "//", "/*", "*/"]
    for text in [*TEXTS, *("".join(draw.choice(pieces) for _ in range(draw.randint(0, 80))) for _ in range(2000))]:
        rows = list(T.units(text))
        assert sorted(((kind, start, said, name, owner) for kind, name, start, _, _, _, said, owner in rows if kind in ("method", "string")), key=str) == plain(text)
        assert all(n == len(said) and first == text.count("\n", 0, start) + 1 for kind, _, start, first, _, n, said, _ in rows if said is not None)


@pytest.mark.parametrize("size", [1, 40])
def test_both_ways_of_reading_agree(spark, size):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "artifact long, text string")
    rows = lambda s: sorted((tuple(r) for r in braces.brace_units(df, s).collect()), key=str)
    assert rows(size) == rows(100_000)


# --- events of reports ----------------------------------------------------------------------------------------------------

BLOCK = "artifact string, index int, text string, section string, page long"


def test_sections_without_a_shuffle(spark):
    from pyspark.sql import functions as F
    from sigtrail.operators import blocks as B

    draw = random.Random(2)
    texts = [None, "", " \n ", "# a", "x\n# a\ny", *("\n".join(draw.choice(["# a", "# b", "x", " y ", "", "# a\r"]) for _ in range(draw.randint(0, 12))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "artifact long, text string")
    heading = lambda x: x.startswith("# ")
    got = B.sectioned_lines(df, heading)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    expected = B.with_sections(B.line_blocks(df), "artifact", heading(F.col("text"))).select(*got.columns)
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    assert rows(got) == rows(expected) and got.schema["index"].dataType == expected.schema["index"].dataType


def test_words_near_a_token_may_run_over_two_blocks(spark):
    import re

    from sigtrail.operators import discovery as D

    draw = random.Random(3)
    said = ["data", "Miner", "a credential", "stealer b", "the AI", "PROMPT", "ai prompt", "reverse", "shellfish", "x", "", "data\n", "LLMs", "undata", "miners and data", "long " * 9 + "reverse", "shell " + "long " * 9]
    docs = {str(n): [draw.choice(said) for _ in range(draw.randint(0, 3))] + ["TOKENLOCK"] + [draw.choice(said) for _ in range(draw.randint(0, 3))] for n in range(200)}
    rows = [(a, k, t) for a, lines in docs.items() for k, t in [*enumerate(lines), (100, "TOKENLOCK")]]
    got = D._repeated_tokens(spark.createDataFrame(rows, "artifact string, index int, text string"), "artifact")
    around = {a: " ".join(lines[max(0, lines.index("TOKENLOCK") - 2) : lines.index("TOKENLOCK") + 3]) for a, lines in docs.items()}
    assert {r.artifact for r in got.collect()} == {a for a, t in around.items() if re.search(D.NEAR_TOKEN, t)}


def plain_contexts(lines, events, reach=15, before=10):
    """{index: name_key} of one document's blocks (index, text, section, page); events: {name_key: terms in small letters}."""
    names = lambda text: [n for n, terms in events.items() if text is not None and any(t in text.lower() for t in terms)]
    named = {i: set(names(text)) | set(names(section)) for i, text, section, _ in lines}
    out = {}
    if len(events) == 1:
        first, last = min((i for i in named if named[i]), default=None), max((i for i, _, s, _ in lines if s is not None and s.lower() == "summary"), default=None)
        return {i: next(iter(events)) for i, *_ in lines if first is None or (i >= first - before and (last is None or i <= last))}
    for i, text, section, page in lines:
        owners = names(section) or names(text)
        if not owners:
            near = [(abs(i - j), n) for j, _, _, p in lines for n in named[j] if abs(i - j) <= reach and (page is None or page == p)]
            owners = {n for d, n in near if d == min(near)[0]}
        if len(owners) == 1:
            out[i] = next(iter(owners))
    return out


def test_contexts_take_one_shuffle_of_the_texts(spark, monkeypatch):
    from sigtrail.operators import discovery as D

    draw = random.Random(4)
    known = [("alphax", "ALPHAX", ["Omega"]), ("betaxx", "BETAXX two", []), ("gammax", "Gammax", ["Kappa"])]
    docs, candidates = {}, []
    for n in range(60):
        said = ["x", "y", "ALPHAX", "omega", "betaxx", "Gammax and ALPHAX", None, *["z"] * draw.choice([2, 30])]
        pages = draw.random() < 0.5
        docs[str(n)] = [(k, draw.choice(said), draw.choice([None, None, None, "Summary", "on kappa", "ALPHAX"]) if draw.random() < 0.2 else None, k // 9 if pages and draw.random() < 0.9 else None) for k in range(draw.randint(1, 60))]
        candidates += [(str(n), *x) for x in known[: n % 4]]
    df = spark.createDataFrame([(a, *x) for a, lines in docs.items() for x in lines], BLOCK)
    events = spark.createDataFrame(candidates, "artifact string, name_key string, name string, aliases array<string>").selectExpr("*", "array() AS hints")
    tables = kept(monkeypatch, D)
    context = D.contexts(df, events)
    plan = context._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and not tables  # blocks, and the names of a document
    context = D.with_terms(context, events)
    assert context._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3  # the names once more
    got = {a: {} for a in docs}
    for r in context.collect():
        got[r.artifact][r["index"]] = r.name_key
        assert {"alphax": "ALPHAX", "betaxx": "BETAXX two", "gammax": "Gammax"}[r.name_key] == r["name"] and r.event_id
    terms = {n: {t.lower() for t in [name, name.split()[0], *aliases]} for n, name, aliases in known}
    assert got == {a: plain_contexts(lines, {n: terms[n] for n, *_ in known[: int(a) % 4]}) if int(a) % 4 else {} for a, lines in docs.items()}
