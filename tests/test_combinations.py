"""Texts put together of parts with many values: every combination is found."""

from itertools import product

import pytest
from sigtrail.operators import provenance as P

HEAD = "from openai import OpenAI\nclient = OpenAI()\n"
ASK = "client.chat.completions.create(model=%s, messages=[])\n"


def loops(**counts):
    """Source of loops that give each name its values, and these values."""
    values = {n: [f"{n}{k}" for k in range(count)] for n, count in counts.items()}
    return "".join(f"for {n} in {v!r}:\n    pass\n" for n, v in values.items()), values


def models(spark, sources):
    df = spark.createDataFrame([(k, HEAD + v) for k, v in sources.items()], "artifact string, text string")
    out = {k: [] for k in sources}
    for r in P.call_evidence(df).collect():
        if r.type == "model_argument":
            out[r.artifact].append(r.value)
    return {k: sorted(v) for k, v in out.items()}


def test_no_combination_is_left_out(spark):
    text, v = loops(a=20, b=15, c=3, d=300)
    sources = {
        "sum": text + ASK % "a + '-' + b", "shown": text + ASK % "f'{a}/{b}/{c}!'", "long": text + ASK % "f'<{d}>'", "both": text + "m = f'{d}{c}'\n" + ASK % "f'{m}.{c}'", "few": text + ASK % "f'{c}{c}'",
        "none": text + ASK % "f'{a}{b}{unknown()}'", "number": text + ASK % "a + b + 3", "alone": text + ASK % "f'{d}'",
    }
    assert models(spark, sources) == {k: sorted(x) for k, x in {
        "sum": [f"{a}-{b}" for a, b in product(v["a"], v["b"])], "shown": [f"{a}/{b}/{c}!" for a, b, c in product(v["a"], v["b"], v["c"])], "long": [f"<{d}>" for d in v["d"]],
        "both": [f"{d}{c}.{e}" for d, c, e in product(v["d"], v["c"], v["c"])], "few": [f"{x}{y}" for x, y in product(v["c"], v["c"])], "none": [], "number": [], "alone": v["d"],
    }.items()}


@pytest.mark.parametrize("most", [1, 4])
def test_rows_and_joins_agree(spark, monkeypatch, most):
    """However few combinations a row may hold, the values are the same."""
    text, v = loops(a=3, b=1, c=2, d=5)
    sources = {"x": text + ASK % "f'{a}{b}-{c}{d}{b}'", "y": text + "n = a + c\nn = n + 'z'\nn = c\n" + ASK % "n + d"}
    plain = models(spark, sources)
    assert plain["x"] == sorted("".join([a, b, "-", c, d, b]) for a, b, c, d in product(v["a"], v["b"], v["c"], v["d"])) and len(plain["y"]) == (6 + 2) * 5
    monkeypatch.setattr(P, "ROW_VALUES", most)
    assert models(spark, sources) == plain
