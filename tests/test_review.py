"""Golden cases of quote repair and unit queries."""

import pytest

from sigtrail.operators import review


@pytest.mark.parametrize(
    "quote,text,expected",
    [
        ("a b", "x a b y", "a b"), ("a  b", "x a b y", "a b"), ("a b", "x a\n b y", "a\n b"), ("a c", "x a b y", None), ("a b", "a  b and a\tb", None), ("", "text", None), (None, "text", None), ("a", None, None), ("a.b", "axb", None),
    ],
)
def test_quote_repair(quote, text, expected):
    assert review._repair(quote, text) == expected


def test_unit_queries(spark):
    units = spark.createDataFrame([(f"u{k}", f"content {k}") for k in range(12)], "unit string, content string")
    edges = spark.createDataFrame([("u0", "calls", f"u{k}") for k in range(1, 12)] + [("u5", "strings", "u6")], "src string, kind string, dst string")
    asked = spark.createDataFrame([(1, "calls", "u0"), (2, "callers", "u3"), (3, "delete", "u0"), (4, "strings", "u0"), (5, "definition", "u7"), (6, "neighbors", "u6")], "request int, kind string, unit string")
    got = {}
    for r in review.query_units(asked, units, edges).collect():
        got.setdefault(r.request, []).append((r.unit, r.reason))
    assert len(got[1]) == review.MAX_RESULTS and got[2] == [("u0", None)] and got[3] == [(None, "not_allowed")] and got[4] == [(None, "no_result")]
    assert got[5] == [("u7", None)] and sorted(u for u, _ in got[6]) == ["u0", "u5"]
