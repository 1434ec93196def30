"""Values that the operators must give on small inputs."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from sigtrail.functions import python as P
from sigtrail.functions import scalars as S
from sigtrail.operators import batches, blocks, compare, evidence, joins, knowledge, provenance, rules, similarity, stats, store
from sigtrail.operators.language import file_kind
from sigtrail.sources import readers
from sigtrail.streaming import ingest


def one(spark, expression, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expression.alias("v")).first().v


def test_null_is_not_zero(spark):
    df = spark.createDataFrame([(None, None, None), (1.0, None, None), (None, 0.0, 0.0)], "t double, p double, c double")
    got = [tuple(r.f) for r in df.select(similarity.fuse(F.col("t"), F.col("p"), F.col("c")).alias("f")).collect()]
    assert got[0] == (None, 0.0, None)
    assert got[1] == (pytest.approx(0.5), 0.5, pytest.approx(1.0))
    assert got[2] == (0.0, 0.5, 0.0)


def test_fusion_weights(spark):
    f = similarity.fuse(F.lit(0.0), F.lit(1.0), F.lit(1.0), {"toolchain": 0.1, "prompt": 0.1, "code_style": 0.8})
    assert one(spark, f)["overall"] == pytest.approx(0.9)
    assert one(spark, similarity.fuse(F.lit(0.0), F.lit(1.0), F.lit(1.0)))["overall"] == pytest.approx(0.5)


def test_tool_facts_jaccard(spark):
    rows = [("a", "model", "A"), ("a", "vendor", "V"), ("b", "model", "B"), ("b", "vendor", "v "), ("b", "sdk", "none"), ("c", "model", "Z")]
    facts = similarity.tool_facts(spark.createDataFrame(rows, "artifact string, kind string, value string"))
    assert [(r.a, r.b, r.score, r.n_common) for r in similarity.jaccard_pairs(facts).collect()] == [("a", "b", pytest.approx(1 / 5), 1)]


def test_prompt_scores(spark):
    near = similarity.content_score(F.lit(1), F.lit(True), F.lit(False))
    assert one(spark, near) == pytest.approx(0.95 * 15 / 16)
    assert one(spark, similarity.content_score(F.lit(9), F.lit(True), F.lit(False))) == 0
    assert one(spark, similarity.content_score(F.lit(0), F.lit(False), F.lit(True))) == 0
    assert one(spark, similarity.prompt_score(F.lit(None).cast("double"), F.lit(1.0))) == pytest.approx(0.2)


def test_metrics_in_proportion(spark):
    m = lambda k: F.create_map(*(x for name in ("loc", "functions", "names") for x in (F.lit(name), F.lit(float(k)))))
    assert one(spark, similarity.metric_score(m(1), m(10))) == pytest.approx(0.1)
    assert one(spark, similarity.metric_score(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("a"), F.lit(1.0)))) is None


def test_average_linkage_and_components(spark):
    names = list("abcde")
    scores = {("a", "b"): 0.9, ("b", "c"): 0.6, ("a", "c"): 0.5, ("d", "e"): 0.7}
    assert similarity.average_linkage(names, scores) == [0, 0, 2, 3, 3]
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()], "a string, b string, score double")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "artifact string")
    got = {r.artifact: r.label for r in similarity.numbered(similarity.cluster(nodes, pairs)).collect()}
    assert got["a"] == got["b"] == "C001" and got["d"] == got["e"] and got["f"] not in (got["a"], got["d"])
    chain = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101)], "a long, b long")
    for n in (1, 7):
        assert {(r.node, r.component) for r in similarity.components(chain.repartition(n)).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_simhash_bands_lose_no_pair(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    values = {b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 10))) for b in base for _ in range(12)} | {0}
    got = {(r.a, r.b, r.distance) for r in similarity.simhash_pairs(spark.createDataFrame([(v,) for v in values], "simhash long")).collect()}
    assert got == {(a, b, (a ^ b).bit_count()) for a in values for b in values if 0 < a < b and (a ^ b).bit_count() <= 8}


def test_model_matching(spark):
    pairs = {("gemini-1.5-flash", "Gemini 1.5 Flash-latest"): "exact_model", ("gemini-1.5-flash", "Gemini"): "family_to_specific", ("gpt-4", "claude"): "none", ("模型", "gpt-4"): "none"}
    for (a, b), kind in pairs.items():
        assert one(spark, S.models_match(F.lit(a), F.lit(b))) == kind


def test_dates_and_urls(spark):
    for text, date in {"2025": "2025", " 2025-07 ": "2025-07", "2025-07-15T10:00": "2025-07-15", "July": None}.items():
        assert one(spark, S.date_by_precision(F.lit(text))) == date
    assert one(spark, S.in_range(F.lit("2025-01"), "2025-01-01", None)) is False
    assert one(spark, S.url_normalized(F.lit("HTTP://Example.com:80#x"))) == "http://example.com/"
    assert one(spark, S.endpoint_label(F.lit("https://u:p@example.test/v1/chat?key=1"))) == "example.test/v1/chat"


def test_rule_hits_keep_whole_identifiers(spark):
    df = spark.createDataFrame([("a", "x gpt-4o-mini gpt-4-turbo y" + " gpt-4" * 300)], "artifact string, text string")
    got = [r.value for r in rules.scan_rules(df).filter("rule_id = 'openai_gpt_family'").orderBy("ordinal").collect()]
    assert got[:2] == ["gpt-4o-mini", "gpt-4-turbo"] and len(got) == rules.MATCH_CAP


def test_string_offsets(spark):
    data = b"\x00" * 10 + b"xxfoo foo" + b"\x01" + "xxfoo foo".encode("utf-16le")
    got = [(r.encoding, r.offset, r.value) for r in readers.strings(spark.createDataFrame([("a", data)], "artifact string, content binary")).collect()]
    assert got == [("ascii", 10, "xxfoo foo"), ("utf16le", 20, "xxfoo foo")]


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    rows = [("z", packed([("vendor/a.py", b"x"), ("bomb", b"\0" * 1_000_000), ("b.py", b"y" * 10)])), ("n", b"no archive")]
    got = [(r.member, r.status) for r in readers.archive_members(spark.createDataFrame(rows, "artifact string, content binary")).collect()]
    assert got == [("vendor/a.py", "read"), ("bomb", "ratio"), ("b.py", "read")]


def test_bundles(spark):
    body = zlib.compress(b"print(1)")
    name = b"main\0".ljust(16, b"\0")
    toc = struct.pack("!IIIIBc", 18 + len(name), 0, len(body), 8, 1, b"s") + name
    cookie = struct.pack("!8sIIII64s", b"MEI\x0c\x0b\x0a\x0b\x0e", len(body) + len(toc) + 88, len(body), len(toc), 311, b"lib")
    got = readers.carchive_members(spark.createDataFrame([("a", b"stub" + body + toc + cookie)], "artifact string, content binary")).first()
    assert (got.member, bytes(got.data), got.status) == ("main", b"print(1)", "read")


def test_dex_strings(spark):
    values = [b"\x05hello", b"\x02ok"]
    head = bytearray(64)
    head[:4], begin = b"dex\n", 64 + 4 * len(values)
    struct.pack_into("<II", head, 56, len(values), 64)
    offsets = struct.pack("<II", begin, begin + len(values[0]) + 1)
    data = bytes(head) + offsets + values[0] + b"\0" + values[1] + b"\0"
    assert [r.value for r in readers.dex_strings(spark.createDataFrame([("a", data)], "artifact string, content binary")).collect()] == ["hello", "ok"]


def test_magic(spark):
    kinds = {b"MZ\x00\x00": "pe", b"\x7fELF": "elf", b"PK\x03\x04": "zip", b"dex\n": "dex", b"%PDF": "pdf", b"abcd": "unknown", b"": "unknown"}
    df = spark.createDataFrame([(k,) for k in kinds], "c binary")
    assert [r.v for r in df.select(file_kind(F.col("c")).alias("v")).collect()] == list(kinds.values())


def test_pages_as_blocks(spark):
    html = "<html><head><title>T</title></head><body><nav>n</nav><h1>Head</h1><p>one</p><p>one</p><p>two</p><script>x</script></body></html>"
    got = [(r.kind, r.section, r.text) for r in readers.html_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("index").collect()]
    assert got == [("h1", "Head", "Head"), ("p", "Head", "one"), ("p", "Head", "two")]


def test_decompiler_export(spark, tmp_path):
    lines = [
        '{"record_type":"metadata","tool":"t"}', '{"record_type":"function","name":"entry","address":"00401000","body_start":"00401000","body_end":"0040104f","calls":["helper"]}',
        '{"record_type":"function","name":"helper","address":"00401100","body_start":"00401100","body_end":"0040112f","calls":[]}', '{"record_type":"string","address":"00402000","content":"text","references":["00401020"]}',
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    got = {tuple(r) for r in readers.export_edges(readers.decompiler_export(spark, str(tmp_path / "x.jsonl"))).collect()}
    assert got == {("entry", "calls", "helper"), ("entry", "strings", "text")}


SOURCES = {
    "wrapper": "from openai import OpenAI\nc = OpenAI()\ndef three(m, t):\n    return c.chat.completions.create(model=m, messages=[{'role': 'user', 'content': t}])\ndef two(m, t):\n    return three(m, t)\ntwo('private-v2', 'Review this.')\n",
    "joined": "from openai import OpenAI\nc = OpenAI()\nA = 'Sum '\nB = 'this.'\nP = A + B\nc.chat.completions.create(model='dyn-v1', messages=[{'content': P}])\n",
    "decoy": "NOTICE = 'mentions GPT-4 and OpenAI'\ndef show():\n    return NOTICE\n",
    "opaque": "from openai import OpenAI\nc = OpenAI()\nc.chat.completions.create(model=load('x'), messages=[{'content': 'Hi.'}])\n",
    "scopes": "from openai import OpenAI\nc = OpenAI()\nM = 'outer'\ndef f():\n    M = 'inner'\n    c.chat.completions.create(model=M, prompt='p')\n",
    "broken": "def (",
}


def test_call_constants(spark):
    df = spark.createDataFrame(list(SOURCES.items()), "artifact string, text string")
    got = {}
    for r in provenance.reaching_constants(df).collect():
        got.setdefault(r.artifact, set()).add((r.role, r.value))
    assert got == {
        "wrapper": {("model", "private-v2"), ("prompt", "Review this.")}, "joined": {("model", "dyn-v1"), ("prompt", "Sum "), ("prompt", "this.")},
        "opaque": {("prompt", "Hi.")}, "scopes": {("model", "inner"), ("prompt", "p")},
    }


def test_gates(spark):
    df = spark.createDataFrame([(True, "application", None, None), (True, "example", None, None), (None, "application", "relation_verified", "rule"), (None, None, "relation_verified", "llm"), (False, None, "relation_verified", "rule")], "e boolean, r string, s string, m string")
    assert [x.v for x in df.select(evidence.attribution_eligible(*map(F.col, "ersm")).alias("v")).collect()] == [True, False, True, False, False]


def test_chunk_conflicts(spark):
    df = spark.createDataFrame([("p", "a", ["1"]), ("p", "b", ["2"]), ("q", "a", ["1"])], "path string, value string, evidence array<string>")
    assert {(r.path, r.value, r.conflict, tuple(r.evidence)) for r in compare.merge_chunks(df, ["path"]).collect()} == {("p", "unknown", True, ("1", "2")), ("q", "a", False, ("1",))}


def test_flags(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, compare.compare_flags(a("x"), a("x", "y"))) == "supports"
    assert one(spark, compare.compare_flags(a(), a("x"))) == "inconclusive"


def test_batches(spark):
    df = spark.createDataFrame([("a", k, c, s) for k, (c, s) in enumerate([(4, 1), (4, 9), (4, 5), (20, 8), (1, 2)])], "key string, i int, cost long, score int")
    assert [r.batch for r in batches.budget_batches(df, "key", "i", "cost", 8).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    assert sorted(r.i for r in batches.best_within_budget(df, "key", "i", "score", "cost", 9).collect()) == [1, 2, 4]


def test_quantile_index_of_45(spark):
    df = spark.createDataFrame([("g", k) for k in range(1, 46)], "g string, v int")
    assert stats.quantile_by_index(df, ["g"], "v", 0.95).first().q == 42


def test_fingerprint_in_any_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    a, b = (store.fingerprint(df.repartition(n), ["id", "x"]).first() for n in (1, 7))
    assert a == b and a != store.fingerprint(df.withColumn("x", F.lit(1)), ["id", "x"]).first()


def test_swap(spark, tmp_path):
    df, folder = spark.range(3), f"file://{tmp_path}"
    store.swap(df, folder, "t", "a", lambda: "a")
    with pytest.raises(store.StaleInput):
        store.swap(spark.range(9), folder, "t", "a", lambda: "b")
    assert store.current(spark, folder, "t").count() == 3
    store.swap(spark.range(5), folder, "t", "a", lambda: "a")
    assert store.current(spark, folder, "t").count() == 5


def test_upserts_are_idempotent(spark):
    rows = [("a", 1, "n", 1), ("a", 2, None, 2), ("b", 1, None, 3)]
    df = spark.createDataFrame(rows, "k string, at int, name string, v int")
    once = {tuple(r) for r in store.latest(df, ["k"], [F.col("at")], ["name"]).collect()}
    twice = {tuple(r) for r in store.latest(df.unionByName(df), ["k"], [F.col("at")], ["name"]).collect()}
    assert once == twice == {("a", 2, "n", 2), ("b", 1, None, 3)}


def test_frontier(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10)] + [(0, 50), (0, 51)], "src long, dst long")
    got = {(r.node, r.hop) for r in joins.frontier(edges, spark.createDataFrame([(1, 0)], "root int, node long"), 3, 2).collect()}
    assert got == {(0, 0), (1, 1), (50, 1), (2, 2), (3, 3)}


def test_search_and_states(spark):
    assert one(spark, knowledge.case_state(F.lit(1), F.lit(1), F.lit(2), F.lit(False), F.lit(False))) == "event_selection_required"
    assert one(spark, knowledge.case_state(F.lit(0), F.lit(0), F.lit(0), F.lit(False), F.lit(False))) == "empty"
    df = spark.createDataFrame([("x%y",), ("xay",), (None,)], "t string")
    assert df.filter(knowledge.matches(["t"], "X_Y")).count() == 2
    text = knowledge.markdown_report(spark.createDataFrame([(3, None)], "n int, g double"), {"labels": spark.createDataFrame([("a", 1)], "label string, n int")}, "Report")
    assert text.startswith("# Report\n") and "- g: n/a" in text and "| a | 1 |" in text


def test_python_functions(spark):
    df = spark.createDataFrame([('key: api_key = "abcdefgh1234" and sk-abcdefghijkl',), (None,), ("ＡＢ  c",)], "t string")
    r = df.select(P.redact("t").alias("r"), P.nfkc("t").alias("n"), P.simhash64("t").alias("s")).collect()
    assert r[0].r.n == 2 and "abcdefgh1234" not in r[0].r.text and "sk-abc" not in r[0].r.text and r[1].r.text is None
    assert r[2].n == "ab c" and r[1].s is None
    code, comments = P._mask("$a = 'x # y' # one <# two\n<# a <# b #> c #>$b = @\"\n# in\n\"@\n`#`\" $c # end")
    assert comments == ["# one <# two", "<# a <# b #> c #>", "# end"] and "$b" in code and "in" not in code


def test_streaming_ingest(spark, tmp_path):
    landing, log, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "log", "cp"))
    schema = "artifact string, family string, text string, arrived long"
    spark.createDataFrame([("a", "F", "uses gpt-4o here", 1), ("b", "G", "nothing", 1)], schema).write.parquet(landing)
    ingest.ingest(spark, landing, log, checkpoint)
    spark.createDataFrame([("a", None, "uses gpt-4o and gpt-4.1 here", 2)], schema).write.mode("append").parquet(landing)
    ingest.ingest(spark, landing, log, checkpoint)
    ingest.ingest(spark, landing, log, checkpoint)
    got = {(r.artifact, r.family, r.n_evidence) for r in ingest.samples(spark, log).collect()}
    assert got == {("a", "F", 2), ("b", "G", None)}


def test_line_blocks(spark):
    df = spark.createDataFrame([("a", "one\n\n two \r\n"), ("b", None)], "artifact string, text string")
    assert [(r["index"], r.text) for r in blocks.line_blocks(df).orderBy("index").collect()] == [(0, "one"), (1, "two")]


def test_seed_table(spark, tmp_path):
    (tmp_path / "s.csv").write_text('url,hint\nhttp://a,"x;y"\n,\n')
    assert readers.seed_table(spark, str(tmp_path / "s.csv"), ["url", "hint"]).count() == 1
    with pytest.raises(readers.MissingColumns):
        readers.seed_table(spark, str(tmp_path / "s.csv"), ["url", "none"])
