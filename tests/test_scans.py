"""Texts are scanned once, and rules are read only where a text has one of their words, with the same matches."""

import random
from decimal import Decimal

from pyspark.sql import functions as F
from sigtrail.operators import assess, locate, rules, similarity
from sigtrail.operators import layouts as L
from sigtrail.plans import relations

SF = "/root/testdata/sf0.001"


def test_clusters_read_the_texts_once(spark):
    """What is still to be read when the clusters are known are tables of facts and classes."""
    for name in ("q_upgma_clusters", "q_tool_jaccard"):
        rest = relations.QUERIES[name](spark, SF).inputFiles()
        assert rest and not [f for f in rest if "documents" in f]


def test_pairs_of_written_classes(spark):
    facts = spark.createDataFrame([(k, f, w) for k in "pqr" for f, w in (("model:a", 2.0), ("vendor:v", 1.0))] + [("s", "vendor:v", 1.0), ("t", "sdk:x", 1.0)], "artifact string, fact string, weight double")
    assert [tuple(r) for r in similarity.jaccard_pairs(facts).collect()] == [("p", "s", 1 / 3, 1)]


RULES = [r for _, pack in rules.GROUPS for r in pack]
PARTS = [
    "Gemini-1.5-Flash-LATEST", "gemini-2.5-flash-lite", "qwen/QWEN2.5-coder-32b-instruct", "Qwen2.5-Coder-32B-Instruct", "GPT_oss:20B", "gptoss20b", "gpt-oss", "GPT-4o.mini", "gpt-3.5", "gpt-3", "api-inference.huggingface.CO",
    "generativelanguage.googleapis.com", "LocalHost:11434", "127.0.0.1:11434", "/API/chat", "/api/generate", "from  OpenAI", "import openai", "openai(", "OPENAI", "google_generativeai", "GenerativeModel(", "from anthropic",
    "Anthropic(", "Ollama", "chat.completions", "chatxcompletions", "Function_Call", "tool_calls", "Claude", "--Dangerously-skip-permissions", "İ", "\u212a", "ß", "é", "x", "\n",
]


def test_every_rule_has_its_matches_with_cues(spark, monkeypatch):
    """Against every rule read in every text, as without cues."""
    draw = random.Random(5)
    texts = [(str(k), draw.choice([" ", "", " . "]).join(draw.choices(PARTS, k=draw.randint(0, 9)))) for k in range(400)] + [(f"one{k}", p) for k, p in enumerate(PARTS)]
    df = spark.createDataFrame([*texts, ("none", None)], "artifact string, text string")
    files = df.selectExpr("artifact", "encode(text, 'UTF-8') AS content")

    def found():
        hits = rules.scan_rules(df).select("artifact", "rule_id", "ordinal", "value").collect()
        return sorted(map(tuple, hits)), sorted(map(tuple, locate.scan_bytes(files).select("artifact", "rule_id", "offset", "value").collect()))

    assert {r[0] for r in RULES} == set(rules.CUES)
    cued = found()
    monkeypatch.setattr(rules, "CUES", {})
    assert cued == found() and all({x[1] for x in hits} == {r[0] for r in RULES} for hits in cued)


def test_rules_without_a_cue_are_read_everywhere(spark, monkeypatch):
    monkeypatch.delitem(rules.CUES, "gpt_oss_20b")
    df = spark.createDataFrame([("a", "gpt-oss-20b"), ("b", "x")], "artifact string, text string")
    assert [(r.artifact, r.rule_id) for r in rules.scan_rules(df).collect()] == [("a", "gpt_oss_20b")]


def test_pointers_at_any_place_of_a_block(spark):
    """Pairs of words at every aligned place of a section, across blocks and at its end, in all widths; one row for each."""
    draw = random.Random(7)
    for w in (4, 8):
        for begin in (0, 3, 8):
            data = bytearray(draw.choice([1, 255]) for _ in range(700))
            places = sorted(draw.sample(range(-(-begin // w) * w, 690 - 2 * w, 2 * w), 12)) + [(700 // w - 2) * w]
            for at in places:
                data[at : at + 2 * w] = (0x400000 + at).to_bytes(w, "little") + draw.choice([32, 700, 32768]).to_bytes(w, "little")
            laid = spark.createDataFrame([("a", bytes(data), w, [(0, Decimal(begin), Decimal(700 - begin), Decimal(4096), False), (1, Decimal(0), Decimal(0), Decimal(0), True)])], f"artifact string, content binary, width int, sections array<{L.SECTION}>")
            number = lambda at, w=w, data=data: int.from_bytes(data[at : at + w], "little")
            want = [("a", at, number(at), number(at + w)) for at in range(-(-begin // w) * w, 701 - 2 * w, w) if 32 <= number(at + w) <= 32768]
            got = sorted((r.artifact, r.descriptor, int(r.address), r.length) for r in L.descriptors(laid).collect())
            assert got == want and len(got) >= 12


def test_a_file_is_read_once_for_its_literals(spark):
    laid = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("cast(doc_id AS string) AS artifact", "cast(text AS binary) AS content", "8 AS width", f"cast(array() AS array<{L.SECTION}>) AS sections")
    assert not [f for f in L.literals(laid).inputFiles() if "documents" in f]


def test_hidden_characters_of_prompts(spark):
    base = "You are an expert. Return only the code, é and \U0001f600, line\r\n\tby line. "
    rows = [(n, base * 4 + c * n) for c in ("\x01", "\x7f", "\ue000", "\u0378", "\n", "\u200b") for n in (0, 2, 40)]
    got = [r.p for r in spark.createDataFrame(rows, "n int, t string").select(assess.natural_prompt(F.col("t")).alias("p")).collect()]
    assert got == [not (n == 40 and c in "\x01\x7f\ue000\u0378") for c in ("\x01", "\x7f", "\ue000", "\u0378", "\n", "\u200b") for n in (0, 2, 40)]
