import json
import random

from sigtrail.operators import pointers as P


def walk(node, at=""):
    yield at, node
    parts = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
    for k, v in parts:
        yield from walk(v, f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}")


def made(rng, depth):
    kind = rng.choice("olsnbz" if depth else "snbz")
    if kind == "o":
        x = {rng.choice(["a", "b/c", "d~e", "", "pos", "key", "v"]) + str(k): made(rng, depth - 1) for k in range(rng.randint(0, 4))}
        return x | ({"evidence_ids": rng.choice([[], ["v1"], ["v1", "v2"]])} if rng.random() < 0.5 else {})
    return {"l": lambda: [made(rng, depth - 1) for _ in range(rng.randint(0, 4))], "s": lambda: rng.choice(["", "x\n\"y", "é"]), "n": lambda: rng.randint(-9, 9), "b": lambda: rng.random() < 0.5, "z": lambda: None}[kind]()


def test_nodes_of_any_depth(spark):
    rng = random.Random(4)
    docs = {k: made(rng, 6) for k in range(40)} | {99: [[[[[[[[[[[["deep"]]]]]]]]]]]]}
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [(100, "{bad"), (101, None), (102, ""), (103, '{"a":1,"a":2}')]
    df = spark.createDataFrame(rows, "doc int, j string")
    kind = lambda v: {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    text = lambda v: None if isinstance(v, (dict, list)) or v is None else str(v).lower() if isinstance(v, bool) else str(v)
    expected = sorted((k, p, kind(v), text(v) or "", v.get("evidence_ids") if isinstance(v, dict) else None) for k, d in docs.items() for p, v in walk(d))
    got = sorted((r.doc, r.pointer, r.kind, r.value or "", r.evidence_ids) for r in P.nodes(df, "doc", "j").collect())
    assert [x[:4] for x in got] == [x[:4] for x in expected] and {x[:2]: x[4] for x in got} == {x[:2]: x[4] for x in expected}
    facts = {(k, p) for k, d in docs.items() for p, v in walk(d) if isinstance(v, dict) and v.get("evidence_ids")}
    assert {(r.doc, r.pointer) for r in P.fact_objects(df, "doc", "j").collect()} == facts


def test_pointers_and_risk(spark):
    event = {"identity": {"event_type": "unknown"}, "status": {"value": "x"}, "ai_signals": {"toolchain": [{"model": "m", "provider": ""}], "prompts": [{"structural_features": {"a": True, "b": False}, "effectiveness": None}]}, "targets": [{"name": "n", "other": 1}]}
    df = spark.createDataFrame([("e", json.dumps(event))], "artifact string, event string")
    found = P.nodes(df)
    assert {r.pointer for r in P.high_risk(found).collect()} == {"/status/value", "/ai_signals/toolchain/0/model", "/ai_signals/prompts/0/structural_features/a", "/targets/0/name"}
    wanted = spark.createDataFrame([("e", "/targets/0/other"), ("e", "/targets/1")], "artifact string, pointer string")
    assert {(r.pointer, r.value) for r in P.at_pointers(found, wanted).collect()} == {("/targets/0/other", "1"), ("/targets/1", None)}


def test_assessments(spark):
    event = {
        "identity": {"event_name": "n", "evidence_ids": ["a"]}, "status": {"value": "x", "evidence_ids": ["b", "a"]}, "time": {"evidence_ids": []}, "attribution": {"actors": [{"confidence": "medium", "evidence_ids": ["c", "none"]}]},
        "outcomes": [{"evidence_ids": ["none"]}, {"evidence_ids": ["d"]}], "evidence": [{"evidence_id": "a", "excerpt": "no evidence of it"}, {"evidence_id": "b", "excerpt": "it may be"}, {"evidence_id": "c", "excerpt": "they said"}, {"evidence_id": "d", "excerpt": "confirmed"}],
    }
    df = spark.createDataFrame([("e", json.dumps(event))], "artifact string, event string")
    got = {r.field_path: (r.claim_type, r.assertion_status, r.author_confidence, r.evidence_strength) for r in P.assess_fields(df).collect()}
    assert got == {
        "event.identity.event_name": ("negative_evidence", "denied", "not_stated", "strong"), "event.identity.event_type": ("negative_evidence", "denied", "not_stated", "strong"), "event.status": ("author_inference", "possible", "not_stated", "weak"),
        "event.attribution.actors[0]": ("author_assessment", "asserted", "explicit_medium", "moderate"), "event.outcomes[0]": ("direct_observation", "asserted", "not_stated", "unknown"), "event.outcomes[1]": ("direct_observation", "asserted", "not_stated", "confirmed"),
    }


def test_empty(spark):
    none = spark.createDataFrame([], "artifact string, event string")
    assert P.nodes(none).collect() == [] and P.assess_fields(none).collect() == []


def test_every_wording_has_a_cue():
    """A cue is in all that a pattern finds: each alternative, without its optional parts, holds one."""
    import re

    assert set(P.CUES) == set(P.WORDINGS)
    for name, pattern in P.WORDINGS.items():
        plain = pattern.removeprefix("(?i)").replace(r"\b(?:", "").replace(r")\b", "")
        plain = re.sub(r"\((?:\?:)?[^()]*\)\??|\[[^\]]*\]\?|\w\?", "", plain).replace(r"\b", "")
        for said in plain.split("|"):
            assert any(c in said.lower() for c in P.CUES[name]), (name, said)


def test_texts_are_judged_once_each(spark):
    """Fields that share excerpts share one reading of them; several excerpts are read as one text, also across their border."""
    rows = [("a", [0], "It MAY be, Confirmed"), ("b", [0], ""), ("c", [0, 1], "there was no|evidence of it"), ("d", [1], None), ("e", [0], "Maybe the mayor")]
    excerpts = [(k, n, x) for k, ns, t in rows for n, x in zip(ns, t.split("|") if t is not None else [None])]
    make = spark.createDataFrame
    got = {r.k: {n for n, v in r.says.asDict().items() if v} for r in P._wording(make([(k, ns) for k, ns, _ in rows], "k string, ns array<long>"), make(excerpts, "k string, n long, value string"), "k").collect()}
    assert got == {"a": {"filled", "possible", "confirmed"}, "b": set(), "c": {"filled", "negative"}, "d": set(), "e": {"filled"}}


def test_a_text_is_written_once(spark):
    """Each level was a table of its own that held the whole text again."""
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    rng = random.Random(5)
    texts = [rng.randbytes(100_000).hex() for _ in range(4)]
    df = spark.createDataFrame([(k, json.dumps({"evidence": [{"excerpt": t}]})) for k, t in enumerate(texts)], "artifact int, event string").repartition(1)
    before = size()
    found = P.nodes(df, texts=False)
    assert size() - before < 1.5 * sum(map(len, texts))
    assert {r.artifact: r.value for r in found.filter("name = 'excerpt'").collect()} == dict(enumerate(texts))
