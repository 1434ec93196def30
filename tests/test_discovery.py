import pytest
from sigtrail.operators import discovery as D

SCHEMA = "artifact string, index int, text string, kind string, section string, page long"


def blocks(spark, lines, artifact="a"):
    """Lines as blocks: a line that begins with # is a heading, and opens a section."""
    rows, section = [], None
    for k, x in enumerate(lines):
        kind = "paragraph"
        if x is not None and x.startswith("# "):
            kind, x = "heading", x[2:]
            section = x
        rows.append((artifact, k, x, kind, section, None))
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, lines, **named):
    return {r.name: r for r in D.discover(blocks(spark, lines), **named).collect()}


def test_each_kind_of_mention(spark):
    got = found(spark, [
        "FRUITSHELL Reverse Shell", "abcd is an experimental Dropper", "the actor tracked as TEMP-Zagros", "malware dubbed 'Night-Owl'", "GTG-2002 and GTG-1", None,
        "We track as SILENTFOX a thing reported by them as FoxTail", "Ministry Targeted With Hermes AI Agent", "# LameBug/LAMEBUG9 or MalwareNews and OtherNews", "LLM Dropper", "ABC Dropper",
    ])
    assert {n: (r.hints, r.aliases) for n, r in got.items()} == {
        "FRUITSHELL": (["Reverse Shell"], []), "abcd": (["Dropper"], []), "Night-Owl": ([], []), "GTG-2002": (["campaign"], []), "SILENTFOX": (["malware"], ["FoxTail"]),
        "Hermes intrusion": (["intrusion"], ["Hermes"]), "LAMEBUG9": (["malware"], ["LameBug"]), "MalwareNews": (["malware"], []),
    }


def test_repeated_tokens_need_two_places_and_words_of_malware_nearby(spark):
    far = ["x"] * 5
    assert set(found(spark, ["PROMPTAB", "a data", "miner"])) == set()
    assert set(found(spark, ["PROMPTAB", "data miner", *far, "PROMPTAB"])) == {"PROMPTAB"}
    assert set(found(spark, ["PROMPTAB", *far, "a data miner", *far, "PROMPTAB"])) == set()
    assert set(found(spark, ["PROMPTAB and a data", "miner", *far, "PROMPTAB", "OTHERAB ransomware OTHERAB"])) == {"PROMPTAB"}


def test_aliases_connect_over_several_names(spark):
    got = found(spark, ["Alpha is malware", "ALPHAX Dropper (aka nothing)", "Gamma is malware", "ALPHAX (aka Betaa)", "Betaa (also known as Alpha)", "Deltaa (aka Gamma)", "Betaa (aka ALPHAX)"])
    assert set(got) == {"ALPHAX", "Gamma"} and got["ALPHAX"].aliases == ["Alpha", "Betaa"] and got["Gamma"].aliases == ["Deltaa"]
    assert got["ALPHAX"].first_index == 0 and got["ALPHAX"].n_anchors == 2


def test_documents_keep_their_aliases_apart(spark):
    df = blocks(spark, ["ALPHAX Dropper", "ALPHAX (aka Betaa)"]).unionByName(blocks(spark, ["Betaa is malware", "ALPHAX Dropper"], "b"))
    assert sorted((r.artifact, r.name, tuple(r.aliases)) for r in D.discover(df).collect()) == [("a", "ALPHAX", ("Betaa",)), ("b", "ALPHAX", ()), ("b", "Betaa", ())]


def test_targets_count_only_where_the_text_has_them(spark):
    targets = spark.createDataFrame([("a", " 'Fox.9' ", ["Old-Fox", None], None), ("z", "None", None, None)], "artifact string, name string, aliases array<string>, hint string")
    got = found(spark, ["an xFox.9 here", "Foxy9", "about OLD-FOX, see"], targets=targets)
    assert set(got) == {"Fox.9"} and got["Fox.9"].aliases == ["Old-Fox"] and got["Fox.9"].first_index == 2 and got["Fox.9"].hints == ["target_family"]
    assert found(spark, ["FoxA9"], targets=targets) == {}


def test_empty(spark):
    none = blocks(spark, ["x"]).limit(0)
    assert D.discover(none).collect() == [] and D.contexts(none, D.discover(none)).collect() == []


def context(spark, lines, **pages):
    b = blocks(spark, lines)
    candidates = D.discover(b)
    return D.with_terms(D.contexts(b, candidates), candidates)


def test_blocks_go_to_their_event(spark):
    lines = ["ALPHAX Dropper", "near alpha one", *["x"] * 4, "BETAXX Dropper and ALPHAX", "y", "BETAXX Dropper", "# BETAXX in depth", "by section", "z"]
    got = {r["index"]: r.name_key for r in context(spark, lines).collect()}
    assert got == {0: "alphax", 1: "alphax", 2: "alphax", 8: "betaxx", 9: "betaxx", 10: "betaxx", 11: "betaxx"}  # 6 names both; 3 to 5 and 7 are as near to 6's names


def test_a_lone_event_has_the_text_to_the_summary(spark):
    lines = [*["x"] * 14, "ALPHAX Dropper", "y", "# Summary", "of it", "# More articles", "other"]
    assert sorted(r["index"] for r in context(spark, lines).collect()) == list(range(4, 18))


@pytest.mark.parametrize(("said", "status"), [
    ("ALPHAX was seen in the wild", "observed_in_operations"), ("ALPHAX is not used in the wild", "unknown"), ("It does not show ALPHAX in the wild", "unknown"), ("ALPHAX is experimental and in the wild", "observed_in_operations"),
])
def test_status_is_grounded(spark, said, status):
    (event,) = D.assembled(context(spark, ["ALPHAX Dropper", said])).collect()
    assert event.status == status and event.event_type == "malware_operation"


def test_artifacts(spark):
    h = [c * 64 for c in "abc"]
    lines = ["ALPHAX Dropper", f"hashes {h[0]} of others", f"alphax: {h[1].upper()} {h[0]}", "The payload named DropZone was compiled in Go", f"DropZone {h[2]}", "z" * 90 + " credential stealer " + "y" * 90]
    c = context(spark, lines)
    got = {r.family: r for r in D.artifacts(c, D.assembled(c).select("event_id", "event_type")).collect()}
    assert got["ALPHAX"].sha256 == [h[1], h[0]] and got["ALPHAX"].scope == "sample_set" and got["ALPHAX"].role == "dropper" and got["ALPHAX"].language == "Go"
    assert got["DropZone"].sha256 == [h[2]] and got["DropZone"].scope == "exact_sample" and got["DropZone"].role == "implant"


def test_prompts_of_an_event_are_its_first_purposes(spark):
    lines = ["ALPHAX Dropper", "its prompt says rewrite it, output only the code", "a prompt to generate a command; it then executes", "prompt: rewrite again", "prompt to collect output", "the prompt, obfuscated output", "prompt persona output", "prompt to rewrite, too late"]
    got = sorted(D.prompt_mentions(context(spark, lines)).collect(), key=lambda r: r["index"])
    assert [(r.purpose, r["index"], r.n_blocks, r.effectiveness) for r in got] == [("self_rewriting", 1, 2, "unknown"), ("command_generation", 2, 1, "succeeded"), ("data_collection", 4, 1, "unknown"), ("analysis_evasion", 5, 1, "unknown")]
    assert got[0].constraints == ["output_only", "code_only"] and got[3].evasion


def test_every_pattern_has_a_cue():
    """A cue is in all that a pattern finds: each of the texts that stand for its alternatives holds one."""
    import re

    from sigtrail.operators import assess as A

    said = {
        0: ["ABCD Reverse Shell", "ABCD Dropper", "ABCD Ransomware", "ABCD Data Miner", "ABCD Credential Stealer"], 1: [f"abcd IS a {x}" for x in ("Reverse Shell", "DROPPER", "ransomware", "data miner", "credential stealer", "Malware")],
        2: ["Tracked As Abcd", "DESIGNATED Abcd", "group dubbed Abcd"], 3: ["GTG-1002"], 4: ["Track as ABCD was reported as EFG"], 5: ["targeted with Hermes AI agent"],
    }
    for rule, pattern, *_, heading in D.NAME_RULES:
        assert heading == (rule not in D.NAME_CUES)
        for text in said.get(rule, []):
            assert re.search(pattern, text) and any(c in text.lower() for c in D.NAME_CUES[rule]), (rule, text)
    statuses = [
        ["oBserved"], ["In Operations"], ["Proof-of concept", "a PoC.", "概念验证"], ["LIVE operations", "Observed in operations", "In the wild", "used during a ransomware attack"], ["development or testing phase", "Research and Development Phase"],
        ["Experimental"], ["successful intrusions", "compromise multiple systems", "Confirmed Intrusion"],
    ]
    patterns = [r"(?i)\bObserved\b", r"(?i)\bin operations\b", *(p for _, p in A.STATUS_RULES)]
    assert len(A.STATUS_CUES) == len(patterns)
    for pattern, cues, texts in zip(patterns, A.STATUS_CUES, statuses, strict=True):
        assert len(texts) == len(pattern.replace("development or", "").split("|"))
        assert all(re.search(pattern, t) and any(c in t.lower() for c in cues) for t in texts)
