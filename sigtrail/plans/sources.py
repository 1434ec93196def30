"""Queries over Python sources made of each document's columns and whole text, one of six shapes by its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtrail.operators import provenance
from sigtrail.plans.planted import planted, with_planted

_HEAD = "from openai import OpenAI\nclient = OpenAI(base_url=f'https://{HOST}/v1')\nHOST = '{family}.example'\nTEXT = {text}\n"
#: Sources by doc_id % 6; {family}, {lang} and {text} (a literal) are the document's.
SHAPES = [
    _HEAD + "PREFIX = '{family}-'\ndef select(flag):\n    if flag:\n        suffix = 'alpha'\n    else:\n        suffix = '{lang}'\n    return PREFIX + suffix\ndef wrapper(value):\n    return client.chat.completions.create(model=value, messages=[{'role': 'user', 'content': TEXT}])\nwrapper(select(runtime_flag))\n",
    _HEAD + "def example():\n    model = 'example'\n    return model\ndef real():\n    model = '{lang}-v7'\n    def inner():\n        return client.chat.completions.create(model=model, messages=[])\n    return inner()\nmodel = 'module'\n",
    _HEAD + "class A:\n    def ask(self, model='x'):\n        model = 'in-a'\n        return model\nclass B:\n    def ask(self):\n        model = f'{lang}-{7}'\n        client.responses.create(model=model, input=['Do it.', TEXT])\n",
    "import requests\nVERSION = 2\nTEXT = {text}\nbody = {'messages': [{'content': TEXT}], 'model': '{family}' if x else 'other'}\nrequests.post(f'https://h.example/v{VERSION}/{lang}', json=body)\nrequests.post('https://quiet.example', json={'model': 'alone'})\n",
    _HEAD + "model = load('opaque')\nclient.chat.completions.create(model=model, messages=[{'content': unknown(TEXT)}])\nclient.images.generate(prompt=TEXT)\n",
    _HEAD + "name = '{lang}'\nname = name + '-x'\nparts = []\nparts.append(TEXT)\nother = name\nname = other\nclient.chat.completions.create(model=name, messages=parts)\n",
]


def _sources(spark, sf_dir):
    text = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    filled = lambda shape: F.replace(F.replace(F.replace(F.lit(shape), F.lit("{family}"), F.col("family")), F.lit("{lang}"), F.coalesce("lang", F.lit("none"))), F.lit("{text}"), text)
    source = F
    for k, shape in enumerate(SHAPES):
        source = source.when(F.col("doc_id") % len(SHAPES) == k, filled(shape))
    return planted(spark, sf_dir).select("artifact", source.alias("text"))


def call_evidence(spark, sf_dir):
    found = provenance.call_evidence(_sources(spark, sf_dir))
    return found.select("artifact", "type", "argument", "callee", F.when(F.col("type") == "prompt", F.sha2("value", 256)).otherwise(F.col("value")).alias("value"), "line")


QUERIES = {"q_call_evidence": call_evidence}

_CREATE, _RESPOND, _IMAGES = "client.chat.completions.create", "client.responses.create", "client.images.generate"
#: (shape, type, argument, callee, line, value in SQL) of what each shape must give.
_EXPECTED = [
    *((k, "sdk_call", None, c, n, "'openai'") for k, c, n in ((0, _CREATE, 13), (1, _CREATE, 11), (2, _RESPOND, 12), (4, _CREATE, 6), (4, _IMAGES, 7), (5, _CREATE, 11))),
    *((k, "service_endpoint", None, c, n, "'https://' || family || '.example/v1'") for k, c, n in ((0, _CREATE, 13), (1, _CREATE, 11), (2, _RESPOND, 12), (4, _CREATE, 6), (4, _IMAGES, 7), (5, _CREATE, 11))),
    (0, "model_argument", "model", _CREATE, 13, "family || '-alpha'"), (0, "model_argument", "model", _CREATE, 13, "family || '-' || l"), (0, "prompt", "messages", _CREATE, 13, "sha256(text)"),
    (1, "model_argument", "model", _CREATE, 11, "l || '-v7'"),
    (2, "model_argument", "model", _RESPOND, 12, "l || '-7'"), (2, "prompt", "input", _RESPOND, 12, "sha256('Do it.')"), (2, "prompt", "input", _RESPOND, 12, "sha256(text)"),
    (3, "model_argument", "model", "requests.post", 5, "family"), (3, "model_argument", "model", "requests.post", 5, "'other'"), (3, "service_endpoint", None, "requests.post", 5, "'https://h.example/v2/' || l"),
    (4, "prompt", "prompt", _IMAGES, 7, "sha256(text)"),
    (5, "model_argument", "model", _CREATE, 11, "l"), (5, "prompt", "messages", _CREATE, 11, "sha256(text)"),
]
_NULL = lambda x: "NULL" if x is None else f"'{x}'"

ORACLE_SQL = {
    "q_call_evidence": with_planted(
        "p AS (SELECT *, coalesce(lang, 'none') AS l FROM planted) " + " UNION ALL ".join(f"SELECT artifact, '{t}' AS type, {_NULL(a)} AS argument, '{c}' AS callee, {v} AS value, {n}::BIGINT AS line FROM p WHERE doc_id % {len(SHAPES)} = {k}" for k, t, a, c, n, v in _EXPECTED)
    ),
}
