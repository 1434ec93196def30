import pytest
from sigtrail.operators import provenance as P

HEAD = "from openai import OpenAI\nclient = OpenAI()\n"


def found(spark, **sources):
    """{source: {(type, value)}}"""
    df = spark.createDataFrame(list(sources.items()), "artifact string, text string")
    out = {k: set() for k in sources}
    for r in P.call_evidence(df).collect():
        if r.type != "sdk_call":
            out[r.artifact].add((r.type, r.value))
    return out


def models(**sources):
    return {k: HEAD + v for k, v in sources.items()}


def test_scopes_and_values(spark):
    ask = "client.chat.completions.create(model=%s, messages=[])\n"
    got = found(spark, **models(
        local="def a():\n    model = 'a'\ndef b():\n    model = 'b'\n    " + ask % "model", module="M = 'm'\ndef a():\n    " + ask % "M" + "def b():\n    M = 'other'\n",
        nested="def out():\n    m = 'near'\n    def inner():\n        " + ask % "m" + "m = 'far'\n", shadowed="def f(x):\n    " + ask % "x" + "def g(x):\n    return f(x)\ng('one')\nf(x='two')\nx = 'no'\n",
        twice="def pick():\n    return 'old'\ndef pick():\n    return 'new'\n" + ask % "pick()", methods="class A:\n    def pick(self):\n        return 'a'\n" + ask % "pick()",
        branch="m = 'a' if x else 'b'\n" + ask % "m", formed="v = 3\n" + ask % "f'm-{v}-{\"x\"}'", several="a = 'p'\na = 'q'\n" + ask % "a + '-' + a",
        missing=ask % "'known' + unknown()", number=ask % "'m' + 3", self_="m = 'a'\nm = m + 'b'\n" + ask % "m", ring="a = b\nb = c\nc = a\nc = 'z'\n" + ask % "a",
        opaque="m = load('x')\n" + ask % "m", lists="for m in ['x', 'y']:\n    " + ask % "m", no_client="class other:\n    pass\nother.chat.create(model='x')\n",
    ))
    values = {k: {v for t, v in x if t == "model_argument"} for k, x in got.items()}
    assert values == {
        "local": {"b"}, "module": {"m"}, "nested": {"near"}, "shadowed": {"one", "two"}, "twice": {"new"}, "methods": set(), "branch": {"a", "b"}, "formed": {"m-3-x"}, "several": {"p-p", "p-q", "q-p", "q-q"},
        "missing": set(), "number": set(), "self_": {"a"}, "ring": {"z"}, "opaque": set(), "lists": {"x", "y"}, "no_client": set(),
    }


def test_http_calls_need_an_input_and_a_model(spark):
    got = found(
        spark, both="import requests\nk = 'mod' + 'el'\nrequests.post('https://' + 'h', json={k: 'm', 'Prompt': 'p'})\n", model_only="requests.post('u', json={'model': 'm'})\n", keywords="s.request(url='w', data={'input': 1}, model='k')\n",
        dict_only="x = {'model': 'm', 'prompt': 'p'}\n", built="b = {'messages': []}\nc = {'deployment': 'd'}\nrequests.post(u, json=[b, c])\n", get="requests.get('u', json={'model': 'm', 'prompt': 'p'})\n",
    )
    assert got == {
        "both": {("model_argument", "m"), ("service_endpoint", "https://h")}, "model_only": set(), "keywords": {("model_argument", "k"), ("service_endpoint", "w")}, "dict_only": set(), "built": {("model_argument", "d")}, "get": set(),
    }


def test_clients_and_prompts(spark):
    got = found(
        spark, url="import openai as o\nBASE = 'https://own'\nc = o.OpenAI(base_url=BASE)\nc.responses.create(input=['a', 'b'.format('d')])\n", module="import ollama\nollama.generate(prompt=P)\nP = 'ask ' + unknown('no') + 'on'\n",
        first="from google import genai\ng = genai.Client()\ng.models.generate_content('said', model='gem')\n", content=HEAD + "client.chat.completions.create(messages=[{'role': 'user', 'content': 'yes'}])\n", broken="def (", none=None, plain="x = 1",
    )
    assert got == {
        "url": {("service_endpoint", "https://own"), ("prompt", "a"), ("prompt", "b"), ("prompt", "d")}, "module": {("prompt", "ask "), ("prompt", "on")}, "first": {("model_argument", "gem"), ("prompt", "said")},
        "content": {("prompt", "yes")}, "broken": set(), "none": set(), "plain": set(),
    }


@pytest.mark.parametrize(("hops", "values"), [(16, {"x"}), (3, set())])
def test_hops_bound_a_flow(spark, hops, values):
    text = HEAD + "a = 'x'\nb = a\nc = b\nclient.chat.completions.create(model=c)\n"
    df = spark.createDataFrame([("s", text)], "artifact string, text string")
    assert {r.value for r in P.call_evidence(df, hops=hops).collect() if r.type == "model_argument"} == values


def test_empty(spark):
    assert P.call_evidence(spark.createDataFrame([], "artifact string, text string")).collect() == []


def test_texts_are_not_carried_along_edges(spark):
    """A long text that reaches an input and no model is at no node of the values, and each prompt is given once."""
    long = "word " * 5000
    hops = "".join(f"t{k + 1} = t{k}\n" for k in range(6))
    text = HEAD + f"t0 = {long!r}\n{hops}m = 'one' if x else 'two'\nclient.chat.completions.create(model=m, messages=[t6, {long!r}])\n"
    df = spark.createDataFrame([("s", text), ("s", text), (None, text)], "artifact string, text string")
    flows = P.python_flows(df.filter("artifact is not null").limit(1))
    edges, sites = P.resolved(flows)
    wanted = flows.filter("kind = 'sent' and b = 'model'").selectExpr("artifact", "c AS node")
    values = P.static_values(flows, edges, wanted=wanted)
    assert {r.value for r in values.collect()} == {"one", "two"}
    assert {r.value for r in P.static_values(flows, edges).collect()} >= {"one", "two", long}
    assert all(r.c is None or len(r.c) <= 64 for r in flows.filter("kind = 'const'").collect())
    got = sorted((r.artifact, r.type, r.value) for r in P.call_evidence(df).collect())
    assert got == [("s", "model_argument", "one"), ("s", "model_argument", "two"), ("s", "prompt", long), ("s", "sdk_call", "openai")]


def test_sources_share_frames(spark):
    from sigtrail.sources import readers

    df = spark.createDataFrame([(str(k), b"abcd%d" % k) for k in range(50)], "artifact string, content binary").coalesce(1)
    got = readers._mapped(df, lambda data: [(data.decode(),)] if data != b"abcd7" else [], "artifact string, value string", "artifact", "content")
    assert sorted(tuple(r) for r in got.collect()) == sorted((str(k), f"abcd{k}") for k in range(50) if k != 7)
