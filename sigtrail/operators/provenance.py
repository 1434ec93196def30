"""Model names, endpoints and prompts that reach AI calls in Python sources.

A visitor turns each source into rows: names with their scopes, definitions, calls with arguments, constants. All that follows is
joins over these rows: a name belongs to the nearest enclosing scope that binds it, values are a fixpoint of sets of alternatives,
and constants reach calls over edges. Nothing is imported or run; calls of unknown functions stop a flow.
"""

from __future__ import annotations

import ast
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.operators.store import written
from sigtrail.sources.readers import _mapped

# SDKs, constructors of clients, endings of their calls, and arguments that hold a model or an input.
SDKS = {"openai": "OpenAI", "anthropic": "Anthropic", "ollama": "Ollama", "google": "Google"}
CLIENTS = ["OpenAI", "AsyncOpenAI", "AzureOpenAI", "Anthropic", "GenerativeModel", "Client", "InferenceClient", "Groq"]
CALLS = (".create", ".generate_content", ".chat", ".generate", ".complete")
HTTP_CALLS = (".post", ".request")
MODEL_KEYS = ["model", "model_name", "engine", "deployment", "deployment_name"]
INPUT_KEYS = ["messages", "prompt", "contents", "input"]
INPUT_ARGUMENTS = ["messages", "prompt", "contents", "input"]
FIRST_IS_INPUT = (".generate_content", ".complete")
UNPACKED = ("b64decode", ".decode", ".format", ".join")
#: Edges that a value may be away from its use; hops that one table covers; combinations of a joined text's parts that one row
#: puts together (more are put together as rows), and tasks that such rows of one text are dealt to.
MAX_HOPS, ROUNDS, ROW_VALUES, DEALT = 16, 4, 256, 16
#: Constants of more characters are told apart by their hash: only tables that need a text carry it.
SHORT = 40
_ROW = "kind string, a string, b string, c string, n long, text string"


def _name(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id if isinstance(node, ast.Name) else "?", *reversed(parts)])


class _Rows(ast.NodeVisitor):
    """rows (kind, a, b, c, n, text) of a source. Scopes are paths; a function's part has its place, so that namesakes are apart."""

    def __init__(self, tree: ast.Module) -> None:
        self.rows: list[tuple] = []
        self.ids: dict[int, str] = {}
        self.scope, self.in_class = "", False
        self.visit(tree)

    def id(self, node: ast.AST) -> str:
        return self.ids.setdefault(id(node), f"n{len(self.ids)}")

    def add(self, kind: str, a: str | None = None, b: str | None = None, c: str | None = None, n: int | None = None, text: str | None = None) -> None:
        self.rows.append((kind, a, b, c, n, text))

    def edges(self, node: ast.AST, *children: ast.AST | None) -> None:
        for child in children:
            if child is not None:
                self.add("edge", self.id(node), self.id(child))

    def bound(self, target: ast.AST, value: ast.AST | None) -> None:
        if isinstance(target, ast.Name) and value is not None:
            self.add("edge", f"v:{self.scope}:{target.id}", self.id(value))

    def visit_FunctionDef(self, node) -> None:
        inner = f"{self.scope}/{node.name}@{node.lineno}.{node.col_offset}"
        if not self.in_class:
            self.add("function", self.scope, node.name, inner, node.lineno)
        positional = [*node.args.posonlyargs, *node.args.args]
        for k, arg in enumerate([*positional, *node.args.kwonlyargs, *filter(None, [node.args.vararg, node.args.kwarg])]):
            self.add("bind", inner, arg.arg)
            self.add("param", inner, arg.arg, None, k if k < len(positional) else None)
        before, self.scope, self.in_class = (self.scope, self.in_class), inner, False
        self.generic_visit(node)
        self.scope, self.in_class = before

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        before, self.in_class = self.in_class, True
        self.generic_visit(node)
        self.in_class = before

    def visit_Import(self, node) -> None:
        for alias in node.names:
            root = alias.name.split(".")[0]
            self.add("import", alias.asname or root, root.casefold())

    def visit_ImportFrom(self, node) -> None:
        for alias in node.names:
            self.add("import", alias.asname or alias.name, (node.module or "").split(".")[0].casefold())

    def visit_Name(self, node) -> None:
        if isinstance(node.ctx, ast.Store):
            self.add("bind", self.scope, node.id)
        self.add("use", self.id(node), self.scope, node.id)

    def visit_Constant(self, node) -> None:
        if isinstance(node.value, (str, int, float, bool)):
            said = str(node.value)
            short = said if len(said) <= SHORT else sha256(said.encode("utf-8", "surrogatepass")).hexdigest()
            self.add("const", self.id(node), "text" if isinstance(node.value, str) else "other", short, node.lineno, said)

    def visit_Assign(self, node) -> None:
        for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
            self.bound(target, node.value)
            if isinstance(target, ast.Name) and isinstance(node.value, ast.Call):
                urls = [k.value for k in node.value.keywords if k.arg in ("base_url", "api_base")]
                self.add("client", f"v:{self.scope}:{target.id}", _name(node.value.func), self.id(urls[0]) if urls else None)
        self.generic_visit(node)

    visit_AnnAssign = visit_AugAssign = visit_Assign

    def visit_For(self, node) -> None:
        for target in ast.walk(node.target):
            self.bound(target, node.iter)
        self.generic_visit(node)

    visit_comprehension = visit_For

    def visit_Return(self, node) -> None:
        if self.scope and node.value:
            self.add("edge", f"r:{self.scope}", self.id(node.value))
        self.generic_visit(node)

    def visit_Dict(self, node) -> None:
        names = [k.value.casefold() if isinstance(k, ast.Constant) and isinstance(k.value, str) else None for k in node.keys]
        chosen = next(([x] for x in ("content", "messages") if x in names), ["prompt", "inputs", "contents", "text"])
        self.edges(node, *(v for k, v in zip(names, node.values, strict=True) if k in chosen))
        for k, v in zip(node.keys, node.values, strict=True):
            if k is not None:
                self.add("item", self.id(node), self.id(k), self.id(v))
        self.generic_visit(node)

    def visit_List(self, node) -> None:
        self.edges(node, *node.elts)
        self.generic_visit(node)

    visit_Tuple = visit_Set = visit_List

    def visit_BinOp(self, node) -> None:
        if isinstance(node.op, ast.Add):
            self.parts(node, "texts", [node.left, node.right])
        else:
            self.edges(node, node.left, node.right)
        self.generic_visit(node)

    def visit_JoinedStr(self, node) -> None:
        self.parts(node, "shown", node.values)
        self.generic_visit(node)

    def parts(self, node: ast.AST, kind: str, children: list[ast.AST]) -> None:
        for k, child in enumerate(children):
            self.add("part", self.id(node), self.id(child), f"{kind}/{len(children)}", k)

    def visit_FormattedValue(self, node) -> None:
        self.edges(node, node.value)
        self.generic_visit(node)

    def visit_IfExp(self, node) -> None:
        self.edges(node, node.body, node.orelse)
        self.generic_visit(node)

    def visit_Subscript(self, node) -> None:
        self.edges(node, node.value, node.slice)
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        name, func = _name(node.func), node.func
        if isinstance(func, ast.Name):
            self.add("call", self.id(node), self.scope, func.id)
            for k, arg in enumerate(node.args):
                self.add("arg", self.id(node), None, self.id(arg), k)
            for k in node.keywords:
                if k.arg:
                    self.add("arg", self.id(node), k.arg, self.id(k.value))
        elif isinstance(func, ast.Attribute) and func.attr in ("append", "extend") and isinstance(func.value, ast.Name):
            for arg in node.args:
                self.add("push", self.id(arg), self.scope, func.value.id)
        elif name.endswith(UNPACKED):
            inside = [] if name.endswith(".decode") else [*node.args, *(k.value for k in node.keywords)]
            self.edges(node, func.value if isinstance(func, ast.Attribute) else None, *inside)
        if name.endswith((*CALLS, *HTTP_CALLS)):
            self.add("site", self.id(node), self.scope, name, node.lineno)
            if node.args:
                self.add("sent", self.id(node), "", self.id(node.args[0]))
            for k in node.keywords:
                if k.arg:
                    self.add("sent", self.id(node), k.arg.casefold(), self.id(k.value))
        self.generic_visit(node)


def python_flows(sources: DataFrame, key: str = "artifact", text: str = "text", name: str | None = None) -> DataFrame:
    """artifact, kind, a, b, c, n, text: a source's rows. One that doesn't parse, or has no call that may be an AI call, has none.

    text is a constant's; its c is the text itself or, if that is long, its hash. name: a column that is kept, as a of one row "file".
    """

    def one(source: str, *names: str):
        try:
            rows = _Rows(ast.parse(source or "")).rows
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        return [*rows, *(("file", x, None, None, None, None) for x in names)] if any(r[0] == "site" for r in rows) else []

    return _mapped(sources, one, f"artifact {dict(sources.dtypes)[key]}, {_ROW}", key, text, *([name] if name else []))


def _kind(flows: DataFrame, kind: str, **names: str) -> DataFrame:
    return flows.filter(F.col("kind") == kind).select("artifact", *(F.col(c).alias(n) for c, n in names.items()))


def _nearest(rows: DataFrame, known: DataFrame, value: str) -> DataFrame:
    """rows (artifact, ..., scope, name) with value of the nearest enclosing scope in known (artifact, at, name, value), null without one."""
    parts = F.split("scope", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    keys = rows.columns
    up = rows.withColumn("at", F.explode(chain)).join(known, ["artifact", "at", "name"])
    best = up.groupBy(*keys).agg(F.max_by(value, F.length("at")).alias(value))
    return rows.alias("l").join(best.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in keys], "left").select("l.*", f"r.{value}")


def resolved(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, sites): artifact, src, dst of all flows; and artifact, site, callee, line, sdk, url of calls.

    A name belongs to the nearest enclosing function that binds it, else to the module; a call by name to the last function of that
    name in the nearest scope that has one. Methods aren't called by their bare name, and bodies of classes are no scopes of theirs.
    sdk is null for what isn't a known client's call; url is the node of a client's address.
    """
    binds = _kind(flows, "bind", a="at", b="name").distinct().withColumn("owner", F.col("at"))
    symbol = lambda: F.concat(F.lit("v:"), F.coalesce("owner", F.lit("")), F.lit(":"), F.col("name"))
    uses = _nearest(_kind(flows, "use", a="node", b="scope", c="name"), binds, "owner").select("artifact", F.col("node").alias("src"), symbol().alias("dst"))
    pushed = _nearest(_kind(flows, "push", a="node", b="scope", c="name"), binds, "owner").select("artifact", symbol().alias("src"), F.col("node").alias("dst"))
    functions = _kind(flows, "function", a="at", b="name", c="inner", n="line").groupBy("artifact", "at", "name").agg(F.max_by("inner", "line").alias("inner"))
    calls = _nearest(_kind(flows, "call", a="node", b="scope", c="name"), functions, "inner").filter("inner is not null")
    returned = calls.select("artifact", F.col("node").alias("src"), F.concat(F.lit("r:"), "inner").alias("dst"))
    args = _kind(flows, "arg", a="node", b="keyword", c="value", n="position").join(calls.select("artifact", "node", "inner"), ["artifact", "node"])
    params = _kind(flows, "param", a="inner", b="param", n="nth")
    by_place = args.filter("keyword is null").join(params, ["artifact", "inner"]).filter("position = nth")
    passed = by_place.select("artifact", "inner", "param", "value").unionByName(args.filter("keyword is not null").select("artifact", "inner", F.col("keyword").alias("param"), "value"))
    passed = passed.select("artifact", F.concat(F.lit("v:"), "inner", F.lit(":"), "param").alias("src"), F.col("value").alias("dst"))
    plain = _kind(flows, "edge", a="src", b="dst")
    edges = plain.unionByName(uses).unionByName(pushed).unionByName(returned).unionByName(passed).distinct()
    imports = _kind(flows, "import", a="alias", b="module").groupBy("artifact", "alias").agg(F.max("module").alias("module"))
    sites = _kind(flows, "site", a="site", b="scope", c="callee", n="line").withColumn("name", F.substring_index("callee", ".", 1))
    sites = _nearest(sites, binds, "owner").withColumn("symbol", symbol())
    clients = _kind(flows, "client", a="symbol", b="constructor", c="url").withColumn("alias", F.substring_index("constructor", ".", 1)).join(imports, ["artifact", "alias"], "left")
    of_client = F.coalesce("module", F.lower("alias"))
    of_client = F.when(of_client.isin(list(SDKS)), of_client).when(F.substring_index("constructor", ".", -1).isin(CLIENTS), of_client)
    clients = clients.select("artifact", "symbol", of_client.alias("client_sdk"), "url").filter("client_sdk is not null").groupBy("artifact", "symbol").agg(F.max("client_sdk").alias("client_sdk"), F.max("url").alias("url"))
    sites = sites.join(clients, ["artifact", "symbol"], "left").join(imports.withColumnRenamed("alias", "name"), ["artifact", "name"], "left")
    ends = F.lit(False)
    for x in CALLS:
        ends = ends | F.col("callee").endswith(x)
    own = F.when(F.col("module").isin(list(SDKS)), F.col("module"))
    return edges, sites.select("artifact", "site", "callee", "line", F.when(ends, F.coalesce(own, "client_sdk")).alias("sdk"), F.when(own.isNull(), F.col("url")).alias("url"))


def _reached(roots: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """roots (artifact, root, node) with every node that hops edges reach. ROUNDS hops go into one table; it ends where none adds any."""
    step = edges.select("artifact", F.col("src").alias("node"), "dst")
    seen = last = written(roots.distinct(), "reached")
    for begin in range(0, hops, ROUNDS):
        whole = last
        for _ in range(min(ROUNDS, hops - begin)):
            last = last.join(step, ["artifact", "node"]).select("artifact", "root", F.col("dst").alias("node"))
            whole = whole.unionByName(last)
        # What the last round adds goes on; a node that an earlier round had met needs no other visit.
        last = written(whole.distinct().join(seen, ["artifact", "root", "node"], "left_anti"), "reached")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen


def static_values(flows: DataFrame, edges: DataFrame, hops: int = MAX_HOPS, wanted: DataFrame | None = None) -> DataFrame:
    """artifact, node, value, text: the values that a node may have, as far as they are known without running anything.

    wanted (artifact, node): the nodes that are asked for. Values are only built at these and at what they reach, so that a long
    text which reaches none of them isn't carried from edge to edge.

    Alternatives (branches, several definitions, elements) are united; a sum of texts, and a text with values in it, is each
    combination of its parts' values (non-texts are shown only in the latter), however many these are, or nothing where a part has none.
    No name takes part in its own value: each value keeps the names that it came through, which ends
    cycles. Values are built in rounds of all sources together, each from what the round before has added, until a round adds none,
    hops at most.
    """
    up = edges.select("artifact", F.col("dst").alias("node"), "src")
    parts = _kind(flows, "part", a="src", b="node", c="how", n="nth")
    consts = _kind(flows, "const", a="node", b="text", text="value")
    if wanted is not None:
        asked = wanted.select("artifact", F.lit("").alias("root"), "node")
        asked = _reached(asked, edges.unionByName(parts.select("artifact", "src", F.col("node").alias("dst"))), hops).select("artifact", "node")
        consts, (up, parts) = consts.join(asked, ["artifact", "node"], "left_semi"), (x.join(asked.withColumnRenamed("node", "src"), ["artifact", "src"], "left_semi") for x in (up, parts))
        up, parts = written(up, "values-edges"), written(parts, "values-parts")
    named = F.col("src").rlike("^[vr]:")
    state = consts.select("artifact", "node", "value", (F.col("text") == "text").alias("text"), F.array().cast("array<string>").alias("through"))
    state = new = written(state.distinct(), "values")
    has_parts = not parts.isEmpty()
    for _ in range(hops):
        over = new.join(up, ["artifact", "node"]).filter(~(named & F.array_contains("through", F.col("src"))))
        found = over.select("artifact", F.col("src").alias("node"), "value", "text", F.when(named, F.array_sort(F.array_union("through", F.array("src")))).otherwise(F.col("through")).alias("through"))
        found = found.unionByName(_joined(state, parts.join(new.join(parts, ["artifact", "node"]).select("artifact", "src").distinct(), ["artifact", "src"]))) if has_parts else found
        new = written(found.distinct().join(state, ["artifact", "node", "value", "text", "through"], "left_anti"), "values")
        if new.isEmpty():
            break
        state = state.unionByName(new)
    return state.select("artifact", "node", "value", "text").distinct()


def _joined(state: DataFrame, parts: DataFrame) -> DataFrame:
    """The combinations of the values of each node's parts, all of them.

    Up to ROW_VALUES combinations of a node are built within a row. Of a node with more, its parts are put in chunks: neighbours that
    have that many together at most, or one part of any number. Chunks meet in joins, one after another, so that no row holds them.
    """
    told = state.join(parts, ["artifact", "node"]).filter(F.col("text") | F.col("how").startswith("shown")).select("artifact", "src", "how", "nth", "value", "through").distinct()
    counts = told.groupBy("artifact", "src", "how", "nth").agg(F.count(F.lit(1)).alias("n")).groupBy("artifact", "src", "how").agg(F.sort_array(F.collect_list(F.struct("nth", "n"))).alias("n"))
    product = F.aggregate("n", F.lit(1.0), lambda s, x: s * x["n"])
    counts = counts.filter(F.size("n") == F.substring_index("how", "/", -1).cast("int"))
    opens = lambda s, x: s["product"] * x["n"] > ROW_VALUES
    start = F.expr(f"named_struct('out', cast(array() AS array<struct<nth: bigint, n: bigint, chunk: int>>), 'chunk', -1, 'product', cast({ROW_VALUES + 1} AS double))")
    chunk = lambda s, x: F.when(opens(s, x), s["chunk"] + 1).otherwise(s["chunk"])
    dealt = lambda s, x: F.struct(
        F.concat(s["out"], F.array(F.struct(x["nth"].alias("nth"), x["n"].alias("n"), chunk(s, x).alias("chunk")))).alias("out"), chunk(s, x).alias("chunk"),
        F.when(opens(s, x), x["n"].cast("double")).otherwise(s["product"] * x["n"]).alias("product"),
    )
    chunks = counts.filter(product > ROW_VALUES).select("artifact", "src", F.aggregate("n", start, dealt).alias("c")).select("artifact", "src", F.col("c.chunk").alias("last"), F.inline("c.out"))
    most = chunks.agg(F.max("last")).first()[0]
    if most is None:
        return _as_values(_folded(told, ["artifact", "src", "how"], F.col("how")))
    chunks = written(chunks, "values-chunks")
    found = _folded(told.join(chunks.select("artifact", "src"), ["artifact", "src"], "left_anti"), ["artifact", "src", "how"], F.col("how")).drop("how")
    of_chunks = told.join(chunks, ["artifact", "src", "nth"])
    pieces = _folded(of_chunks.filter(F.col("n") <= ROW_VALUES), ["artifact", "src", "chunk", "last"]).unionByName(of_chunks.filter(F.col("n") > ROW_VALUES).select("artifact", "src", "chunk", "last", "value", "through"))
    pieces = written(pieces, "values-pieces")
    made = pieces.filter("chunk = 0").drop("chunk")
    for k in range(most + 1):
        if k:
            other = pieces.filter(F.col("chunk") == k).select("artifact", "src", F.col("value").alias("value_"), F.col("through").alias("through_"), F.explode(F.expr(f"sequence(0L, {DEALT - 1}L)")).alias("deal"))
            made = made.withColumn("deal", F.pmod(F.xxhash64("value", "through"), F.lit(DEALT))).join(other, ["artifact", "src", "deal"])
            made = made.select("artifact", "src", "last", F.concat("value", "value_").alias("value"), F.array_union("through", "through_").alias("through"))
        found = found.unionByName(made.filter(F.col("last") == k).drop("last"))
    return _as_values(found)


def _folded(told: DataFrame, keys: list[str], how: Column | None = None) -> DataFrame:
    """keys, value, through: the combinations of the values of all parts of a key, built within a row; of those with all parts of how, if given."""
    each = told.groupBy(*keys, "nth").agg(F.collect_set(F.struct("value", "through")).alias("v")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "v"))), lambda x: x["v"]).alias("v"))
    each = each if how is None else each.filter(F.size("v") == F.substring_index(how, "/", -1).cast("int"))
    start = F.array(F.struct(F.lit("").alias("value"), F.array().cast("array<string>").alias("through")))
    both = lambda a, b: F.struct(F.concat(a["value"], b["value"]).alias("value"), F.array_union(a["through"], b["through"]).alias("through"))
    combined = F.aggregate("v", start, lambda done, x: F.flatten(F.transform(done, lambda a: F.transform(x, lambda b: both(a, b)))))
    return each.select(*keys, F.inline(combined))


def _as_values(made: DataFrame) -> DataFrame:
    return made.select("artifact", F.col("src").alias("node"), "value", F.lit(True).alias("text"), F.array_sort("through").alias("through"))


def _ends_with(column: str, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in endings:
        out = out | F.col(column).endswith(x)
    return out


def call_evidence(sources: DataFrame, key: str = "artifact", text: str = "text", hops: int = MAX_HOPS) -> DataFrame:
    """artifact, type, argument, value, callee, line: what is bound to AI calls.

    type model_argument: values of a model key, of a known client's call or of an HTTP call whose keys (its own and those of the
    dictionaries that reach its json or data) hold both an input and a model; service_endpoint: an HTTP call's first argument or url, else
    the client's address; sdk_call: the SDK; prompt: texts that reach an input of a known client's call. A dictionary alone says nothing.
    """
    numbered = sources.filter(F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("artifact"), F.col(key).cast("string").alias("name"), F.col(text).alias("source"))
    flows = written(python_flows(numbered, "artifact", "source", "name"), "flows")
    edges, sites = resolved(flows)
    edges, sites = written(edges, "flow-edges"), written(sites.join(_kind(flows, "file", a="name"), "artifact"), "flow-sites")
    sent = written(_kind(flows, "sent", a="site", b="argument", c="arg").join(sites, ["artifact", "site"]), "flow-sent")
    all_edges = edges.unionByName(_kind(flows, "part", a="src", b="dst"))
    payload = sent.filter(F.col("argument").isin("json", "data") & _ends_with("callee", HTTP_CALLS)).select("artifact", F.col("site").alias("root"), F.col("arg").alias("node"))
    items = written(_reached(payload, all_edges, hops).join(_kind(flows, "item", a="node", b="key_node", c="arg"), ["artifact", "node"]), "flow-items")
    # A key that is a constant has no other value, so what it holds is only wanted under the key of a model.
    literal = _kind(flows, "const", a="key_node", c="literal")
    held = items.join(literal, ["artifact", "key_node"], "left").filter(F.col("literal").isNull() | F.lower("literal").isin(MODEL_KEYS))
    asked = sent.filter(F.col("argument").isin([*MODEL_KEYS, "url"]) | ((F.col("argument") == "") & _ends_with("callee", HTTP_CALLS)))
    wanted = asked.select("artifact", "arg").unionByName(held.select("artifact", "arg")).unionByName(items.select("artifact", F.col("key_node").alias("arg"))).unionByName(sites.filter("url is not null").select("artifact", F.col("url").alias("arg")))
    values = written(static_values(flows, edges, hops, wanted.select("artifact", F.col("arg").alias("node")).distinct()), "flow-values")
    texts = values.filter("text").select("artifact", F.col("node").alias("arg"), "value")
    names = values.select("artifact", F.col("node").alias("key_node"), F.col("value").alias("name"), F.col("text").alias("is_text"))
    only = names.groupBy("artifact", "key_node").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("name"), F.max("is_text").alias("is_text")).filter("n = 1 and is_text")
    items = items.join(only.withColumnRenamed("name", "key"), ["artifact", "key_node"]).select("artifact", F.col("root").alias("site"), F.lower("key").alias("argument"), "arg")
    both = sent.select("artifact", "site", "argument", "arg").unionByName(items).distinct()
    keys = both.groupBy("artifact", "site").agg(F.max(F.col("argument").isin(INPUT_KEYS)).alias("has_input"), F.max(F.col("argument").isin(MODEL_KEYS)).alias("has_model"))
    judged = sites.join(keys, ["artifact", "site"], "left").withColumn("http", _ends_with("callee", HTTP_CALLS) & F.coalesce("has_input", F.lit(False)) & F.coalesce("has_model", F.lit(False)))
    judged = judged.filter(F.col("http") | F.col("sdk").isNotNull()).select("artifact", "name", "site", "callee", "line", "sdk", "url", "http")
    at = ["name", "callee", "line"]
    models = both.filter(F.col("argument").isin(MODEL_KEYS)).join(judged, ["artifact", "site"]).join(texts, ["artifact", "arg"]).filter(F.trim("value") != "")
    models = models.select(*at, F.lit("model_argument").alias("type"), "argument", "value")
    first = sent.filter("argument = ''").select("artifact", "site", F.col("arg").alias("first"))
    url = sent.filter("argument = 'url'").select("artifact", "site", F.col("arg").alias("by_name"))
    ends = judged.join(first, ["artifact", "site"], "left").join(url, ["artifact", "site"], "left").withColumn("given", F.when(F.col("http") & F.col("first").isNotNull(), F.col("first")).otherwise(F.col("by_name")))
    known = texts.select("artifact", F.col("arg").alias("given"), F.col("value").alias("given_value"))
    ends = ends.join(known, ["artifact", "given"], "left")
    address = texts.select("artifact", F.col("arg").alias("url"), F.col("value").alias("url_value"))
    ends = ends.join(address, ["artifact", "url"], "left").select(*at, F.lit("service_endpoint").alias("type"), F.lit(None).cast("string").alias("argument"), F.coalesce("given_value", "url_value").alias("value")).filter(F.trim("value") != "")
    sdk = judged.filter("sdk is not null").select(*at, F.lit("sdk_call").alias("type"), F.lit(None).cast("string").alias("argument"), F.col("sdk").alias("value"))
    into = sent.filter(F.col("sdk").isNotNull() & (F.col("argument").isin(INPUT_ARGUMENTS) | ((F.col("argument") == "") & _ends_with("callee", FIRST_IS_INPUT))))
    roots = into.select("artifact", F.col("arg").alias("root"), F.col("arg").alias("node"))
    # Which constants a prompt has is settled by their short forms, each once; the texts themselves join last and are sent once.
    short = _kind(flows.filter("b = 'text'"), "const", a="node", c="short")
    prompts = _reached(roots, all_edges, hops).join(short, ["artifact", "node"]).select("artifact", F.col("root").alias("arg"), "node", "short")
    prompts = prompts.join(into, ["artifact", "arg"]).groupBy(*at, "argument", "short").agg(F.min(F.struct("artifact", "node")).alias("first")).select(*at, "argument", "first.*").join(_kind(flows, "const", a="node", text="value"), ["artifact", "node"])
    prompts = prompts.select(*at, F.lit("prompt").alias("type"), F.when(F.col("argument") != "", F.col("argument")).alias("argument"), "value")
    found = models.unionByName(ends).unionByName(sdk).distinct().unionByName(prompts)
    return found.withColumnRenamed("name", "artifact")


def reaching_constants(sources: DataFrame, key: str = "artifact", text: str = "text") -> DataFrame:
    """artifact, role, call, line, value: the models and the texts of inputs that reach the AI calls of each source."""
    found = call_evidence(sources, key, text).filter(F.col("type").isin("model_argument", "prompt"))
    return found.select("artifact", F.when(F.col("type") == "prompt", "prompt").otherwise("model").alias("role"), F.col("callee").alias("call"), "line", "value").distinct()
