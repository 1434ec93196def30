"""Main text of web pages by removal of site templates.

Each page is parsed once into text blocks with the hashes of the element subtrees around them, which are written to the shared
folder. Subtree hashes are counted per host over all pages; subtrees that recur on many pages of a host, which otherwise
differ, are its template and go, with all they hold. What never is article text goes by element or by name, also on hosts
with few pages.

Where a page has an article or main element, only what it holds is text. Plain paragraphs, headings and cells in an article
are no candidates for removal, so a sentence that many articles share stays. Pages differ if the longest block outside the
subtree differs: copies of an article, whatever surrounds them, count as one page, and keep every word.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrail.llm.common import durable, small_batches, table

#: Pages of one host, different outside the subtree, that must share it before it is the host's template.
MIN_PAGES = 5
#: The share of the host's different pages that these must be at least.
MIN_SHARE = 0.01
#: Subtrees of all hosts' templates that are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_TEMPLATES = 500_000

# HTML element names, and words in class, id and role that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
DROPPED = frozenset("head nav header footer aside form button select dialog menu script style textarea title noscript template iframe svg canvas object".split())
BLOCKS = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("aside details div dl fieldset figure footer form header nav ol section table ul".split())
CLOSES_P = BLOCKS - {"br"}
MARKED = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu masthead nav navbar navigation newsletter notice notices pager pagination popup promo promotion related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
COMMENTS = frozenset(["comment", "comments"])
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

MAIN = frozenset(["article", "main"])
#: Where the search for an open p or li ends.
_BOUNDS = CONTAINERS | MAIN | {"body", "td", "th", "blockquote"}
#: How well a block is hidden: shown; hidden unless an article lies in it (a form, or a name of which a part is a marking word); hidden.
SHOWN, SOFT, HARD = 0, 1, 2

# A quoted value ends where its quote is followed by the next attribute or the end; a tag with an open quote ends at the next ">".
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([A-Za-z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+)(?:>|\Z)|([^>]*)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def hiding(name: str, attributes: str, inside: bool) -> int:
    """How an element is hidden by its own name, classes, id and role. Inside an article only blocks are, by whole classes."""
    own = SOFT if name == "form" else HARD if name in DROPPED else SHOWN
    if own == HARD or not attributes or name in ("html", "body", "main") or inside and name not in BLOCKS:
        return own
    marked = COMMENTS if name == "article" else MARKED  # an article may be a reader's comment
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if kind.lower() == "role":
            if name != "article" and value.strip() in ROLES:
                return HARD
            continue
        for token in value.split():
            if token in marked:
                return HARD
            if not inside and any(w in marked for w in _WORD.findall(token)):
                own = HARD if name == "article" else SOFT
    return own


class _Element:
    __slots__ = ("name", "hidden", "mark", "seen", "first", "inside")

    def __init__(self, name: str, hidden: int, mark: bool, first: int, inside: bool, seen) -> None:
        self.name, self.hidden, self.mark, self.first, self.inside, self.seen = name, hidden, mark, first, inside, seen


class _Parser:
    """One pass over a page; each tag takes constant time, apart from the elements that it closes."""

    def __init__(self) -> None:
        self.blocks: list[str] = []
        self.kinds: list[tuple[bool, int]] = []  # of each block: inside an article, how hidden
        self.spans: list[tuple[int, int, int, bool]] = []
        self.parts: list[str] = []
        self.kind = (False, SHOWN)
        self.stack = [_Element("", SHOWN, False, 0, False, blake2b(digest_size=8))]
        #: Depths of the open elements of each name, of what ends the search for p and li, and of what inline end tags don't close.
        self.open: dict[str, list[int]] = defaultdict(list)
        self.bounds, self.walls = [0], [0]

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            self.blocks.append(text)
            self.kinds.append(self.kind)

    def text(self, value: str) -> None:
        if not value:
            return
        top = self.stack[-1]
        top.seen.update(value.encode("utf-8", "surrogatepass"))
        if top.hidden == HARD:
            return
        kind = (top.inside, top.hidden)
        if kind != self.kind and not value.isspace():
            self.flush()
            self.kind = kind
        self.parts.append(html.unescape(value))

    def close(self) -> None:
        depth = len(self.stack) - 1
        element = self.stack.pop()
        if element.name in BLOCKS:
            digest = element.seen.digest()
            self.stack[-1].seen.update(digest)
            if element.mark and element.first < len(self.blocks):
                self.spans.append((int.from_bytes(digest, "little", signed=True), element.first, len(self.blocks), element.inside))
        else:
            self.stack[-1].seen.update(b"/>")
        self.open[element.name].pop()
        for depths in (self.bounds, self.walls):
            if depths[-1] == depth:
                depths.pop()

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            if self.stack[-1].name in BLOCKS:
                self.flush()
            self.close()

    def end(self, name: str) -> None:
        depths = self.open[name]
        if not depths:
            if name in ("br", "p"):
                self.flush()
        elif name in BLOCKS or self.walls[-1] <= depths[-1]:  # an inline end tag doesn't close containers
            self.close_to(depths[-1])

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
        if name in CLOSES_P:
            depths = self.open["li" if name == "li" else "p"]
            if depths and depths[-1] > self.bounds[-1]:
                self.close_to(depths[-1])
        if name in VOID:
            self.stack[-1].seen.update(name.encode())
            return
        top, depth = self.stack[-1], len(self.stack)
        own = hiding(name, attributes, top.inside)
        hidden = own if name in MAIN and top.hidden == SOFT else max(top.hidden, own)
        inside = top.inside or name in MAIN
        marked = name in CONTAINERS or (name in BLOCKS and name not in ("html", "body", "article", "main") and not inside)
        seen = blake2b(name.encode(), digest_size=8) if name in BLOCKS else top.seen
        seen.update(f"{name} {attributes.strip()}>".encode("utf-8", "surrogatepass"))
        self.stack.append(_Element(name, hidden, marked, len(self.blocks), inside, seen))
        self.open[name].append(depth)
        if name in _BOUNDS:
            self.bounds.append(depth)
        if name in CONTAINERS or name in MAIN:
            self.walls.append(depth)

    def run(self, page: str) -> None:
        at, n, unclosed = 0, len(page), set()
        while at < n:
            found = _TOKEN.search(page, at)
            if not found:
                self.text(page[at:])
                break
            self.text(page[at : found.start()])
            at = found.end()
            if not found[1]:
                continue
            name, attributes = found[1].lower(), found[2] if found[2] is not None else found[3]
            if found[0][1] == "/":
                self.end(name)
                continue
            if name in RAW:
                end = None if name in unclosed else _RAW_END[name].search(page, at)
                if not end and name in ("svg", "noscript", "template"):
                    unclosed.add(name)  # nothing tells where it ends: as if empty
                    continue
                self.start(name, attributes)
                self.stack[-1].seen.update(page[at : end.start() if end else n].encode("utf-8", "surrogatepass"))
                at = end.end() if end else n
                self.close()
            else:
                self.start(name, attributes)
        self.flush()
        self.close_to(1)


def _key(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(page: str) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """The text blocks of the article in page order, and the subtrees that may be template: hash, hash of the longest block outside, first block, end block.

    Where the page has an article or main element with text, only its blocks count; else those of the whole body. A subtree
    with over half of the page's text is no template.
    """
    parser = _Parser()
    parser.run(page)
    chosen = next((c for c in ((True, SHOWN), (False, SHOWN), (True, SOFT), (False, SOFT)) if c in parser.kinds), None)
    keep = [k for k, kind in enumerate(parser.kinds) if kind == chosen]
    if not keep:
        return [], []
    blocks = [parser.blocks[k] for k in keep]
    place = [0] * (len(parser.blocks) + 1)  # kept blocks before each block
    for k in keep:
        place[k + 1] = 1
    for k in range(len(parser.blocks)):
        place[k + 1] += place[k]
    sizes = [0, *map(len, blocks)]
    for k in range(len(blocks)):
        sizes[k + 1] += sizes[k]
    before, after = [-1], [-1] * (len(blocks) + 1)  # the longest block before, and from, each place
    for k, x in enumerate(blocks):
        before.append(before[-1] if before[-1] >= 0 and len(blocks[before[-1]]) >= len(x) else k)
    for k in range(len(blocks) - 1, -1, -1):
        after[k] = after[k + 1] if after[k + 1] >= 0 and len(blocks[after[k + 1]]) > len(blocks[k]) else k
    keys: dict[int, int] = {}
    spans = []
    for digest, a, b, inside in parser.spans:
        a, b = place[a], place[b]
        if a == b or inside != chosen[0] or 2 * (sizes[b] - sizes[a]) > sizes[-1]:
            continue
        longest = max((k for k in (before[a], after[b]) if k >= 0), key=lambda k: (len(blocks[k]), -k))
        if longest not in keys:
            keys[longest] = _key(blocks[longest])
        spans.append((digest, keys[longest], a, b))
    return blocks, spans


def without(blocks: list[str], spans: list[tuple[int, int, int]], gone) -> tuple[str, int]:
    """The blocks outside the subtrees (hash, first, end) whose hashes are in gone, joined by one space; and how many went."""
    cut = [(a, b) for digest, a, b in spans if digest in gone]
    lost = {k for a, b in cut for k in range(a, b)} if cut else ()
    return " ".join(x for k, x in enumerate(blocks) if k not in lost), len(cut)


_PARSED = [
    T.StructField("content", T.LongType()), T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("hs", T.ArrayType(T.LongType())), T.StructField("outside", T.ArrayType(T.LongType())),
    T.StructField("first", T.ArrayType(T.IntegerType())), T.StructField("end", T.ArrayType(T.IntegerType())),
]


def _parse_pages(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, spans = zip(*(parse(x.as_py()) for x in batch.column("html")), strict=True) if batch.num_rows else ((), ())
            columns = [[_key("\n".join(b)) for b in blocks], blocks, *([[s[i] for s in own] for own in spans] for i in range(4))]
            kept = [batch.column(c) for c in ("page_id", "url", "host")]
            yield pa.record_batch([*kept, *(pa.array(c, schema.field(k + 3).type) for k, c in enumerate(columns))], names=schema.names)

    return run


def _texts(templates):
    """Texts without the templates: of the row's host in a broadcast table, or, without one, of the row's column gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates.value if templates else None
        for batch in batches:
            names = batch.column("host" if templates else "gone").to_pylist()
            rows = zip(*(batch.column(c).to_pylist() for c in ("blocks", "hs", "first", "end")), names, strict=True)
            done = [without(blocks, list(zip(hs, first, end, strict=True)), known.get(name, ()) if templates else set(name or ())) for blocks, hs, first, end, name in rows]
            texts = [t for t, _ in done]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in done], pa.int64())]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_template"])

    return run


def site_templates(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, h: the subtrees of each host that are template. Counts are combined before they are shuffled."""
    seen = parsed.select("host", F.inline(F.arrays_zip("hs", "outside"))).select("host", F.col("hs").alias("h"), "outside").distinct()
    counts = seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    of_host = parsed.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    return counts.join(of_host, "host").filter(F.col("n") >= min_share * F.col("n_host")).select("host", "h")


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars, n_template (subtrees removed as template): one row for each row of pages.

    pages has page_id, url and html; other columns are not read. A null html counts as empty and gives an empty text; a null
    url belongs to a host of its own kind (""). Copies of a page, and rows that repeat, count as one page and get a row each.
    An empty table gives no rows.
    Parsed pages are written once. A host with a third of all pages is only a group of counts, which are combined before they
    are shuffled; templates are looked up in a broadcast table where there are few, else joined by page, never by host alone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    small_batches(spark)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("host", host)
    ids = [base.schema["page_id"], base.schema["url"]]
    schema = T.StructType([*ids, T.StructField("host", T.StringType()), *_PARSED])
    parsed = durable(base.mapInArrow(_parse_pages(to_arrow_schema(schema)), schema).withColumn("row", F.monotonically_increasing_id()), "page-blocks", compression="zstd")
    templates = durable(site_templates(parsed, min_pages, min_share), "page-templates")
    out = T.StructType([*ids, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_template", T.LongType())])
    if templates.count() <= broadcast_templates:
        rows = templates.toArrow()
        known = defaultdict(set)
        for name, h in zip(rows.column("host").to_pylist(), rows.column("h").to_pylist(), strict=True):
            known[name].add(h)
        return parsed.mapInArrow(_texts(spark.sparkContext.broadcast(dict(known))), out)
    hits = parsed.select("row", "host", F.explode(F.array_distinct("hs")).alias("h")).join(templates, ["host", "h"])
    gone = hits.groupBy("row").agg(F.collect_set("h").alias("gone"))
    return parsed.join(gone, "row", "left").mapInArrow(_texts(None), out)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_extract": op4_html_extract}
ORACLE_SQL: dict[str, str] = {}
