"""Readers: bytes, archives, pages, exports and tables as rows. Contents are only parsed, never executed.

Formats that Spark can't split are read a file a row (binaryFile), and a small parser yields rows; whatever relates rows to one
another is left to joins and windows.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a scan: bytes of a file, characters of a string, strings of a file, members, bytes and ratio of an archive.
MAX_FILE, MAX_CHARS, MAX_STRINGS = 104_857_600, 4096, 5000
MAX_MEMBERS, MAX_MEMBER, MAX_TOTAL, MAX_RATIO = 128, 2 << 20, 16 << 20, 100

# Elements of a page that hold no report text, and its block elements.
SKIPPED = {"script", "style", "noscript", "svg", "form", "nav", "footer"}
BLOCK_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "pre", "blockquote", "figcaption"}

_ASCII = re.compile(rb"[\x20-\x7e]{4,}")
_WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){4,}")


def files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE) -> DataFrame:
    """artifact (sha256), path, length, content of the files below path, without the longer ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= max_bytes)
    return raw.select(F.sha2("content", 256).alias("artifact"), "path", "length", "content")


#: Rows, or characters of values that were read, of one frame that goes back to Spark.
FRAME_ROWS, FRAME_SIZE = 4096, 1 << 22


def _mapped(rows: DataFrame, one, schema: str, *columns: str) -> DataFrame:
    """A row of columns -> the rows that one(*values) yields, after the first column as key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        for pdf in batches:
            out, size = [], 0
            for values in pdf[list(columns)].itertuples(index=False):
                out += ((values[0], *r) for r in one(*values[1:]))
                size += sum(len(v) for v in values[1:] if isinstance(v, (str, bytes)))
                if len(out) >= FRAME_ROWS or size >= FRAME_SIZE:  # a frame for each value would cost more than the work on it
                    yield pd.DataFrame(out, columns=names, dtype=object)  # numbers beside nulls stay whole
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)

    return rows.select(*columns).mapInPandas(run, schema)


def strings(rows: DataFrame, key: str = "artifact", content: str = "content", cap: int = MAX_STRINGS, max_chars: int = MAX_CHARS) -> DataFrame:
    """key, encoding, offset, value: printable runs of four or more, ASCII before UTF-16LE, up to cap; by offset unless the cap is met."""

    def one(data: bytes):
        found = []
        for name, pattern, codec in (("ascii", _ASCII, "ascii"), ("utf16le", _WIDE, "utf-16le")):
            for m in pattern.finditer(data or b""):
                found.append((name, m.start(), m.group().decode(codec)[:max_chars]))
                if len(found) >= cap:
                    return found
        return sorted(found, key=lambda x: x[1])

    return _mapped(rows, one, "artifact string, encoding string, offset long, value string", key, content)


def source_text(rows: DataFrame, key: str = "artifact", content: str = "content") -> DataFrame:
    """key, text of contents that are text: UTF-8, with or without a mark, else UTF-16LE, at least nine tenths printable."""

    def one(data: bytes):
        for codec in ("utf-8-sig", "utf-16le"):
            try:
                text = (data or b"").decode(codec)
            except UnicodeDecodeError:
                continue
            if text and sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.9 * len(text):
                return [(text,)]
        return []

    return _mapped(rows, one, "artifact string, text string", key, content)


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.skip, self.tag, self.parts, self.title, self.in_title = 0, "p", [], "", False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.out.append((self.tag, text))

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in BLOCK_TAGS and not self.skip:
            self.flush()
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCK_TAGS and not self.skip:
            self.flush()
            self.tag = "p"

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.parts.append(data)


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """artifact, index, kind, section, text: the blocks of a page, each with the last heading, adjacent repeats once."""
    from sigtrail.operators.blocks import with_sections, without_adjacent_repeats

    def one(page: str):
        parser = _Blocks()
        parser.feed(page or "")
        parser.close()
        parser.flush()
        return [(k, tag, text) for k, (tag, text) in enumerate(parser.out)]

    rows = _mapped(pages.withColumn(key, F.col(key).cast("string")), one, "artifact string, index long, kind string, text string", key, html)
    return without_adjacent_repeats(with_sections(rows, "artifact", F.col("kind").rlike("^h[1-6]$")), "artifact")


def docx_blocks(rows: DataFrame, key: str = "artifact", content: str = "content") -> DataFrame:
    """artifact, index, kind, text of the paragraphs and table cells of a word-processing package."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(data: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                if z.getinfo("word/document.xml").file_size > MAX_TOTAL:
                    return []
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
            return []
        out = []
        for p in root.iter(f"{w}p"):
            text = " ".join("".join(t.text or "" for t in p.iter(f"{w}t")).split())
            style = p.find(f"{w}pPr/{w}pStyle")
            if text:
                out.append((len(out), "heading" if style is not None and style.get(f"{w}val", "").lower().startswith("heading") else "paragraph", text))
        return out

    return _mapped(rows, one, "artifact string, index long, kind string, text string", key, content)


def archive_members(rows: DataFrame, key: str = "artifact", content: str = "content") -> DataFrame:
    """artifact, member, size, data, status: members of ZIP files in order, within limits of count, size, total and ratio."""

    def one(data: bytes):
        try:
            z = zipfile.ZipFile(io.BytesIO(data or b""))
        except zipfile.BadZipFile:
            return []
        out, total = [], 0
        for k, info in enumerate(x for x in z.infolist() if not x.is_dir()):
            ratio = info.file_size / max(1, info.compress_size)
            status = "count" if k >= MAX_MEMBERS else "size" if info.file_size > MAX_MEMBER else "ratio" if ratio > MAX_RATIO else "total" if total + info.file_size > MAX_TOTAL else "encrypted" if info.flag_bits & 1 else "read"
            body = None
            if status == "read":
                try:
                    body = z.read(info)
                    total += len(body)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
                    status = "damaged"
            out.append((info.filename, info.file_size, body, status))
        return out

    return _mapped(rows, one, "artifact string, member string, size long, data binary, status string", key, content)


def carchive_members(rows: DataFrame, key: str = "artifact", content: str = "content") -> DataFrame:
    """artifact, member, size, data, status: entries of a one-file bundle, by the table of contents at its end."""
    magic, cookie = b"MEI\x0c\x0b\x0a\x0b\x0e", "!8sIIII64s"
    n_cookie = struct.calcsize(cookie)

    def one(data: bytes):
        at = (data or b"").rfind(magic)
        if at < 0 or at + n_cookie > len(data):
            return []
        _, length, toc, toc_length, _, _ = struct.unpack_from(cookie, data, at)
        begin = at + n_cookie - length
        out, pos, end = [], begin + toc, begin + toc + toc_length
        while 0 <= begin and pos + 18 <= min(end, len(data)) and len(out) < MAX_MEMBERS:
            size, offset, packed, full, flag, _ = struct.unpack_from("!IIIIBc", data, pos)
            if size < 18:
                break
            name = data[pos + 18 : pos + size].split(b"\0", 1)[0].decode("utf-8", "replace")
            body, status = data[begin + offset : begin + offset + packed], "read"
            if full > MAX_MEMBER:
                body, status = None, "size"
            elif flag:
                try:
                    body = zlib.decompressobj().decompress(body, MAX_MEMBER)
                except zlib.error:
                    body, status = None, "damaged"
            out.append((name, full, body, status))
            pos += size
        return out

    return _mapped(rows, one, "artifact string, member string, size long, data binary, status string", key, content)


def dex_strings(rows: DataFrame, key: str = "artifact", content: str = "content") -> DataFrame:
    """artifact, index, value: the string table of DEX files."""

    def one(data: bytes):
        if not (data or b"").startswith(b"dex\n") or len(data) < 64:
            return []
        count, table = struct.unpack_from("<II", data, 56)
        out = []
        for k in range(min(count, MAX_STRINGS)):
            if table + 4 * k + 4 > len(data):
                break
            pos = struct.unpack_from("<I", data, table + 4 * k)[0]
            while pos < len(data) and data[pos] & 0x80:
                pos += 1
            end = data.find(b"\0", pos + 1)
            if pos + 1 <= len(data) and end >= 0:
                raw = data[pos + 1 : end].replace(b"\xc0\x80", b"\0")
                out.append((k, raw.decode("utf-8", "surrogatepass" if b"\xed" in raw else "replace").encode("utf-16", "surrogatepass").decode("utf-16", "replace")[:MAX_CHARS]))
        return out

    return _mapped(rows, one, "artifact string, index long, value string", key, content)


def decompiler_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a decompiler's newline JSON: record_type, name, address, body_start, body_end, calls, content, references."""
    schema = "record_type string, tool string, version string, language string, name string, address string, body_start string, body_end string, calls array<string>, content string, decompile_completed boolean, references array<string>"
    return spark.read.schema(schema).json(path)


def export_edges(export: DataFrame) -> DataFrame:
    """src, kind, dst: calls to functions of a unique name, and strings by the function whose body has the reference."""
    from sigtrail.operators.joins import range_join, unique_match

    functions = export.filter("record_type = 'function'").withColumn("g", F.lit(1))
    calls = functions.select("g", F.col("name").alias("src"), F.explode("calls").alias("callee"))
    resolved = unique_match(calls, functions.select("g", F.col("name").alias("callee"), F.col("address").alias("target")), "g", "callee", "target")
    calls = resolved.filter("target is not null").select("src", F.lit("calls").alias("kind"), F.col("callee").alias("dst"))
    number = lambda c: F.conv(c, 16, 10).cast("long")
    refs = export.filter("record_type = 'string'").select("content", F.explode("references").alias("at")).select(F.lit(1).alias("g"), "content", number(F.col("at")).alias("at"))
    spans = functions.select("g", "name", number(F.col("body_start")).alias("lo"), number(F.col("body_end")).alias("hi"))
    uses = range_join(refs, spans, "g", "at", "lo", "hi", 4096).select(F.col("name").alias("src"), F.lit("strings").alias("kind"), F.col("content").alias("dst"))
    return calls.unionByName(uses).distinct()


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the source files below a folder, a file a row."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


class MissingColumns(ValueError):
    """A seed table lacks columns."""


def seed_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Rows of a CSV with a header, without blank rows; raises MissingColumns."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise MissingColumns(", ".join(missing))
    return df.filter(F.length(F.trim(F.concat_ws("", *required))) > 0)
