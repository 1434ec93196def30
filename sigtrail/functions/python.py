"""Functions that Spark has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\w+|[^\w\s]")
_SECRET = re.compile(r"(?i)(\b(?:api[_-]?key|token|secret|password|authorization)\b[\"']?\s*[:=]\s*[\"']?)([A-Za-z0-9_\-./+=]{8,})|(\bsk-[A-Za-z0-9_-]{8,})|(-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----)", re.S)


def _nfkc(text: str | None) -> str | None:
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).lower().split())


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """NFKC form in lower case, white space collapsed."""
    return x.map(_nfkc)


@lru_cache(1 << 18)
def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _simhash(text: str | None) -> int | None:
    if text is None:
        return None
    tokens = _TOKEN.findall(_nfkc(text))
    counts = Counter(tokens)
    counts.update(map(" ".join, zip(tokens, tokens[1:], strict=False)))
    hashes = np.fromiter(map(_token_hash, counts), "<u8", len(counts))
    weights = np.fromiter(counts.values(), np.float64, len(counts))
    ones = np.zeros(64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += weights[k : k + (1 << 14)] @ bits.astype(np.float64)
    value = sum(1 << k for k in np.flatnonzero(2 * ones >= weights.sum()).tolist()) if tokens else 0
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(T.LongType())
def simhash64(x: pd.Series) -> pd.Series:
    """64-bit SimHash of words, signs and their neighbours; 0 for no token."""
    return x.map(_simhash)


def _redact(text: str | None) -> tuple[str | None, int]:
    count = 0

    def place(m: re.Match) -> str:
        nonlocal count
        count += 1
        value = m[2] or m[3] or m[4]
        return f"{m[1] or ''}[REDACTED:{hashlib.sha256(value.encode('utf-8', 'surrogatepass')).hexdigest()[:12]}]"

    return (None, 0) if text is None else (_SECRET.sub(place, text), count)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))
def redact(x: pd.Series) -> pd.DataFrame:
    """The text with secrets replaced by placeholders that are the same for the same secret, and how many there were."""
    found = [_redact(v) for v in x]
    return pd.DataFrame({"text": [t for t, _ in found], "n": [n for _, n in found]})


#: What ends plain PowerShell code: a block comment, a line comment, a here-string, strings, an escape, or a quote left open.
_STRETCH = re.compile(r"<#|#[^\n]*|@(?P<here>['\"])(?=[ \t]*\r?\n)|'(?:[^']|'')*+'|\"(?:[^\"`]|`.|\"\")*+\"|`.?|['\"]", re.S)
_BLOCK_ENDS = re.compile("<#|#>")
_NO_BREAK = re.compile(r"[^\r\n]")


def _block_end(source: str, at: int) -> int | None:
    depth = 0
    for m in _BLOCK_ENDS.finditer(source, at):
        depth += 1 if m[0] == "<#" else -1
        if depth == 0:
            return m.end()
    return None


def _stretches(source: str) -> list[tuple[int, int, bool]] | None:
    """(start, stop, is comment) of what isn't code, in order; None if a comment or string is left open."""
    out, at = [], 0
    while m := _STRETCH.search(source, at):
        at = m.end()
        if m[0] == "<#":
            at = _block_end(source, m.start())
        elif m["here"]:
            close = re.compile(rf"(?m)^{m['here']}@(?=\s|\Z)").search(source, at)
            at = close and close.end()
        elif m[0] in ("'", '"'):
            at = None
        if at is None:
            return None
        out.append((m.start(), at, m[0][0] in "<#"))
    return out


def _powershell(source: str | None) -> dict | None:
    stretches = None if source is None else _stretches(source)
    if stretches is None:
        return None
    code, done = [], 0
    comments: list[tuple[int, int]] = []
    blocks: list[tuple[int, int]] = []
    for start, stop, is_comment in stretches:
        code += [source[done:start], _NO_BREAK.sub(" ", source[start:stop])]
        done = stop
        if is_comment:
            between = source[blocks[-1][1] : start] if blocks else "x"
            blocks.append((blocks.pop()[0], stop) if not between.strip() and between.count("\n") == 1 else (start, stop))
            comments.append((start, stop))
    code.append(source[done:])
    lines = source.splitlines()
    held = _lines_of(source, comments)
    return {
        "code": "".join(code), "comments": [source[a:b] for a, b in comments], "blocks": [(a, source[a:b]) for a, b in blocks], "n_lines": len(lines),
        "n_filled": sum(bool(x.strip()) for x in lines), "n_comment_lines": sum(k < len(lines) and bool(lines[k].strip()) for k in held),
    }


def _mask(source: str | None) -> tuple[str | None, list[str]]:
    """The code at its places and the comments; (None, []) where the source can't be told apart."""
    found = _powershell(source)
    return (found["code"], found["comments"]) if found else (None, [])


def _lines_of(source: str, spans: list[tuple[int, int]]) -> set[int]:
    """Numbers of the lines that the spans touch, in one pass."""
    starts = np.array([0, *(m.end() for m in re.finditer("\n", source))])
    places = np.array([(a, max(a, b - 1)) for a, b in spans], np.int64).reshape(-1, 2)
    return {k for a, b in (np.searchsorted(starts, places, "right") - 1).tolist() for k in range(a, b + 1)}


_POWERSHELL = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("comments", T.ArrayType(T.StringType())),
    T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]))),
    T.StructField("n_lines", T.IntegerType()), T.StructField("n_filled", T.IntegerType()), T.StructField("n_comment_lines", T.IntegerType()),
])


@F.pandas_udf(_POWERSHELL)
def mask_powershell(x: pd.Series) -> pd.DataFrame:
    """Code without comments, strings and escapes, at the same places; comments; comments of adjacent lines as one; counts of lines.

    All is null where the text is null or a comment or string is left open: what can't be told apart isn't judged.
    """
    found = [_powershell(v) or dict.fromkeys(_POWERSHELL.names) for v in x]
    return pd.DataFrame({c: pd.Series([r[c] for r in found], dtype="Int32" if c[:2] == "n_" else "object") for c in _POWERSHELL.names})


_BOMS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]


def _source(data: bytes | None) -> tuple[str | None, str | None, int]:
    mark, codec = next((b for b in _BOMS if (data or b"").startswith(b[0])), (b"", "utf-8"))
    try:
        text = (data or b"")[len(mark) :].decode(codec)
    except UnicodeDecodeError:
        return None, None, 0
    shown = sum(c.isprintable() or c in "\r\n\t" for c in text)
    return (text, codec, len(mark)) if text and "\0" not in text and shown >= 0.95 * len(text) else (None, None, 0)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("codec", T.StringType()), T.StructField("bom", T.IntegerType())]))
def source_text(x: pd.Series) -> pd.DataFrame:
    """The text of a source file by its byte order mark (UTF-8 without one); null if it can't be read, has a zero or is little printable."""
    return pd.DataFrame([_source(v) for v in x], columns=["text", "codec", "bom"])
