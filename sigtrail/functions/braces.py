"""Slices of sources with braces: what a slice makes of each state that it may begin in, and the tokens it has in a known one.

Slices end with lines, so a slice begins in code, in a block comment or in one of two kinds of quotes, and its effect is a
map of those four states. Maps can be put together without the texts; slices are then read on their own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa

CODE, BLOCK, DOUBLE, SINGLE = range(4)
# The line that opens a method, and words that look like its name.
MODIFIERS = "public|protected|private|static|final|abstract|synchronized|native|strictfp|default"
METHOD = re.compile(
    rf"[ \t]*(?:@[\w.$]+(?:\([^\n]*\))?[ \t]*)*(?:(?:{MODIFIERS})[ \t]+)*(?:<[^>{{}}\n]+>[ \t]+)?(?:[\w.$?<>\[\],]+[ \t]+)?"
    r"(?P<name>[A-Za-z_$][\w$]*)[ \t]*\([^;{}\n]*\)[ \t]*(?:throws[ \t]+[^{}\n]+)?\{"
)
NOT_METHODS = {"if", "for", "while", "switch", "catch", "synchronized"}
_STOPS = re.compile(r"//|/\*|[\"'{}]")
_ENDS = {BLOCK: re.compile(r"\*/"), DOUBLE: re.compile(r'\\[\s\S]|"'), SINGLE: re.compile(r"\\[\s\S]|'")}
_BEGINS = {"/*": BLOCK, '"': DOUBLE, "'": SINGLE}

SLICE = "n long, start long, line long, slice string, ends array<int>"
TOKEN = "n long, kind string, pos long, line long, begin long, name string, value string"
UNIT = "kind string, symbol string, start long, start_line long, end_line long, n_chars long, text string, owner long"


def tokens(text: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(kind, from, to): the braces in code and the double-quoted parts of the text, in order; last ("end", state, 0).

    A quoted part is a "string" if it begins and ends here, else "head", "tail" or, if it does neither, "middle".
    """
    at, began = 0, None
    while True:
        if state == CODE:
            m = _STOPS.search(text, at)
            if m is None:
                break
            at = m.end()
            if m[0] == "//":
                at = text.find("\n", at)
                if at < 0:
                    break
            elif m[0] in "{}":
                yield m[0], m.start(), at
            else:
                state, began = _BEGINS[m[0]], at
        else:
            m = _ENDS[state].search(text, at)
            if m is None:
                break
            at = m.end()
            if m[0][0] == "\\":
                continue
            if state == DOUBLE:
                yield ("tail", 0, m.start()) if began is None else ("string", began, m.start())
            state = CODE
    if state == DOUBLE:
        yield ("middle", 0, len(text)) if began is None else ("head", began, len(text))
    yield "end", state, 0


def end_state(text: str, state: int) -> int:
    return [t for t in tokens(text, state) if t[0] == "end"][0][1]


def slices(text: str, size: int) -> Iterator[tuple[int, int, int, str]]:
    """(number, offset, line from 1, slice): whole lines of at least size characters together."""
    n, at, line = 0, 0, 1
    while at < len(text) or not n:
        cut = text.find("\n", at + size - 1) + 1 or len(text)
        part = text[at:cut]
        yield n, at, line, part
        n, at, line = n + 1, cut, line + part.count("\n")


def units(text: str) -> Iterator[tuple]:
    """UNIT rows of a whole text: methods, strings with the smallest method around each, and what is outside of all methods."""
    opened, methods, found = [], [], []
    line, counted, tried, header = 1, 0, -1, None
    for kind, a, b in tokens(text, CODE):
        if kind == "end":
            break
        line, counted = line + text.count("\n", counted, a), a
        if kind == "{":
            first = text.rfind("\n", 0, a) + 1
            if first != tried:
                tried, header = first, METHOD.match(text, first)
            named = header is not None and header.end() == b and header["name"] not in NOT_METHODS
            opened.append((first, header["name"], line) if named else None)
        elif kind == "}":
            if opened and (begun := opened.pop()):
                methods.append((begun[0], a, *begun[1:], line))
        elif kind == "string" and b > a:
            found.append((a, b, line))
    at, owners = [a for a, _, _ in found], [None] * len(found)
    for begin, last, *_ in sorted(methods, key=lambda m: (m[0] - m[1], -m[0])):  # the smallest come last and stay
        i, j = bisect_left(at, begin), bisect_right(at, last)
        owners[i:j] = [begin] * (j - i)
    inside = reach = None
    for begin, last, name, start_line, end_line in sorted(methods):
        yield "method", name, begin, start_line, end_line, last - begin + 1, text[begin : last + 1], None
        if reach is None or begin > reach:
            inside = (inside or 0) + last - begin + 1
        reach = last if reach is None else max(reach, last)
    for (a, b, said), owner in zip(found, owners, strict=True):
        if owner is not None:
            yield "string", None, a, said, said, b - a, text[a:b], owner
    if inside is None or inside < len(text):
        yield "class" if inside is None else "class_structure", None, 0, 1, 1 + text.count("\n"), len(text) - (inside or 0), None, None


def unit_reader(keys: list[str]):
    """For mapInArrow: keys and text in, keys and UNIT out, in batches of some thousand units or a few MB of their texts."""

    def run(batches):
        for batch in batches:
            rows, chars = [], 0
            for r in _each(batch):
                for unit in units(r["text"]):
                    rows.append({**{k: r[k] for k in keys}, **dict(zip(_UNIT_NAMES, unit, strict=True))})
                    chars += len(unit[6] or "")
                    if len(rows) >= 4096 or chars >= 4_000_000:
                        yield _batch(rows, batch.schema, keys, _UNIT)
                        rows, chars = [], 0
            if rows:
                yield _batch(rows, batch.schema, keys, _UNIT)

    return run


def slicer(keys: list[str], size: int):
    """For mapInArrow: keys and text in, keys and SLICE out, in batches of 64 slices."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in _each(batch):
                for n, at, line, part in slices(r["text"], size):
                    rows.append({**{k: r[k] for k in keys}, "n": n, "start": at, "line": line, "slice": part, "ends": [end_state(part, s) for s in range(4)]})
                    if len(rows) >= 64:
                        yield _batch(rows, batch.schema, keys, _SLICE)
                        rows = []
            if rows:
                yield _batch(rows, batch.schema, keys, _SLICE)

    return run


def reader(keys: list[str]):
    """For mapInArrow: keys, SLICE and state in, keys and TOKEN out, in batches of some thousand tokens. Braces that open a method have its name and begin where its line does."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in _each(batch):
                if len(rows) >= 4096:
                    yield _batch(rows, batch.schema, keys, _TOKEN)
                    rows = []
                text, start, line, counted = r["slice"], r["start"], r["line"], 0
                tried, header = -1, None
                for kind, a, b in tokens(text, r["state"]):
                    if kind == "end":
                        continue
                    line, counted = line + text.count("\n", counted, a), a
                    row = {**{k: r[k] for k in keys}, "n": r["n"], "kind": kind, "pos": start + a, "line": line, "begin": None, "name": None, "value": None}
                    if kind == "{":
                        first = text.rfind("\n", 0, a) + 1
                        if first != tried:
                            tried, header = first, METHOD.match(text, first)
                        if header is not None and header.end() == b and header["name"] not in NOT_METHODS:
                            row |= {"begin": start + first, "name": header["name"]}
                    elif kind != "}":
                        row["value"] = text[a:b]
                    rows.append(row)
            yield _batch(rows, batch.schema, keys, _TOKEN)

    return run


_SLICE = [("n", pa.int64()), ("start", pa.int64()), ("line", pa.int64()), ("slice", pa.string()), ("ends", pa.list_(pa.int32()))]
_TOKEN = [("n", pa.int64()), ("kind", pa.string()), ("pos", pa.int64()), ("line", pa.int64()), ("begin", pa.int64()), ("name", pa.string()), ("value", pa.string())]
_UNIT = [
    ("kind", pa.string()), ("symbol", pa.string()), ("start", pa.int64()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("n_chars", pa.int64()), ("text", pa.string()), ("owner", pa.int64()),
]
_UNIT_NAMES = [name for name, _ in _UNIT]


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time: only one text is a Python object at once."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _batch(rows: list[dict], given: pa.Schema, keys: list[str], own: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([*(given.field(k) for k in keys), *own]))


def entry_states(keys: list[str]):
    """For applyInPandas: the maps of one file's slices in, keys, n and the state that each slice begins in out."""

    def run(pdf):
        pdf = pdf.sort_values("n")
        state, out = CODE, []
        for ends in pdf["ends"]:
            out.append(state)
            state = int(ends[state])
        return pdf[[*keys, "n"]].assign(state=out)

    return run
