"""Layouts, pointers and instructions of made files, against a plain reading of all words."""

import random
import struct

from pyspark.sql import functions as F
from sigtrail.operators import layouts as L

PROMPT = b"You are an expert code generator. Return only the code for "


def elf(parts, stride=64, tail=b""):
    """parts: (kind, flags, address, bytes or a claimed size)."""
    body, rows, at = b"", [], 64 + stride * len(parts)
    for kind, flags, address, data in parts:
        size = data if isinstance(data, int) else len(data)
        rows.append(struct.pack("<IIQQQQ", 0, kind, flags, address, at + len(body), size).ljust(stride, b"\0"))
        body += b"" if isinstance(data, int) else data
    head = b"\x7fELF\x02\x01".ljust(40, b"\0") + struct.pack("<Q", 64) + b"\0" * 10 + struct.pack("<HH", stride, len(parts)) + b"\0\0"
    return head + b"".join(rows) + body + tail


def pe(width, sections, signature=b"PE\0\0", magic=None):
    base, optional = 0x10000, 32
    at, body, rows = 88 + optional + 40 * len(sections), b"", []
    for address, data, flags in sections:
        rows.append(b".x".ljust(8, b"\0") + struct.pack("<IIII", len(data), address, len(data), at + len(body)) + b"\0" * 12 + struct.pack("<I", flags))
        body += data
    own = (magic or (0x20B if width == 8 else 0x10B)).to_bytes(2, "little")
    own = own.ljust(24, b"\0") + struct.pack("<Q", base) if width == 8 else own.ljust(28, b"\0") + struct.pack("<I", base)
    head = b"MZ".ljust(60, b"\0") + struct.pack("<I", 64) + signature + struct.pack("<HH", 0, len(sections)) + b"\0" * 12 + struct.pack("<H", optional) + b"\0\0"
    return head + own + b"".join(rows) + body


def files(spark, made):
    return spark.createDataFrame([(k, None if v is None else bytearray(v), 1) for k, v in made.items()], "artifact string, content binary, width int").select("artifact", "content", F.col("width"))


def test_layouts_and_reasons(spark):
    good = elf([(0, 0, 0, 0), (1, 6, 0x1000, b"c" * 16), (8, 3, 0x9000, 1 << 40), (1, 2, 2**63, b"d" * 16)])
    made = {
        "elf": good, "pe64": pe(8, [(0x100, b"x" * 10, 0x20000000), (0x200, b"y" * 20, 0x40000000)]), "pe32": pe(4, [(0x100, b"x" * 10, 0)]), "null": None, "empty": b"", "text": b"hello world", "cut": good[:100],
        "class": b"\x7fELF\x01\x01" + good[6:], "long": elf([(1, 2, 0, 1 << 50)]), "huge": elf([(1, 2, 0, 2**64 - 1)]), "stride": elf([(1, 2, 0, b"z")], 64)[:58] + b"\x20\x00" + elf([(1, 2, 0, b"z")])[60:], "sign": pe(8, [], b"PX\0\0"),
        "magic": pe(8, [], magic=0x107), "mz": b"MZ", "cutpe": pe(8, [(0x100, b"", 0)])[:150], "none": elf([]), "elfhead": b"\x7fELF\x02\x01",
    }
    rows = {r.artifact: r for r in L.layouts(files(spark, made)).collect()}
    reasons = {k: r.reason for k, r in rows.items()}
    assert reasons == {
        "elf": None, "pe64": None, "pe32": None, "none": None, "null": "unsupported_binary_layout", "empty": "unsupported_binary_layout", "text": "unsupported_binary_layout", "cut": "invalid_elf_section_table", "class": "unsupported_elf_layout",
        "long": "invalid_elf_section", "huge": "invalid_elf_section", "stride": "invalid_elf_section_table", "sign": "invalid_pe_signature", "magic": "unsupported_pe_layout", "mz": "invalid_pe_signature", "cutpe": "truncated", "elfhead": "truncated",
    }
    assert [(int(s.address), int(s.size), s.executable) for s in rows["elf"].sections] == [(0x1000, 16, True), (2**63, 16, False)]
    assert [(int(s.address), s.executable) for s in rows["pe64"].sections] == [(0x10100, True), (0x10200, False)] and rows["pe32"].width == 4 and rows["none"].sections == []
    assert L.layouts(files(spark, {"a": b""}).limit(0)).count() == 0


def test_literals_against_plain_reading(spark):
    draw = random.Random(2)
    made, expected = {}, set()
    for n in range(12):
        pool, wide = draw.randbytes(3000), n % 3 < 2
        w, form, top = (8, "<Q", draw.choice([0x400000, 2**63 + 2**40])) if wide else (4, "<I", 0x20000)
        target = top if n % 3 == 0 else 0x10000 + 0x20000
        words = [x for _ in range(40) for x in (target + draw.randrange(-20, 3020), draw.choice([8, 31, 32, 100, 2900, 40000, 0]))]
        data = draw.randbytes(draw.randrange(9)) + b"".join(struct.pack(form, x) for x in words)
        size = 64 + 64 * 3 if n % 3 == 0 else 88 + 32 + 80
        pool = pool + b"\0" * (-(size + len(pool) + len(data)) % w) if n % 4 else pool
        made[f"f{n}"] = elf([(0, 0, 0, 0), (1, 2, target, pool), (1, 3, 0x7000000, data)]) if n % 3 == 0 else pe(w, [(0x20000, pool, 0x40000000), (0x700000, data, 0)])
        whole = made[f"f{n}"]
        for start, long in ((size, len(pool)), (size + len(pool), len(data))):
            for at in range(start, start + long - 2 * w + 1):
                if at % w == 0:
                    to, length = struct.unpack_from(form, whole, at)[0], struct.unpack_from(form, whole, at + w)[0]
                    if 32 <= length <= L.MOST and target <= to and to + length <= target + len(pool):
                        expected.add((f"f{n}", size + to - target, length, at))
    got = [tuple(r) for r in L.literals(L.layouts(files(spark, made))).select("artifact", "offset", "length", "descriptor").collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len({x[0] for x in got}) > 6


def test_large_section_and_windows(spark):
    text = PROMPT + "é".encode() * 40
    pool = b"\0" * 200_000 + text + b"\x01" + text + b"\0"
    data = struct.pack("<QQ", 0x400000 + 200_000, len(text)) * 2 + struct.pack("<QQ", 0x400000 + 200_000, len(text) - 1) + struct.pack("<QQ", 0x400000 + 200_000, 33)
    zeros = b"\0" * 100_000 + data
    made = {"a": elf([(1, 2, 0x400000, pool), (1, 3, 0x900000, zeros)]), "b": b"junk" + text + b"\x02 hidden", "c": PROMPT[:20] + b"\xff", "d": PROMPT + b"\xc3" + b"0" * 50, "e": None}
    rows = L.literal_windows(L.layouts(files(spark, made))).collect()
    first = 64 + 128 + 200_000
    exact, window = "go_string_input", "binary_instruction_window"
    expected = [
        ("a", first, 33, exact, text[:33]), ("a", first, len(text), exact, text), ("a", first, len(text), exact, text), ("a", first + len(text) + 1, len(text), window, text),
        ("b", 4, len(text), window, text), ("d", 0, len(PROMPT) + 1, window, PROMPT),
    ]
    assert sorted((r.artifact, r.offset, r.byte_length, r.method, r.text.encode()) for r in rows) == sorted(expected)
