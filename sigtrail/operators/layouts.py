"""Sections of PE and ELF files, and the texts in them that a pointer with a length beside it names exactly.

Files are data: headers are read as bytes, nothing is loaded or run. Numbers of a header are decimals, as addresses take 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.operators.assess import natural_prompt
from sigtrail.operators.locate import places
from sigtrail.operators.store import written

# Limits of headers and literals, and how an instruction in a pool of texts begins.
ELF_SECTIONS, PE_SECTIONS = 4096, 96
LEAST, MOST, EXCERPT = 32, 32768, 2048
OPENING = r"(?i)(?:You are (?:an? |the )[^\x00-\x1f]{1,80}(?:generator|validator|expert)|Generate a (?:Lua |Python |PowerShell )?(?:script|code))"
WINDOW_END = r"[\x00-\x08\x0b\x0c\x0e-\x1f]|[0-9a-fA-F]{40,}"

#: Bytes of a section that are one row of the scan for pointers, and bytes of addresses that are one key of the join.
PIECE, PAGE = 1 << 16, 1 << 16
#: Bytes of a piece that are asked at once whether they hold zeros, a multiple of both widths of a word.
BLOCK = 128
SECTION = "struct<ordinal:int,start:decimal(20,0),size:decimal(20,0),address:decimal(21,0),executable:boolean>"


def _place(x: Column) -> Column:
    """A number as a place in a file; one past every file where it is too large or null."""
    return F.least(x, F.lit(2**31 - 4096)).cast("int")


def number(content: Column, at: Column, width: int) -> Column:
    """The unsigned little-endian number of width bytes at a place; null where the file ends before."""
    octets = F.regexp_extract_all(F.hex(F.substring(content, _place(at) + 1, F.lit(width))), F.lit(".."), F.lit(0))
    return F.when(F.size(octets) == width, F.conv(F.array_join(F.reverse(octets), ""), 16, 10).cast("decimal(20,0)"))


def _bit(content: Column, at: Column, bit: int) -> Column:
    return number(content, at, 1).cast("int").bitwiseAND(bit) != 0


def computed(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """keep and columns, computed once: filters above aren't pushed below with all of the expressions that they speak of."""
    return df.select(*keep, F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def layouts(files: DataFrame, key: str = "artifact", content: str = "content") -> DataFrame:
    """key, content, width (bytes of a pointer), sections, reason (null if the sections are good, else why there are none).

    Sections that aren't loaded from the file are left out. A null or empty file is an unsupported layout, a header that the
    file's end cuts is truncated. Other columns are left out.
    """
    c = F.col(content)
    d = files.select(key, c.alias("content"))
    c, at = F.col("content"), lambda x: F.lit(x)
    is_pe, elf, pe = F.hex(F.substring(c, 1, 2)) == "4D5A", F.col("elf"), F.col("pe")
    d = computed(d, [key, "content"], {"n": F.octet_length(c), "elf": F.hex(F.substring(c, 1, 4)) == "7F454C46", "pe": F.when(is_pe, number(c, at(60), 4))})
    wide, narrow = F.col("magic") == 0x20B, F.col("magic") == 0x10B
    d = computed(d, [key, "content", "n", "elf", "pe"], {
        "magic": number(c, pe + 24, 2), "count": F.when(elf, number(c, at(60), 2)).otherwise(number(c, pe + 6, 2)),
        "table": F.when(elf, number(c, at(40), 8)).otherwise(pe + 24 + number(c, pe + 20, 2)), "stride": F.when(elf, number(c, at(58), 2)).otherwise(F.lit(40).cast("decimal(20,0)")),
    })
    d = computed(d, [key, "content", "n", "elf", "pe", "count", "table", "stride"], {
        "width": F.when(elf | wide, 8).when(narrow, 4), "base": F.when(wide, number(c, pe + 48, 8)).when(narrow, number(c, pe + 52, 4)),
    })
    count, table, stride = F.col("count"), F.col("table"), F.col("stride")
    header = (
        F.when(c.isNull() | ~(elf | is_pe), "unsupported_binary_layout")
        .when(elf & (F.hex(F.substring(c, 5, 2)) != "0201"), "unsupported_elf_layout")
        .when(is_pe & (pe.isNull() | (F.hex(F.substring(c, _place(pe) + 1, F.lit(4))) != "50450000")), "invalid_pe_signature")
        .when(is_pe & (F.col("width").isNull() | (count > PE_SECTIONS)), "unsupported_pe_layout")
        .when(table.isNull() | count.isNull() | stride.isNull() | (is_pe & F.col("base").isNull()), "truncated")
        .when(elf & ((stride < 64) | (count > ELF_SECTIONS) | (table + stride * count > F.col("n"))), "invalid_elf_section_table")
    )
    d = computed(d, [key, "content", "n", "elf", "width", "base", "count", "table", "stride"], {"reason": header})

    def section(i: Column) -> Column:
        p = table + stride * i.cast("decimal(6,0)")
        of = lambda e, w: F.when(elf, e).otherwise(w)
        loaded = of((number(c, p + 4, 4) != 8) & _bit(c, p + 8, 2), F.lit(True))
        start, size = of(number(c, p + 24, 8), number(c, p + 20, 4)), of(number(c, p + 32, 8), number(c, p + 16, 4))
        address = of(number(c, p + 16, 8), F.col("base") + number(c, p + 12, 4))
        executable = of(_bit(c, p + 8, 4), _bit(c, p + 39, 0x20))
        return F.struct(F.when(loaded | loaded.isNull(), i).alias("ordinal"), start.alias("start"), size.alias("size"), address.alias("address"), executable.alias("executable")).cast(SECTION)

    read = F.when(F.col("reason").isNull() & (count > 0), F.filter(F.transform(F.sequence(F.lit(0), count.cast("int") - 1), section), lambda s: s["ordinal"].isNotNull()))
    none = F.array().cast(f"array<{SECTION}>")
    d = computed(d, [key, "content", "n", "elf", "width", "reason"], {"sections": F.coalesce(read, none)})
    cut = F.exists("sections", lambda s: s["start"].isNull() | s["size"].isNull() | s["address"].isNull() | s["executable"].isNull())
    outside = F.exists("sections", lambda s: s["start"] + s["size"] > F.col("n"))
    d = computed(d, [key, "content", "width", "sections"], {"reason": F.coalesce("reason", F.when(cut, "truncated"), F.when(outside, F.when(F.col("elf"), "invalid_elf_section").otherwise("invalid_pe_section")))})
    good = F.col("reason").isNull()
    return computed(d, [key, "content"], {"width": F.when(good, F.col("width")), "sections": F.when(good, F.col("sections")).otherwise(none), "reason": F.col("reason")})


def sections(laid: DataFrame, key: str = "artifact") -> DataFrame:
    """key, ordinal, start, size, address, executable: a row for each loaded section of what layouts gives."""
    return laid.select(key, F.inline_outer("sections")).filter(F.col("ordinal").isNotNull()).withColumn("start", F.col("start").cast("long")).withColumn("size", F.col("size").cast("long"))


def _pointers(laid: DataFrame, key: str, most: int) -> DataFrame:
    """key, ordinal, start, size, address, first, found: each loaded section in pieces, of which one has first, and the descriptors in a piece.

    A section of data is cut into rows of PIECE bytes, so that memory follows the piece, and those into blocks of BLOCK bytes. A
    length's upper bytes are zero: words are read only in blocks that hold so many zeros, and as numbers only where they are it.
    """
    w = F.col("width")
    part = laid.select(key, "width", "content", F.inline_outer("sections")).filter(F.col("ordinal").isNotNull())
    part = part.withColumn("start", F.col("start").cast("long")).withColumn("size", F.col("size").cast("long"))
    first, end = (F.ceil(F.col("start") / w) * w).cast("long"), F.col("start") + F.col("size")
    part = part.withColumn("begin", first).withColumn("end", end).withColumn("data", ~F.col("executable") & (F.col("begin") + 2 * w <= F.col("end")))
    cuts = F.when(F.col("data"), F.sequence(F.col("begin"), F.greatest("begin", F.col("end") - 2 * w), F.lit(PIECE).cast("long")))
    keep = [key, "ordinal", "start", "size", "address", "begin", "width"]
    part = part.select(*keep, "content", "end", F.explode_outer(cuts).alias("from"))
    piece = F.substring(F.col("content"), F.col("from").cast("int") + 1, F.least(F.col("end") - F.col("from"), F.lit(PIECE).cast("long") + w).cast("int"))
    part = computed(part, [*keep, "from"], {"bytes": piece})
    octets = (most.bit_length() + 7) // 8
    zero = F.substring(F.lit(bytearray(8)), F.lit(1), w - octets)
    word = lambda at: F.when(w == 8, number(F.col("bytes"), at, 8)).otherwise(number(F.col("bytes"), at, 4))
    last = F.octet_length("bytes") - 2 * w
    blocks = F.filter(F.sequence(F.lit(0), last, F.lit(BLOCK)), lambda at: F.contains(F.substring(F.col("bytes"), at + w + octets + 1, F.lit(BLOCK - octets)), zero))
    words = F.flatten(F.transform(blocks, lambda at: F.sequence(at, F.least(at + BLOCK - w, last), w)))
    short = F.filter(words, lambda at: F.substring(F.col("bytes"), at + w + octets + 1, w - octets) == zero)
    found = F.transform(short, lambda at: F.struct((F.col("from") + at).alias("descriptor"), word(at).alias("address"), number(F.col("bytes"), at + w, octets).cast("long").alias("length")))
    kept = F.when(F.col("from").isNotNull(), F.filter(found, lambda x: x["length"].between(LEAST, most)))
    return part.select(key, "ordinal", "start", "size", "address", (F.col("from").isNull() | (F.col("from") == F.col("begin"))).alias("first"), kept.alias("found"))


def descriptors(laid: DataFrame, key: str = "artifact", most: int = MOST) -> DataFrame:
    """key, descriptor, address, length: aligned pairs of words in sections of data whose second is LEAST to most."""
    # outer: for others the optimizer asks for a size first, with all of the expression once more
    return _pointers(laid, key, most).select(key, F.inline_outer("found")).filter(F.col("length").isNotNull())


def literals(laid: DataFrame, key: str = "artifact", most: int = MOST) -> DataFrame:
    """key, offset, length, descriptor: each text of LEAST to most bytes that a pointer and a length in a section of data name.

    Files are read once, for a table of sections and pointers. Pointers meet sections by pages of addresses, an equi-join on (key,
    page); the text must end inside its section. A place has as many rows as descriptors. Null keys have none. The section that
    a pointer means is the first in the file that holds the place, if sections overlap.
    """
    known = written(_pointers(laid, key, most), "pointers")
    holds = known.filter("first AND size > 0").select(key, "ordinal", "start", "size", "address")
    page = lambda x: F.floor(x / PAGE).cast("long")
    holds = holds.withColumn("page", F.explode_outer(F.sequence(page(F.col("address")), page(F.col("address") + F.col("size") - 1))))
    points = known.select(key, F.inline("found")).withColumn("page", page(F.col("address"))).withColumnRenamed("address", "to")
    inside = (F.col("to") >= F.col("address")) & (F.col("to") + F.col("length") <= F.col("address") + F.col("size"))
    named = points.join(holds, [key, "page"]).filter(inside).withColumn("offset", (F.col("start") + F.col("to") - F.col("address")).cast("long"))
    nearest = F.row_number().over(Window.partitionBy(key, "offset", "descriptor").orderBy("ordinal"))
    return named.withColumn("_n", nearest).filter("_n = 1").select(key, "offset", "length", "descriptor")


def literal_windows(laid: DataFrame, key: str = "artifact", most: int = MOST) -> DataFrame:
    """key, offset, byte_length, descriptor, method, boundary, completeness, text, source_span_hash of instructions in files.

    Where OPENING matches, the exact literals there that are natural instructions; if there are none, an excerpt of at most
    EXCERPT bytes that ends before control characters or a long run of digits: evidence of a place, never a whole text. Bytes
    that are no UTF-8 make a literal fail and are left out of an excerpt (replacement characters as well). One row a key.
    """
    c = F.col("content")
    told = computed(laid, [key, "content"], {"_bytes": F.decode(c, "ISO-8859-1")}).withColumn("_low", F.lower("_bytes"))
    may = F.contains("_low", F.lit("you are ")) | F.contains("_low", F.lit("generate a "))
    told = told.select(key, "content", F.explode_outer(F.when(may, places(F.col("_bytes"), OPENING, 1 << 30))).alias("m")).filter(F.col("m").isNotNull())
    at = told.select(key, F.col("m.at").cast("long").alias("offset"), F.substring(c, F.col("m.at") + 1, F.lit(max(most, EXCERPT))).alias("_rest"))
    raw = F.substring(F.col("_rest"), F.lit(1), F.col("length").cast("int"))
    text = raw.cast("string")
    exact = at.join(literals(laid, key, most), [key, "offset"], "left").withColumn("text", F.when(F.is_valid_utf8(text) & natural_prompt(text), text))
    have = F.max(F.col("text").isNotNull()).over(Window.partitionBy(key, "offset"))
    nth = F.row_number().over(Window.partitionBy(key, "offset").orderBy(F.col("text").isNull(), "length", "descriptor"))
    rows = exact.withColumn("_exact", have).withColumn("_n", nth).filter((F.col("_exact") & F.col("text").isNotNull()) | (~F.col("_exact") & (F.col("_n") == 1)))
    shown = F.substring(F.col("_rest"), F.lit(1), F.lit(EXCERPT))
    cut = F.octet_length(F.encode(F.element_at(F.split(F.decode(shown, "ISO-8859-1"), WINDOW_END, 2), 1), "ISO-8859-1"))
    rows = rows.withColumn("_raw", F.when(F.col("_exact"), raw).otherwise(F.substring(F.col("_rest"), F.lit(1), cut)))
    loose = F.replace(F.make_valid_utf8(F.col("_raw").cast("string")), F.lit("�"), F.lit(""))
    rows = rows.withColumn("text", F.when(F.col("_exact"), F.col("text")).otherwise(loose)).filter(F.col("_exact") | natural_prompt(F.col("text")))
    of = lambda a, b: F.when(F.col("_exact"), a).otherwise(b)
    return rows.select(
        key, "offset", F.octet_length("_raw").cast("long").alias("byte_length"), F.when(F.col("_exact"), F.col("descriptor")).alias("descriptor"), of("go_string_input", "binary_instruction_window").alias("method"),
        of("pointer_length_descriptor", "uncertain_window").alias("boundary"), of("string_constant", "excerpt_only").alias("completeness"), "text", F.sha2("_raw", 256).alias("source_span_hash"),
    )
