"""Queries over files made of each document: ELF and PE layouts with the whole text in a pool, and pointers with lengths to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtrail.operators import assess as A
from sigtrail.operators import layouts as L
from sigtrail.operators import reclustering as R
from sigtrail.operators.store import written
from sigtrail.plans.assessments import _has
from sigtrail.plans.planted import planted, with_planted
from sigtrail.plans.relations import _facts

#: Bytes before the pool of texts, and the address of a file's first byte; a document's kind of file is its id modulo 4.
POOL, BASE = 320, 0x400000
OPEN = "You are an expert code generator. Return only the code. "
#: What the file tells: the text behind the opening, both without bytes of control.
_TEXT = "concat('" + OPEN + "', regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' '{g}))"
KINDS = ["elf", "pe64", "pe32", "none"]


def _little(x, width: int):
    digits = F.lpad(F.hex(x.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width)))))


def _fixed(text: str):
    return F.lit(bytearray.fromhex(text))


def _number(x: int, width: int):
    return F.lit(bytearray(x.to_bytes(width, "little")))


def _files(spark, sf_dir):
    """artifact, content: the pool is 8 bytes and the text; behind it, aligned, come pairs of words and one text too short."""
    docs = planted(spark, sf_dir).select("artifact", "doc_id", F.encode(F.expr(_TEXT.format(g="").replace("\\", "\\\\")), "UTF-8").alias("t")).withColumn("n", F.octet_length("t"))
    data = ((F.lit(POOL + 8 + 7) + F.col("n")) / 8).cast("long") * 8
    docs = L.computed(docs, ["artifact", "doc_id", "t", "n"], {"data": data})

    def pairs(w):
        at = F.lit(BASE + POOL + 8)
        words = [at, F.col("n"), at, F.lit(8), at + 4, F.col("n") - 4, at, F.col("n") + 4096, F.lit(16), F.lit(64)]
        return F.concat(*(_little(x, w) for x in words))

    def pool(head, w):
        pad = F.unhex(F.repeat(F.lit("00"), (F.col("data") - POOL - 8 - F.col("n")).cast("int")))
        return F.concat(head, _fixed("00" * 8), F.col("t"), pad, pairs(w))

    def elf_section(kind, flags, start, size):
        return F.concat(_number(0, 4), _number(kind, 4), _number(flags, 8), _little(start + BASE, 8), _little(start, 8), _little(size, 8), _number(0, 24))

    def pe_section(flags, start, size):
        return F.concat(_fixed("2e" + "00" * 7), _little(size, 4), _little(start, 4), _little(size, 4), _little(start, 4), _number(0, 12), _number(flags, 4))

    code, texts = (F.lit(0), F.lit(64)), (F.lit(POOL), F.col("n") + 8)
    words = lambda w: (F.col("data"), F.lit(10 * w))
    elf = F.concat(
        _fixed("7f454c460201" + "00" * 34), _number(64, 8), _fixed("00" * 10), _number(64, 2), _number(4, 2), _number(0, 2),
        elf_section(8, 2, F.lit(0), F.lit(1 << 40)), elf_section(1, 6, *code), elf_section(1, 2, *texts), elf_section(1, 3, *words(8)),
    )

    def pe(w):
        magic, base = (0x20B, _fixed("00" * 22) + _number(BASE, 8)) if w == 8 else (0x10B, None)
        optional = F.concat(_number(magic, 2), _fixed("00" * 22), _number(BASE, 8)) if w == 8 else F.concat(_number(magic, 2), _fixed("00" * 26), _number(BASE, 4))
        head = F.concat(_fixed("4d5a" + "00" * 58), _number(64, 4), _fixed("50450000" + "0000"), _number(3, 2), _fixed("00" * 12), _number(32, 2), _fixed("0000"), optional)
        rows = F.concat(pe_section(0x60000020, *code), pe_section(0x40000040, *texts), pe_section(0xC0000040, *words(w)))
        return F.concat(head, rows, _fixed("00" * (POOL - 240)))

    kind = F.col("doc_id") % 4
    content = F.when(kind == 0, pool(elf, 8)).when(kind == 1, pool(pe(8), 8)).when(kind == 2, pool(pe(4), 4)).otherwise(F.concat(_fixed("ca" * POOL), _fixed("00" * 8), F.col("t")))
    return L.computed(docs, ["artifact"], {"content": content})


def pointer_literals(spark, sf_dir):
    files = _files(spark, sf_dir)
    found = L.literals(L.layouts(files))
    text = found.join(files, "artifact").withColumn("raw", F.substring(F.col("content"), F.col("offset").cast("int") + 1, F.col("length").cast("int")))
    return text.select("artifact", "offset", "length", "descriptor", F.sha2("raw", 256).alias("text_sha256"))


def file_layouts(spark, sf_dir):
    laid = L.layouts(_files(spark, sf_dir))
    return laid.select("artifact", "width", "reason", F.size("sections").alias("n_sections"), F.aggregate("sections", F.lit(0).cast("long"), lambda s, x: s + x["size"].cast("long")).alias("n_bytes"))


def literal_windows(spark, sf_dir):
    rows = L.literal_windows(L.layouts(_files(spark, sf_dir)))
    return rows.filter(F.col("method") == "go_string_input").select("artifact", "offset", "byte_length", "descriptor", "method", "boundary", "completeness", F.sha2("text", 256).alias("text_sha256"))


def incremental_clusters(spark, sf_dir):
    """Clusters of all artifacts with facts after three batches: a third each, and a third of those before once more."""
    import uuid

    from sigtrail.operators.store import shared_folder

    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    facts = written(_facts(spark, sf_dir), "facts").withColumn("part", F.pmod(F.xxhash64("artifact"), F.lit(9)))
    for batch in range(3):
        R.add_batch(facts.filter((F.floor(F.col("part") / 3) == batch) | ((F.col("part") % 3 == 0) & (F.col("part") < 3 * batch))), folder, batch)
    return R.current_clusters(spark, folder)


QUERIES = {"q_pointer_literals": pointer_literals, "q_file_layouts": file_layouts, "q_literal_windows": literal_windows, "q_incremental_clusters": incremental_clusters}

_MADE = f"""made AS (SELECT artifact, doc_id % 4 AS kind, CASE doc_id % 4 WHEN 2 THEN 4 ELSE 8 END AS w, t, octet_length(encode(t)) AS n, ({POOL} + 15 + octet_length(encode(t))) // 8 * 8 AS data
  FROM (SELECT artifact, doc_id, {_TEXT.format(g=", 'g'")} AS t FROM planted))"""
_FOUND = f"""SELECT artifact, {POOL + 8}::BIGINT AS offset, n::BIGINT AS length, data::BIGINT AS descriptor, sha256(t) AS text_sha256 FROM made WHERE kind < 3 AND n BETWEEN {L.LEAST} AND {L.MOST}"""
ORACLE_SQL = {
    "q_pointer_literals": with_planted(
        f"""{_MADE} {_FOUND}
UNION ALL SELECT artifact, {POOL + 12}, n - 4, data + 4 * w, sha256(substr(t, 5)) FROM made WHERE kind < 3 AND n - 4 BETWEEN {L.LEAST} AND {L.MOST}"""
    ),
    "q_file_layouts": with_planted(
        f"""{_MADE} SELECT artifact, CASE WHEN kind < 3 THEN w END AS width, CASE WHEN kind = 3 THEN 'unsupported_binary_layout' END AS reason, CASE WHEN kind < 3 THEN 3 ELSE 0 END AS n_sections, CASE WHEN kind < 3 THEN 64 + n + 8 + 10 * w ELSE 0 END::BIGINT AS n_bytes FROM made"""
    ),
    "q_literal_windows": with_planted(
        f"""{_MADE} SELECT artifact, "offset", length AS byte_length, descriptor, 'go_string_input' AS method, 'pointer_length_descriptor' AS boundary, 'string_constant' AS completeness, text_sha256
FROM ({_FOUND.replace("AS text_sha256", "AS text_sha256, t")}) WHERE NOT {_has("t", A.SECRET)}"""
    ),
}
