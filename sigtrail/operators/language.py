"""Kind of a source text or a file, by magic bytes and by words, as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes of file kinds, and patterns of source languages.
MAGIC = [("4D5A", "pe"), ("7F454C46", "elf"), ("504B0304", "zip"), ("6465780A", "dex"), ("25504446", "pdf"), ("CFFAEDFE", "macho"), ("FEEDFACF", "macho")]
LANGUAGES = [
    ("python", r"(?:^|[\n;])\s*(?:from\s+[A-Za-z_.]+\s+import|import\s+[A-Za-z_]+|def\s+[A-Za-z_]+\s*\()"),
    ("powershell", r"(?i)\$[a-z_]\w*\s*=.*(?:\b(?:invoke|get|set|new|start)-[a-z]+|\s-(?:eq|ne|match|join|bxor)\s)"),
    ("vbscript", r"(?i)\b(?:createobject|wscript\.shell|dim\s+\w+\s*$|on error resume next)"),
    ("javascript", r"\b(?:function\s*\w*\s*\(|(?:const|let|var)\s+\w+\s*=|require\(|=>\s*\{)"),
    ("shell", r"^#!\s*/(?:usr/)?bin/(?:env\s+)?(?:ba|z|da)?sh\b"),
]


def file_kind(content: Column) -> Column:
    """pe, elf, zip, dex, pdf, macho or unknown by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    out = F
    for magic, kind in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), kind)
    return out.otherwise("unknown")


def source_language(text: Column) -> Column:
    """The first language whose pattern the text has, else unknown."""
    out = F
    for name, pattern in LANGUAGES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("unknown")
