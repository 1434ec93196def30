"""PowerShell sources: recognition by several signals, lexical metrics, and comments that address an analyser.

A source is a row of key and content (bytes). The lexer runs in Arrow batches; all that follows are column expressions of the
row, so nothing is shuffled. Sources over 256 KiB, binaries, and texts with an open comment or string are not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.functions import python as P

# Limits, signals and wording that results depend on.
MAX_SOURCE_BYTES, MAX_COMMENT_CHARS, MAX_CANDIDATES = 262144, 8192, 100
BINARY_STARTS = ["4D5A", "7F454C46", "CFFAEDFE", "FEEDFACF"]
BINARY_TYPES = ["pe32", "elf", "mach-o", "ms-dos"]
VARIABLE = r"\$(?:\{([A-Za-z_][\w:]*)\}|([A-Za-z_][\w:]*))"
BUILTIN = ["true", "false", "null", "_", "psitem", "args", "input"]
ASSIGNMENT = r"(?m)^\s*\$(?:\{[A-Za-z_][\w:]*\}|[A-Za-z_][\w:]*)\s*=(?!=)"
SIGNALS = {
    "cmdlet": r"(?i)\b(?:New-Object|Invoke-Expression|Write-Output|Get-Content|Get-Process|Out-String|Set-Content)\b",
    "operator": r"(?i)(?<![\w-])-(?:replace|match|notmatch|eq|ne|like|notlike|contains|join|split)\b",
    "dotnet_type": r"(?i)\b(?:System\.(?:Net|IO|Text|Collections)|IO\.(?:StreamReader|StreamWriter))\b",
    "pipeline_cmdlet": r"(?i)\|\s*(?:Out-String|Write-Output|Where-Object|ForEach-Object)\b",
    "typed_assignment": r"(?im)^\s*\$\w+\s*=\s*\[(?:int|string|bool|byte\[\])\]",
}
FUNCTION = r"(?im)^\s*(?:function|filter)\s+[\w:-]+\s*(?:\([^\n]*\))?\s*\{"
HANDLER = r"(?i)\bcatch\s*(?:\[[^\]\n]+\]\s*)?\{"
ADDRESS = (
    r"(?im)^[ \t]*(?:\#[ \t]*|<\#[ \t]*)?(?:"
    r"(?:for|to|attention)\s+(?:the\s+)?(?:LLMs?|AI|large language models?)"
    r"(?:[ \t]+(?:and[ \t]+(?:AI|LLMs?)|(?:security[ \t]+)?(?:analysts?|analy[sz]ers?|assistants?)))*[ \t]*[:：]"
    r"|(?:面向|致|给)(?:AI|LLM|大模型|人工智能)(?:分析器|分析系统|分析助手)?[ \t]*[:：])"
)
SKIP_ANALYSIS = (
    r"(?i)^\s*(?:\#\s*)?(?:please\s+)?(?:"
    r"(?:do not|don't|never)\s+(?:analy[sz]e|scan|inspect)\s+(?:this|the)\s+(?:file|script|code|program)"
    r"|there is no need to\s+(?:analy[sz]e|scan|inspect)\s+(?:this|the)\s+(?:file|script|code|program)"
    r"|skip\s+(?:security\s+)?analysis\s+of\s+(?:this|the)\s+(?:file|script|code|program)"
    r"|(?:请)?(?:不要|无需|跳过)(?:安全)?(?:分析|检查|扫描)(?:此|本|该|这个)(?:文件|脚本|代码|程序))"
)
FORCE_BENIGN = (
    r"(?i)^\s*(?:\#\s*)?(?:please\s+)?(?:"
    r"(?:mark|classify|treat|report|label)\s+(?:(?:this|the)\s+(?:file|script|code|program)|it)\s+as\s+(?:benign|safe|harmless|not malicious)"
    r"|(?:请)?(?:将|把)(?:此|本|该)(?:文件|脚本|代码|程序)(?:标记|判定|视为)(?:为)?(?:无害|安全))"
)
BENIGN_CLAIM = r"(?i)\b(?:not malicious|benign|harmless)\b|(?:它|本文件|此文件)是(?:无害|安全)的"
STATEMENT_END = r"[.!?;。！？；\r\n]+"

#: Lines end at \n only, and \w, \s, \b are those of Unicode.
_FLAGS = "(?dU)"


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(_FLAGS + pattern)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(_FLAGS + pattern))


def judged(sources: DataFrame, key: str = "artifact", content: str = "content", language: str | None = None, file_type: str | None = None, recovered: str | None = None) -> DataFrame:
    """key, text, codec, bom, m (lexer's result), signals, n_assignments: one row for each source that is PowerShell.

    Without a known language (null) it takes two assignments, two signals, and a cmdlet or an operator among them; a source known
    to be powershell is taken as it is, one of another language or one that was recovered (true) isn't. Null content gives no row.
    """
    known = F.lit(None).cast("string") if language is None else F.col(language)
    kind = F.lit("") if file_type is None else F.lower(F.coalesce(F.col(file_type), F.lit("")))
    start = F.hex(F.substring(F.col(content), 1, 4))
    plain = (F.octet_length(content) <= MAX_SOURCE_BYTES) & ~F.greatest(*(start.startswith(b) for b in BINARY_STARTS)) & ~F.greatest(*(F.contains(kind, F.lit(t)) for t in BINARY_TYPES))
    rows = sources.filter(plain & (F.coalesce(known, F.lit("powershell")) == "powershell"))
    if recovered is not None:
        rows = rows.filter(~F.coalesce(F.col(recovered), F.lit(False)))
    rows = rows.select(F.col(key), known.alias("_known"), P.source_text(F.col(content)).alias("s")).filter("s.text is not null")
    rows = rows.select(key, "_known", "s.text", "s.codec", "s.bom", P.mask_powershell(F.col("s.text")).alias("m")).filter("m.code is not null")
    code = F.col("m.code")
    rows = rows.withColumn("signals", F.array_compact(F.array(*(F.when(_has(code, p), F.lit(n)) for n, p in SIGNALS.items())))).withColumn("n_assignments", _count(code, ASSIGNMENT))
    enough = (F.col("n_assignments") >= 2) & (F.size("signals") >= 2) & F.arrays_overlap("signals", F.array(F.lit("cmdlet"), F.lit("operator")))
    return rows.filter(F.col("_known").isNotNull() | enough).drop("_known")


def metrics(sources: DataFrame, key: str = "artifact") -> DataFrame:
    """Lexical metrics of what judged returns: lines, functions, handlers, variables (names in any case are one) and naming styles."""
    code = F.col("m.code")
    names = F.transform(F.regexp_extract_all(code, F.lit(_FLAGS + VARIABLE), F.lit(0)), lambda v: F.regexp_replace(v, r"[${}]", ""))
    rows = sources.withColumn("v", F.filter(names, lambda v: ~F.lower(v).isin(BUILTIN)))
    n, v = F.size("v"), F.col("v")
    share = lambda test: F.when(n > 0, F.round(F.size(F.filter(v, test)) / n, 3)).otherwise(0.0)
    snake = lambda x: F.contains(x, F.lit("_")) & (F.lower(x) == x)
    camel = lambda x: x.rlike(r"\A[a-z]+(?:[A-Z][a-z0-9]*)+\z") & ~snake(x)
    return rows.select(
        key, F.col("m.n_lines").alias("loc"), F.round((F.col("m.n_lines") - F.col("m.n_filled")) / F.greatest("m.n_lines", F.lit(1)), 3).alias("blank_ratio"),
        F.round(F.col("m.n_comment_lines") / F.greatest("m.n_filled", F.lit(1)), 3).alias("comment_ratio"), _count(code, FUNCTION).alias("function_count"), _count(code, HANDLER).alias("exception_handler_count"),
        F.size(F.array_distinct(F.transform(v, F.lower))).alias("variable_count"), n.alias("variable_reference_count"),
        F.when(n > 0, F.round(F.aggregate(v, F.lit(0), lambda a, x: a + F.char_length(x)) / n, 2)).otherwise(0.0).alias("mean_identifier_length"),
        share(snake).alias("snake_case"), share(camel).alias("camel_case"), share(lambda x: ~snake(x) & ~camel(x)).alias("other"),
    )


def directives(sources: DataFrame, key: str = "artifact") -> DataFrame:
    """key, offset, byte_length, text, text_hash, features: comments of judged sources that tell an analyser to skip or to clear the file.

    The comment must address the analyser and then ask one of the two in a sentence of its own. It is a candidate of targeting,
    never evidence that a model was used. Offsets are bytes of the file. Up to 100 of a source, in order, none over 8,192 characters.
    """
    whole = r"(?s)\A(.*?)((?d)(?U)" + ADDRESS + r")(.*)\z"

    def candidate(block: Column) -> Column:
        text = block["text"]
        part = lambda k: F.regexp_extract(text, whole, k)
        said = F.split(part(3), STATEMENT_END)
        return F.struct(
            (block["start"] + F.char_length(part(1))).alias("at"), F.regexp_replace(F.concat(part(2), part(3)), r"[\r\n]+\z", "").alias("text"),
            F.exists(said, lambda s: _has(s, SKIP_ANALYSIS)).alias("skip"), F.exists(said, lambda s: _has(s, FORCE_BENIGN)).alias("verdict"),
        )

    asked = F.filter("m.blocks", lambda b: (F.char_length(b["text"]) <= MAX_COMMENT_CHARS) & _has(b["text"], ADDRESS))
    found = F.slice(F.filter(F.transform(asked, candidate), lambda c: c["skip"] | c["verdict"]), 1, MAX_CANDIDATES)
    rows = sources.select(key, "codec", "bom", F.col("text").alias("source"), F.explode(found).alias("c"))
    size = lambda x: F.when(F.col("codec") == "utf-8", F.octet_length(x)).otherwise(F.octet_length(F.encode(x, "UTF-16LE")))
    always = F.create_map(F.lit("analyzer_prompt_injection"), F.lit(True), F.lit("evasion"), F.lit(True))
    flag = lambda test, name: F.when(test, F.create_map(F.lit(name), F.lit(True))).otherwise(F.create_map().cast("map<string,boolean>"))
    return rows.select(
        key, (F.col("bom") + size(F.substring(F.col("source"), F.lit(1), F.col("c.at")))).cast("long").alias("offset"), size(F.col("c.text")).cast("long").alias("byte_length"), F.col("c.text").alias("text"),
        F.sha2("c.text", 256).alias("text_hash"), F.map_concat(always, flag(F.col("c.verdict"), "forced_benign_verdict"), flag(_has(F.col("c.text"), BENIGN_CLAIM), "benign_claim")).alias("features"),
    )


def merge_prompts(prompts: DataFrame, candidates: DataFrame, key: str = "artifact") -> DataFrame:
    """key, offset, text_hash, text, features, is_candidate: known prompts and candidates; at one place with one hash they are one row.

    Both have key, offset, text_hash, text and features (a map of flags), and one row for each place and hash. The candidate's text
    and flags win, other flags of the known prompt stay. Prompts without an offset or hash stay as they are.
    """
    on = [key, "offset", "text_hash"]
    empty = F.create_map().cast("map<string,boolean>")
    p = prompts.select(*on, F.col("text").alias("_pt"), F.col("features").alias("_pf"), F.lit(True).alias("_p"))
    c = candidates.select(*on, F.col("text").alias("_ct"), F.col("features").alias("_cf"), F.lit(True).alias("_c"))
    known = F.coalesce("_pf", empty)
    new = F.coalesce("_cf", empty)
    kept = F.map_filter(known, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return p.join(c, on, "full").select(*on, F.coalesce("_ct", "_pt").alias("text"), F.map_concat(kept, new).alias("features"), F.col("_c").isNotNull().alias("is_candidate"))
