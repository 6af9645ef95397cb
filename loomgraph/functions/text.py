"""Text rules as column expressions: lines, annotations, imports, export tests, call names, body cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import ANNOTATIONS, SECURITY_FIX

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def lines(text: Column) -> Column:
    """The lines of a text, without an empty one after the last break; none for an empty or null text."""
    parts = F.split(text, LINE_BREAK)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, cut).otherwise(F.array().cast("array<string>"))


def annotations(files: DataFrame, patterns: dict[str, str] = ANNOTATIONS) -> DataFrame:
    """(id, path, line, type, text) of files(path, text): one row for each line and marker on it; lines count from 1."""
    l = files.select("path", F.posexplode(lines(F.col("text"))).alias("pos", "l"))
    kinds = F.array_compact(F.array(*(F.when(F.col("l").rlike(f"(?U){p}"), F.lit(k)) for k, p in patterns.items())))
    l = l.select("path", (F.col("pos") + 1).alias("line"), F.substring(F.trim("l"), 1, 300).alias("text"), F.explode(kinds).alias("type"))
    return l.select(F.concat_ws(":", F.lit("ann"), "path", F.col("line").cast("string"), "type").alias("id"), "path", "line", "type", "text")


def is_security_fix(message: Column) -> Column:
    return message.rlike(SECURITY_FIX)


def import_target(raw: Column) -> Column:
    """What an import statement names; the order of the tests matters, as a statement that holds `from` anywhere is read as
    one with a quoted source first."""
    s = F.trim(raw)
    quoted = F.regexp_extract(s, "['\"]([^'\"]+)['\"]", 1)
    include = F.regexp_extract(s, "[<\"]([^>\"]+)[>\"]", 1)
    py_from = F.regexp_extract(s, r"^from\s+(\S+)", 1)
    py_import = F.regexp_extract(s, r"^import\s+([\w.]+)", 1)
    use = F.trim(F.regexp_replace(F.regexp_replace(s, r"^(pub\s+)?use\s+", ""), ";$", ""))
    return (
        F.when(s.startswith("#include"), include).when(s.rlike(r"^(pub\s+)?use\s"), use).when(s.contains("from") & (quoted != ""), quoted)
        .when(py_from != "", py_from).when(quoted != "", quoted).when(py_import != "", F.regexp_replace(py_import, r"\.$", "")).otherwise(s)
    )


def call_parts(text: Column) -> Column:
    """(callee, qualifier) of a called expression, cut at the last of the first separator that it holds: ->, :: or a dot."""

    def cut(sep: str) -> Column:
        return F.struct(F.substring_index(text, sep, -1).alias("callee"), F.expr("1").isNotNull().alias("x"), F.regexp_replace(text, r"(?s)" + {"->": "->", "::": "::", ".": r"\."}[sep] + r"(?:(?!" + {"->": "->", "::": "::", ".": r"\."}[sep] + r").)*$", "").alias("qualifier"))

    plain = F.struct(text.alias("callee"), F.expr("1").isNotNull().alias("x"), F.lit(None).cast("string").alias("qualifier"))
    c = F.when(text.contains("->"), cut("->")).when(text.contains("::"), cut("::")).when(text.contains("."), cut(".")).otherwise(plain)
    own = c["qualifier"].isin("self", "this", "super", "Self")
    return F.struct(c["callee"].alias("callee"), F.when(~own, c["qualifier"]).alias("qualifier"))


def exported(language: Column, head: Column, name: Column) -> Column:
    """Whether a definition is visible outside its file, by language, from its first line."""
    return (
        F.when(language == "rust", head.rlike(r"\bpub\b")).when(language.isin("c", "cpp", "objc"), ~head.rlike(r"\bstatic\b"))
        .when(language == "java", head.rlike(r"\bpublic\b")).when(language == "go", F.substring(name, 1, 1).rlike("[A-Z]"))
        .when(language.isin("javascript", "typescript"), head.rlike(r"\bexport\b")).when(language == "python", ~name.startswith("_"))
        .when(language == "kotlin", ~head.rlike(r"\b(private|internal)\b")).when(language == "swift", head.rlike(r"\b(public|open)\b")).otherwise(F.lit(False))
    )


def wildcard(column: Column, pattern: str) -> Column:
    """A pattern with * is a whole match in any case; one without is a part in any case."""
    if "*" in pattern:
        return column.rlike("(?i)^(?:" + pattern.replace("*", ".*") + ")$")
    return F.lower(column).contains(pattern.lower())
