"""Scans of text tables by path, by line and by paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What must not stand in a published text, by name.
PATTERNS = {
    "home_path": r"/home/[A-Za-z0-9._-]+/",
    "windows_user_path": r"[A-Za-z]:\\Users\\",
    "mount_path": r"/mnt/[a-z]/",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "model_api_token": r"\bsk-[A-Za-z0-9]{20,}",
    "slack_token": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assigned_secret": r"(?i)\b(?:password|secret|api[_-]?key|access[_-]?token|client[_-]?secret)\s*[:=]\s*['\"][^'\"]{6,}['\"]",
    "connection_string": r"(?i)\b(?:postgres|postgresql|mysql|mongodb|redis|amqp)(?:\+\w+)?://[^\s/@]+:[^\s/@]+@",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
#: Domains kept for examples, and files that are no texts.
EXAMPLE_DOMAINS = r"(?i)@.*example\.(?:com|org|net)\z"
BINARY = r"(?i)\.(?:png|jpg|jpeg|gif|pdf|zip|whl|ico|woff|woff2)\z"


def split_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def scan_lines(texts: DataFrame, key: str, patterns: dict[str, str] | None = None, allowed: str | None = None, text: str = "text") -> DataFrame:
    """(key, line_no, rule, found): each line's matches of each pattern, but those that ``allowed`` matches.

    Patterns are tested on whole texts first, so that only texts with a match are split.
    """
    patterns = PATTERNS if patterns is None else patterns
    some = F.lit(False)
    for p in patterns.values():
        some = some | F.col(text).rlike(p)
    lines = split_lines(texts.where(some), key, text)

    def found_by(name: str, pattern: str) -> F.Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(name).alias("rule"), m.alias("found")))

    each = F.flatten(F.array(*(found_by(name, p) for name, p in sorted(patterns.items()))))
    found = lines.select(key, "line_no", F.explode(each).alias("m")).select(key, "line_no", "m.rule", "m.found")
    return found if allowed is None else found.where(~F.col("found").rlike(allowed))


def scan_paths(paths: DataFrame, path: str, markers: tuple[str, ...] = ()) -> DataFrame:
    """(path, rule, found): markers in paths, and paths that are absolute, have backslashes or climb."""
    p = F.col(path)
    rules = [F.when(F.contains(F.lower(p), F.lit(m)), F.struct(F.lit("marker").alias("rule"), F.lit(m).alias("found"))) for m in markers]
    rules += [
        F.when(p.startswith("/") | p.rlike("^[A-Za-z]:"), F.struct(F.lit("absolute").alias("rule"), F.lit("").alias("found"))),
        F.when(F.contains(p, F.lit("\\")), F.struct(F.lit("backslash").alias("rule"), F.lit("").alias("found"))),
        F.when(F.array_contains(F.split(p, "/"), ".."), F.struct(F.lit("parent").alias("rule"), F.lit("").alias("found"))),
    ]
    return paths.select(path, F.explode(F.array_compact(F.array(*rules))).alias("m")).select(path, "m.rule", "m.found")


def scan_tree(files: DataFrame, *, markers: tuple[str, ...] = (), patterns: dict[str, str] | None = None, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(path, line_no, rule, found) of ``files`` (path, content): their paths, texts that are no UTF-8, and all lines.

    Binary files by their ending are not read as texts; ``exempt`` paths are scanned by path only.
    """
    none = F.lit(None).cast("int").alias("line_no")
    by_path = scan_paths(files.select("path"), "path", markers).select("path", none, "rule", "found")
    texts = files.where(~F.col("path").rlike(BINARY) & ~F.col("path").isin(*exempt)).select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), F.col("content").cast("string").alias("text"))
    odd = texts.where("NOT valid").select("path", none, F.lit("not_utf8").alias("rule"), F.lit("").alias("found"))
    return by_path.unionByName(odd).unionByName(scan_lines(texts.where("valid"), "path", patterns, EXAMPLE_DOMAINS))


def paragraphs(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, paragraph from 1, first_line, n_lines, text): lines between blank ones."""
    lines = split_lines(texts, key, text)
    order = Window.partitionBy(key).orderBy("line_no")
    blank = F.length(F.trim("line")) == 0
    numbered = lines.withColumn("__blank", blank).withColumn("__group", F.sum(F.col("__blank").cast("int")).over(order)).where("NOT __blank")
    grouped = numbered.groupBy(key, "__group").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return grouped.withColumn("paragraph", F.row_number().over(Window.partitionBy(key).orderBy("first_line"))).select(key, "paragraph", "first_line", "n_lines", "text")


def matches_squashed(text: str, pattern: str) -> F.Column:
    """Whether a pattern matches a text, or the text without its white space."""
    return F.col(text).rlike(pattern) | F.regexp_replace(text, r"\s+", "").rlike(pattern)


def scan_paragraphs(texts: DataFrame, key: str, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """(key, first_line, rule) of paragraphs: the first pattern, in the order given, that matches it as it is or squashed."""
    rule = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        rule = F.when(matches_squashed("text", pattern), name).otherwise(rule)
    return paragraphs(texts, key, text).select(key, "first_line", rule.alias("rule")).where("rule IS NOT NULL")
