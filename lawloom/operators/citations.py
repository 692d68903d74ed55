"""Citations of source files in documents, resolved against the symbols that the files define."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import split_lines

#: A citation (a path and a symbol in two code spans), and the form by line number that is refused.
CITATION = r"`((?:src|tests)/[A-Za-z0-9_./-]+\.py)` `([A-Za-z_][A-Za-z0-9_]*)(?:\(\))?`"
BY_LINE = r"[A-Za-z0-9_./-]*[A-Za-z0-9_-]\.py:\d+(?:-\d+)?"


def citations(docs: DataFrame) -> DataFrame:
    """(path, line_no, cited, symbol) of each citation in ``docs`` (path, text)."""
    lines = split_lines(docs.where(F.col("text").rlike(CITATION)), "path")
    pair = F.arrays_zip(F.regexp_extract_all("line", F.lit(CITATION), F.lit(1)).alias("cited"), F.regexp_extract_all("line", F.lit(CITATION), F.lit(2)).alias("symbol"))
    return lines.select("path", "line_no", F.explode(pair).alias("c")).select("path", "line_no", "c.cited", "c.symbol")


def line_citations(docs: DataFrame) -> DataFrame:
    """(path, line_no, cited) of each citation by line number."""
    lines = split_lines(docs.where(F.col("text").rlike(BY_LINE)), "path")
    return lines.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(BY_LINE), F.lit(0))).alias("cited"))


_SYMBOLS = pa.schema([("path", pa.string()), ("problem", pa.string()), ("symbols", pa.list_(pa.string()))])


def _defined(raw: bytes | None) -> tuple[str | None, list[str]]:
    try:
        body = ast.parse((raw or b"").decode()).body
    except UnicodeDecodeError:
        return "CITED_NOT_UTF8", []
    except (SyntaxError, ValueError, RecursionError):
        return "CITED_UNPARSED", []
    named = [n.name for n in body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    targets = [t for n in body for t in (n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else [])]
    return None, sorted({*named, *(t.id for t in targets if isinstance(t, ast.Name))})


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_defined(c) for c in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.list_(pa.string()))], schema=_SYMBOLS)


def module_symbols(files: DataFrame) -> DataFrame:
    """(path, problem, symbols) of ``files`` (path, content): functions, classes and names set at the top level; a file that does not parse has a problem instead."""
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(_parse, "path string, problem string, symbols array<string>")


def check_citations(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line_no, cited, symbol, problem) of each citation in ``docs`` that does not resolve in ``files``, and of each by line number.

    Cited files are parsed once, however often they are cited; a hot file's citations
    meet its symbols in a join on the path and the symbol, of which each is one row.
    """
    found = citations(docs)
    cited = found.select(F.col("cited").alias("path")).distinct()
    parsed = module_symbols(files.join(cited, "path", "left_semi").dropDuplicates(["path"]))
    state = parsed.select(F.col("path").alias("cited"), F.lit(True).alias("there"), F.col("problem").alias("unread"))
    defined = parsed.select(F.col("path").alias("cited"), F.explode("symbols").alias("symbol")).withColumn("defined", F.lit(True))
    joined = found.join(state, "cited", "left").join(defined, ["cited", "symbol"], "left")
    problem = F.when(F.array_contains(F.split("cited", "/"), ".."), "CITED_PARENT").when(F.col("there").isNull(), "CITED_MISSING").when(F.col("unread").isNotNull(), F.col("unread")).when(F.col("defined").isNull(), "CITED_UNDEFINED")
    bad = joined.select("path", "line_no", "cited", "symbol", problem.alias("problem")).where("problem IS NOT NULL")
    return bad.unionByName(line_citations(docs).select("path", "line_no", "cited", F.lit(None).cast("string").alias("symbol"), F.lit("CITED_BY_LINE").alias("problem")))
