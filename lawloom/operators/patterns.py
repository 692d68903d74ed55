"""Patterns as a table: read from a file of ``label = regex`` lines, checked, and searched in many texts in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError

_CHECKED = pa.schema([("line_no", pa.int32()), ("label", pa.string()), ("pattern", pa.string()), ("problem", pa.string())])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            label, equals, pattern = (p.strip() for p in r["line"].strip().partition("="))
            problem = None if equals and label and pattern else "PATTERN_FORM"
            if problem is None:
                try:
                    re.compile(pattern)
                except re.error:
                    problem = "PATTERN_REGEX"
            rows.append({"line_no": r["line_no"], "label": label, "pattern": pattern, "problem": problem})
        yield pa.RecordBatch.from_pylist(rows, schema=_CHECKED)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, label, pattern, problem) of a file: PATTERN_FORM where a line is no ``label = regex``, PATTERN_REGEX where that is none. Blank lines and those that start with # are none."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("at", "line"))
    some = lines.where("trim(line) != '' AND NOT startswith(ltrim(line), '#')").select((F.col("at") + 1).cast("int").alias("line_no"), "line")
    return some.mapInArrow(_check, "line_no int, label string, pattern string, problem string")


def required_literal(pattern: str) -> str:
    """The longest run of plain characters that stands in every match of a pattern; empty where none is sure."""
    runs, run = [""], ""
    if re.match(r"\(\?[a-zA-Z-]*i", pattern) or "|" in pattern or "(?x" in pattern:
        return ""
    at, plain = 0, re.compile(r"[\w \-/@:,;<>=~`'\"!%&]")
    while at < len(pattern):
        if pattern[at] == "\\" and at + 1 < len(pattern) and not pattern[at + 1].isalnum():
            char, at = pattern[at + 1], at + 2
        elif plain.match(pattern[at]):
            char, at = pattern[at], at + 1
        else:
            break  # from the first construct on, nothing is taken for sure
        if at < len(pattern) and pattern[at] in "*?{":
            break
        run += char
        if at < len(pattern) and pattern[at] == "+":
            break
    return max([*runs, run], key=len)


class Searcher:
    """All patterns of a group, compiled once a task: an automaton of their required literals chooses which ones a text is tested with."""

    def __init__(self, patterns: list[tuple[str, str]]):
        self.compiled = [(label, re.compile(p)) for label, p in patterns]
        self.always: list[int] = []
        by_literal: dict[str, list[int]] = {}
        for i, (_, p) in enumerate(patterns):
            literal = required_literal(p)
            (by_literal.setdefault(literal, []) if len(literal) > 1 else self.always).append(i)
        self.automaton = None
        if by_literal:
            try:
                import ahocorasick
            except ImportError:
                self.always = list(range(len(patterns)))
                return
            self.automaton = ahocorasick.Automaton()
            for literal, which in by_literal.items():
                self.automaton.add_word(literal, which)
            self.automaton.make_automaton()

    def labels(self, text: str) -> list[str]:
        """Labels of the patterns that match somewhere in the text, each once, in order."""
        tried = set(self.always)
        if self.automaton is not None:
            for _, which in self.automaton.iter(text):
                tried.update(which)
        return sorted({self.compiled[i][0] for i in tried if self.compiled[i][1].search(text)})


def _search(batches: Iterator[pa.RecordBatch], patterns: list[tuple[str, str]], key: str) -> Iterator[pa.RecordBatch]:
    searcher = Searcher(patterns)
    for batch in batches:
        at, labels = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if text:
                found = searcher.labels(text)
                at += [i] * len(found)
                labels += found
        yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(labels, pa.string())], names=[key, "label"])


def search_patterns(texts: DataFrame, key: str, patterns: DataFrame, text: str = "text", group_bytes: int = 4 << 20) -> DataFrame:
    """(key, label) of each pattern of ``patterns`` (label, pattern) that matches somewhere in a text, once a row of ``texts``.

    A table of up to ``group_bytes`` characters is searched in one pass; a larger one in
    a pass for each such group, so a task holds one group. A bad pattern raises PATTERN_REGEX.
    """
    groups: list[list[tuple[str, str]]] = [[]]
    size = 0
    for r in patterns.select("label", "pattern").orderBy("label", "pattern").toLocalIterator():
        try:
            re.compile(r["pattern"])
        except re.error:
            raise InputError(f"PATTERN_REGEX: {r['label']}") from None
        if size + len(r["pattern"]) > group_bytes and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append((r["label"], r["pattern"]))
        size += len(r["pattern"])
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(key, F.col(text).alias("text"))
    out = None
    for group in groups:
        found = rows.mapInArrow(partial(_search, patterns=group, key=key), f"`{key}` {kind}, label string")
        out = found if out is None else out.unionByName(found)
    return out if len(groups) == 1 else out.distinct()
