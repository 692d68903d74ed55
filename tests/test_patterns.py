from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.errors import InputError
from lawloom.operators.citations import check_citations, module_symbols
from lawloom.operators.patterns import Searcher, read_patterns, required_literal, search_patterns


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "a+b", "abc?", "x|ab", "(?i)AB", "ab{0}c", r"a\.b", r"\dab", "a b", "[a]b", "(ab)?", "ab*", "abc", r"\bab", "a{2}"]), max_size=6), st.text("abcxB. 1", max_size=20))
def test_the_automaton_never_misses(patterns, text):
    labelled = [(p, p) for p in patterns]
    assert Searcher(labelled).labels(text) == sorted({p for p in patterns if re.search(p, text)})


def test_required_literals():
    assert required_literal("home/x[a-z]") == "home/x" and required_literal(r"a\.b+c") == "a.b" and required_literal("abc?") == "ab" and required_literal("a|b") == "" and required_literal("(?i)ab") == ""


def test_pattern_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# names\n\na = foo\nb=bar[0-9] = x\n = x\nlonely\nbad = (\n")
    got = {r.line_no: (r.label, r.pattern, r.problem) for r in read_patterns(spark, str(tmp_path / "p.txt")).collect()}
    assert got == {3: ("a", "foo", None), 4: ("b", "bar[0-9] = x", None), 5: ("", "x", "PATTERN_FORM"), 6: ("lonely", "", "PATTERN_FORM"), 7: ("bad", "(", "PATTERN_REGEX")}


def test_groups_of_patterns_find_the_same(spark):
    patterns = spark.createDataFrame([(f"p{i}", f"w{i}[a-z]") for i in range(1000)] + [("p1", "never")], "label string, pattern string")
    texts = spark.createDataFrame([(1, "w1a w22b w333"), (2, None), (3, ""), (None, "w999z w999z")], "doc_id long, text string")
    want = {(1, "p1"), (1, "p22"), (1, "p3") if re.search("w3[a-z]", "w333") else (1, "p22"), (None, "p999")}
    for size in (50, 1 << 20):
        got = search_patterns(texts, "doc_id", patterns, group_bytes=size).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    with pytest.raises(InputError, match="PATTERN_REGEX"):
        search_patterns(texts, "doc_id", spark.createDataFrame([("x", "(")], "label string, pattern string"))


def test_citations(spark):
    docs = spark.createDataFrame([("a.md", "`src/a.py` `f()` `src/a.py` `g`\n`src/b.py` `h` and src/a.py:3\n`src/a.py`  `two`"), ("b.md", None), ("c.md", "`tests/c.py` `x`")], "path string, text string")
    files = spark.createDataFrame([("src/a.py", bytearray(b"async def f(): pass\n(a, b) = 1, 2\n")), ("tests/c.py", bytearray(b"x = 1"))], "path string, content binary")
    got = sorted(tuple(r) for r in check_citations(docs, files).select("path", "line_no", "cited", "problem").collect())
    assert got == [("a.md", 1, "src/a.py", "CITED_UNDEFINED"), ("a.md", 2, "src/a.py:3", "CITED_BY_LINE"), ("a.md", 2, "src/b.py", "CITED_MISSING")]
    assert {r.path: r.symbols for r in module_symbols(files).collect()} == {"src/a.py": ["f"], "tests/c.py": ["x"]}
