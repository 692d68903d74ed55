from __future__ import annotations

from pyspark.sql import functions as F

from lawloom.operators.members import audit_members, path_problems, ruled

MEMBER = "package string, path string, kind string, size long, sha256 string"
RULE = "prefix string, allowed boolean"


def test_paths(spark):
    paths = {
        "a/b.txt": [], "a/": [], "é/..b/c.": [], None: ["BLANK"], "": ["BLANK"], "a\\b": ["BACKSLASH"], "/a": ["ABSOLUTE", "EMPTY_STEP"], "C:/a": ["ABSOLUTE"], "C:\\a": ["BACKSLASH", "ABSOLUTE"],
        "a/../b": ["PARENT"], "..": ["PARENT"], "./a": ["DOT"], "a//b": ["EMPTY_STEP"], "/": ["ABSOLUTE", "EMPTY_STEP"], "a/" * 5000 + "b": [],
    }
    got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", path_problems(F.col("path")).alias("p")).collect()
    assert {r.path: [c.removeprefix("MEMBER_PATH_") for c in r.p] for r in got} == paths


def test_longest_rule(spark):
    rules = spark.createDataFrame([("a", False), ("a/b", True), ("a/b/c", False), ("a/b/c", True), ("ab", False)], RULE)
    paths = {"a": False, "a/x": False, "a/b": True, "a/b/d": True, "a/b/c/e": False, "abc": True, "ab/x": False, "z": True}
    members = spark.createDataFrame([(p,) for p in [*paths, *paths, None]], "path string")
    assert {r.path: r.allowed for r in ruled(members, rules).collect()} == paths


def test_audit_of_odd_rows(spark):
    members = spark.createDataFrame(
        [("p", "a/x", "file", 1, "d"), ("p", "a/x", "file", 1, "d"), ("p", "a/y", "file", None, None), ("p", "a", "folder", 0, None), ("p", "b/", "folder", 0, None), ("p", "a/z", None, 1, "d"), ("p", None, "file", 1, "d"), ("q", "a/x", "file", 2, "e"), ("p", "a/w", "file", 9, "q")],
        MEMBER,
    ).withColumn("code", F.lit("other"))
    expected = spark.createDataFrame([("p", "a/x", 1, "d"), ("p", "a/y", 3, "d"), ("p", "a/w", None, None), ("q", "a/x", 1, "d"), ("r", "a/x", 1, "d"), ("r", "a/x", 1, "d")], "package string, path string, size long, sha256 string")
    got = sorted(tuple(r) for r in audit_members(members, expected, spark.createDataFrame([("b", False)], RULE)).collect())
    assert got == sorted([
        ("p", "", "MEMBER_PATH_BLANK"), ("p", "a/x", "MEMBER_DUPLICATE"), ("p", "a/y", "MEMBER_SIZE"), ("p", "a/y", "MEMBER_DIGEST"), ("p", "b", "MEMBER_DENIED"), ("p", "b", "MEMBER_FOLDER_UNEXPECTED"),
        ("p", "a/z", "MEMBER_NOT_REGULAR"), ("q", "a/x", "MEMBER_SIZE"), ("q", "a/x", "MEMBER_DIGEST"), ("r", "a/x", "MEMBER_MISSING"),
    ])
    nothing = audit_members(members.limit(0), expected.limit(0), spark.createDataFrame([], RULE))
    assert nothing.columns == ["package", "path", "code"] and nothing.count() == 0
