"""Audit of packages by tables of their members: no archive is opened, any number of packages are one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_problems(path: Column) -> Column:
    """The codes that speak against a member's name, as an array: where it is blank, leaves its package, or has a second spelling. Null counts as blank."""
    name = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    steps = F.split(F.regexp_replace(name, "/+\\z", ""), "/")
    found = (
        F.when(F.length(name) == 0, "MEMBER_PATH_BLANK"),
        F.when(F.contains(path, F.lit("\\")), "MEMBER_PATH_BACKSLASH"),
        F.when(name.rlike("^(/|[A-Za-z]:/)"), "MEMBER_PATH_ABSOLUTE"),
        F.when(F.array_contains(steps, ".."), "MEMBER_PATH_PARENT"),
        F.when(F.array_contains(steps, "."), "MEMBER_PATH_DOT"),
        F.when((F.length(name) > 0) & F.array_contains(steps, ""), "MEMBER_PATH_EMPTY_STEP"),
    )
    return F.array_compact(F.array(*found))


def above(path: Column, *, itself: bool) -> Column:
    """The folders above a path, and the path itself if asked for, shortest first."""
    steps = F.split(path, "/")
    last = F.size(steps) if itself else F.size(steps) - 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def ruled(members: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (path, allowed): what the rule of the longest prefix says, in whole steps; no rule allows.

    ``rules`` is (prefix, allowed); of two rules of one prefix the one that denies counts. Paths are made
    distinct first, so a name that every package has is matched once.
    """
    one = rules.groupBy("prefix").agg(F.min("allowed").alias("allowed"))
    paths = members.select("path").where("path IS NOT NULL").distinct()
    tried = paths.select("path", F.explode(above(F.col("path"), itself=True)).alias("prefix"))
    found = tried.join(one, "prefix").groupBy("path").agg(F.max_by("allowed", F.length("prefix")).alias("allowed"))
    return paths.join(found, "path", "left").select("path", F.coalesce("allowed", F.lit(True)).alias("allowed"))


def audit_members(members: DataFrame, expected: DataFrame, rules: DataFrame) -> DataFrame:
    """What is wrong with packages, as distinct (package, path, code).

    ``members`` is (package, path, kind, size, sha256), kind being file, folder or anything else;
    ``expected`` (package, path, size, sha256) the files that must be there; ``rules`` as in ``ruled``.
    Slashes at a path's end don't count. A path with a problem of its own is not looked at further, and so is missing. Expected sizes or digests
    that are null aren't compared. Members listed twice, under whatever kinds, are one row; so are
    expected files, of which the greatest size and digest count. Other columns are not read.
    """
    key = ["package", "path"]
    named = members.select("package", "path", path_problems(F.col("path")).alias("problems"), "kind", "size", "sha256")
    unsafe = named.select("package", F.coalesce("path", F.lit("")).alias("path"), F.explode("problems").alias("code"))
    safe = named.where(F.size("problems") == 0).withColumn("path", F.regexp_replace("path", "/+\\z", ""))
    held = safe.groupBy(*key).agg(
        F.count("*").alias("n"), F.max(F.coalesce(F.col("kind") == "file", F.lit(False))).alias("file"), F.max(F.coalesce(F.col("kind") == "folder", F.lit(False))).alias("folder"),
        F.max(~F.coalesce(F.col("kind").isin("file", "folder"), F.lit(False))).alias("other"), F.collect_set(F.struct("size", "sha256")).alias("contents"),
    )
    wanted = expected.groupBy(*key).agg(F.max("size").alias("want_size"), F.max("sha256").alias("want_sha256"), F.lit(True).alias("wanted"))
    parents = wanted.select("package", F.explode(above(F.col("path"), itself=False)).alias("path")).distinct().withColumn("parent", F.lit(True))
    both = held.join(wanted, key, "full_outer").join(parents, key, "left").join(ruled(safe, rules), "path", "left")
    is_there, is_wanted = F.coalesce("file", F.lit(False)), F.coalesce("wanted", F.lit(False))
    wrong = lambda field, want: F.exists("contents", lambda c: ~c[field].eqNullSafe(F.col(want)))
    codes = (
        F.when(F.col("n") > 1, "MEMBER_DUPLICATE"),
        F.when(F.col("other"), "MEMBER_NOT_REGULAR"),
        F.when(F.col("n").isNotNull() & ~F.col("allowed"), "MEMBER_DENIED"),
        F.when(is_there & ~is_wanted, "MEMBER_UNEXPECTED"),
        F.when(F.col("folder") & F.col("parent").isNull(), "MEMBER_FOLDER_UNEXPECTED"),
        F.when(is_wanted & ~is_there, "MEMBER_MISSING"),
        F.when(is_there & is_wanted & F.col("want_size").isNotNull() & wrong("size", "want_size"), "MEMBER_SIZE"),
        F.when(is_there & is_wanted & F.col("want_sha256").isNotNull() & wrong("sha256", "want_sha256"), "MEMBER_DIGEST"),
    )
    return unsafe.unionByName(both.select(*key, F.explode(F.array_compact(F.array(*codes))).alias("code"))).distinct()
