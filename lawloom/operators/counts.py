"""Counts, histograms, orders and set differences of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corpus_counts(nodes: DataFrame) -> DataFrame:
    """(file, nodes, laws, versions) of ``nodes`` (file, law_id, version_id)."""
    return nodes.groupBy("file").agg(F.count("*").alias("nodes"), F.count_distinct("law_id").alias("laws"), F.count_distinct("version_id").alias("versions"))


def kind_histogram(nodes: DataFrame) -> DataFrame:
    """(file, kind, n)."""
    return nodes.groupBy("file", "kind").agg(F.count("*").alias("n"))


def unordered(rows: DataFrame, key: str | Column, pos: str = "pos") -> DataFrame:
    """Rows of each file whose key is not greater than the one's before them, in input order."""
    value = F.col(key) if isinstance(key, str) else key
    before = F.lag(value).over(Window.partitionBy("file").orderBy(pos))
    return rows.withColumn("before", before).where(F.col("before") >= value).drop("before")


def differences(there: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` rows that are not there as often ('missing'), and rows that are there besides ('extra'), in ``side``."""
    columns = expected.columns
    missing = expected.exceptAll(there.select(*columns)).select(F.lit("missing").alias("side"), *columns)
    return missing.unionByName(there.select(*columns).exceptAll(expected).select(F.lit("extra").alias("side"), *columns))
