from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_diagnostics import corpus

from lawloom.operators.constraints import crosswalk_problem, projection_problem, refused_nodes
from lawloom.plans.compile import project
from lawloom.schema import PAIRS

CASES = {
    "text": (lambda: F.lit(""), "NODE_TEXT_EMPTY"),
    "jurisdiction": (lambda: F.lit(None).cast("string"), "NODE_STRING"),
    "authority": (lambda: F.lit("　"), "NODE_TEXT_EMPTY"),
    "kind": (lambda: F.lit("verse"), "NODE_TYPES"),
    "depth": (lambda: F.lit(-1), "NODE_DEPTH"),
    "ordinal": (lambda: F.lit(0), "NODE_ORDINAL"),
    "branch": (lambda: F.array(F.lit(0)), "NODE_BRANCH"),
    "attributes": (lambda: F.expr("array(named_struct('k', 'a', 'v', '1'), named_struct('k', 'a', 'v', '2'))").cast(PAIRS), "NODE_ATTRIBUTES_DUPLICATE"),
    "source.sha256": (lambda: F.lit("A" * 64), "SOURCE_SHA256"),
    "source.uri": (lambda: F.lit(""), "SOURCE_STRING"),
    "source.page": (lambda: F.lit(0), "SOURCE_PAGE"),
    "source.byte_end": (lambda: F.lit(5).cast("long"), "SOURCE_RANGE_PAIR"),
    "temporal.promulgated": (lambda: F.lit("2020-02-30"), "TEMPORAL_DATE"),
}


@pytest.mark.parametrize("field", sorted(CASES))
def test_refused(spark, field):
    make, code = CASES[field]
    nodes = corpus(spark)
    assert refused_nodes(nodes).collect() == []
    head, _, rest = field.partition(".")
    changed = nodes.withColumn(head, F.when(F.col("pos") == 1, F.col(head).withField(rest, make()) if rest else make()).otherwise(F.col(head)))
    assert [(r.pos, r.code) for r in refused_nodes(changed).collect()] == [(1, code)]


def test_other_rows(spark):
    rows = spark.createDataFrame([("a", "n", "v", "exact", "0" * 64), ("", "n", "v", "exact", "0" * 64), ("a", "n", "v", "odd", "0" * 64), ("a", "n", "v", "exact", "0")], "legacy_id string, target_node_id string, target_version_id string, relation string, source_sha256 string")
    assert [r[0] for r in rows.select(crosswalk_problem()).collect()] == [None, "CROSSWALK_FIELDS", "CROSSWALK_FIELDS", "CROSSWALK_SOURCE_SHA256"]
    projected = project(corpus(spark))
    assert {r[0] for r in projected.select(projection_problem()).collect()} == {None}
    assert {r[0] for r in projected.withColumn("locator", F.lit("x")).select(projection_problem()).collect()} == {"PROJECTION_FIELDS"}
