from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lawloom.catalog import provisions
from lawloom.functions.identity import node_id, parent_locator
from lawloom.operators.diagnostics import diagnose, with_layer
from lawloom.operators.trees import climb
from lawloom.plans.compile import identify
from lawloom.schema import LAYER_OF


def corpus(spark):
    rows = [(0, "/law/root", "law", 0), (1, "/law/root/article/article-1", "article", 1), (2, "/law/root/article/article-1/paragraph/paragraph-1", "paragraph", 2)]
    df = spark.createDataFrame(rows, "pos long, locator string, kind string, depth int")
    nodes = identify(provisions(df, pos=F.col("pos"), locator=F.col("locator"), kind=F.col("kind"), depth=F.col("depth"), text=F.col("kind")))
    above = parent_locator(F.col("locator"))
    return nodes.withColumn("parent_id", F.when(above.isNotNull(), node_id(F.col("law_id"), above)))


def codes(nodes, crosswalk=None):
    return {r.code for r in diagnose(nodes, crosswalk).collect()}


def test_clean(spark):
    assert codes(corpus(spark)) == set()


FAULTS = {
    "jurisdiction": (lambda: F.lit(" "), {"IDENTITY_NORMALIZED"}),
    "law_id": (lambda: F.lit("law_x"), {"ID_LAW", "ID_NODE", "PARENT_LAW", "LAW_ROOT_COUNT"}),
    "node_id": (lambda: F.lit("node_x"), {"ID_NODE", "ID_VERSION"}),
    "version_id": (lambda: F.lit("v"), {"ID_VERSION"}),
    "locator": (lambda: F.lit("/x"), {"ID_NODE", "LOCATOR_GRAMMAR"}),
    "ordinal": (lambda: F.lit(0), {"ORDINAL_POSITIVE"}),
    "branch": (lambda: F.array(F.lit(-1)), {"BRANCH_POSITIVE"}),
    "source.sha256": (lambda: F.lit("AB"), {"SOURCE_SHA256"}),
    "source.byte_start": (lambda: F.lit(1).cast("long"), {"SOURCE_RANGE"}),
    "source.page": (lambda: F.lit(0), {"SOURCE_PAGE"}),
    "source.uri": (lambda: F.lit(""), {"SOURCE_URI"}),
    "source.source_key": (lambda: F.lit("a\0b"), {"NUL_FORBIDDEN"}),
    "kind": (lambda: F.lit("cell"), {"KIND_TRANSITION"}),
    "depth": (lambda: F.lit(5), {"PARENT_DEPTH"}),
    "parent_id": (lambda: F.lit("node_gone"), {"PARENT_MISSING", "TREE_UNREACHABLE"}),
}


@pytest.mark.parametrize("field", sorted(FAULTS))
def test_fault_in_the_last_node(spark, field):
    make, want = FAULTS[field]
    value = make()
    nodes = corpus(spark)
    head, _, rest = field.partition(".")
    last = F.col("pos") == 2
    changed = F.col(head).withField(rest, F.when(last, value).otherwise(F.col(field))) if rest else F.when(last, value).otherwise(F.col(head))
    assert codes(nodes.withColumn(head, changed)) == want


def test_root_faults(spark):
    nodes = corpus(spark).withColumn("kind", F.when(F.col("pos") == 0, "part").otherwise(F.col("kind"))).withColumn("depth", F.when(F.col("pos") == 0, 1).otherwise(F.col("depth")))
    assert codes(nodes) == {"ROOT_KIND", "ROOT_DEPTH", "PARENT_DEPTH"}


def test_versions(spark):
    nodes = corpus(spark)
    dated = lambda a, b, t: nodes.where("pos = 2").withColumn("temporal", F.col("temporal").withField("valid_from", F.lit(a)).withField("valid_to", F.lit(b).cast("string"))).withColumn("text", F.lit(t))
    two = lambda x, y: identify(nodes.where("pos < 2").unionByName(x).unionByName(y.withColumn("pos", F.lit(3).cast("long"))))
    assert codes(two(dated("2020-01-01", "2021-01-01", "a"), dated("2021-01-01", None, "b"))) == set()
    assert codes(two(dated("2020-01-01", "2021-01-02", "a"), dated("2021-01-01", None, "b"))) == {"TEMPORAL_OVERLAP"}
    assert codes(two(dated("2020-01-01", "2021-01-01", "a"), dated("2021-01-01", None, "b").withColumn("ordinal", F.lit(7)))) == {"SEMANTIC_IDENTITY_DRIFT"}
    assert codes(nodes.unionByName(nodes.where("pos = 2"))) == {"DUPLICATE_VERSION", "TEMPORAL_OVERLAP"}
    assert "PARENT_TEMPORAL" in codes(identify(nodes.withColumn("temporal", F.when(F.col("pos") == 1, F.col("temporal").withField("valid_from", F.lit("2020-01-01"))).otherwise(F.col("temporal")))))


def test_cycle(spark):
    nodes = corpus(spark)
    ids = {r.pos: r.node_id for r in nodes.collect()}
    cyclic = nodes.withColumn("parent_id", F.when(F.col("pos") == 1, ids[2]).otherwise(F.col("parent_id")))
    found = {(r.code, r.subject) for r in diagnose(cyclic).collect()}
    assert {("TREE_CYCLE", ids[1]), ("TREE_CYCLE", ids[2]), ("TREE_UNREACHABLE", ids[1]), ("TREE_UNREACHABLE", ids[2])} <= found


def test_crosswalk(spark):
    nodes = corpus(spark)
    v = nodes.where("pos = 1").first()
    sha = "0" * 64
    row = lambda legacy, version=v.version_id, relation="exact", reason=None, s=sha: ("f", 0, legacy, v.node_id, version, relation, reason, s)
    schema = "file string, pos long, legacy_id string, target_node_id string, target_version_id string, relation string, reason string, source_sha256 string"
    run = lambda *rows: codes(nodes, spark.createDataFrame(rows, schema))
    assert run(row("a")) == set()
    assert run(row("a", version="gone")) == {"CROSSWALK_TARGET"}
    assert run(row("a", s="1" * 64)) == {"CROSSWALK_SOURCE_MISMATCH"}
    assert run(row("a", s="X")) == {"CROSSWALK_SOURCE_MISMATCH", "MALFORMED_SHA"}
    assert run(row("a", reason="r")) == {"CROSSWALK_EXACT_REASON"}
    assert run(row("a", relation="ambiguous")) == {"CROSSWALK_AMBIGUOUS_REASON"}
    assert run(row("a", relation="odd")) == {"CROSSWALK_FIELDS"}
    assert run(row("a"), row("a")) == {"CROSSWALK_DUPLICATE_TARGET", "CROSSWALK_REPEATED_POLICY"}
    assert run(row("a", relation="ambiguous", reason="r"), row("a", relation="ambiguous", reason="r", version="gone")) == {"CROSSWALK_TARGET"}


def test_empty_corpus_and_layers(spark):
    nodes = corpus(spark)
    found = diagnose(nodes.where("false"), None, spark.createDataFrame([("f",)], "file string")).collect()
    assert [(r.code, r.subject) for r in found] == [("CORPUS_EMPTY", "corpus")]
    df = spark.createDataFrame([("f", c, "s", "") for c in LAYER_OF], "file string, code string, subject string, detail string")
    assert {r.code: r.layer for r in with_layer(df).collect()} == LAYER_OF and len(LAYER_OF) == 36


def test_climb(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone"), ("w", "z")], "node string, parent string")
    assert {r.node: r.root for r in climb(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": None, "y": None, "z": None, "w": None}


def test_climbing_ends_after_the_logarithm_of_the_depth_with_cycles_and_many_children(spark, monkeypatch):
    from lawloom.operators import trees

    rows = [("r", None), *((f"c{i}", "r") for i in range(300)), *((f"d{i}", "c0") for i in range(300)), *((f"e{i}", "d0") for i in range(300)), ("x0", "x1"), ("x1", "x0"), *((f"y{i}", "x0") for i in range(300)), ("z0", "lost"), ("z1", "z0")]
    edges = spark.createDataFrame(rows, "node string, parent string")
    written = []
    monkeypatch.setattr(trees, "materialise", lambda df, real=trees.materialise: (written.append(df), real(df))[1])
    got = {r.node: (r.root, r.depth) for r in climb(edges, many=50).collect()}
    depth = {"r": 0, "c": 1, "d": 2, "e": 3}
    assert all(got[n] == ("r", depth[n[0]]) for n, _ in rows if n[0] in depth)
    assert all(got[n][0] is None for n, _ in rows if n[0] in "xyz") and len(got) == len(rows)
    # the first step and three rounds, each with its keys of many rows; it went on for 11 rounds before
    assert len(written) <= 8


def test_keys_of_many_rows_are_sent_to_them(spark):
    from lawloom.operators.trees import follow

    rows = spark.createDataFrame([("f", i, None if i % 10 == 0 else "hot" if i % 2 else f"k{i}") for i in range(200)], "file string, id int, k string")
    to = spark.createDataFrame([("f", "hot", 1), ("g", "hot", 2), *(("f", f"k{i}", i) for i in range(0, 200, 4))], "file string, k string, v int")
    want = sorted(((r.file, r.k, r.id, r.v) for r in rows.join(to, ["file", "k"], "left").select("file", "k", "id", "v").collect()), key=repr)
    for many in (10, 1000):
        assert sorted(((r.file, r.k, r.id, r.v) for r in follow(rows, to, ["file", "k"], many).select("file", "k", "id", "v").collect()), key=repr) == want


def test_cross_row_checks_move_keys_and_not_ids(spark):
    """Provisions that stand once move as hashes and keys of 16 bytes; before, each was moved a dozen times with its ids."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("pos"), F.when(F.col("id") == 0, "/law/root").otherwise(F.concat(F.lit("/law/root/article/article-"), F.col("id").cast("string"))).alias("locator"))
    root = F.col("pos") == 0
    nodes = identify(provisions(rows, pos=F.col("pos"), locator=F.col("locator"), kind=F.when(root, "law").otherwise("article"), depth=F.when(root, 0).otherwise(1), text=F.lit("x")))
    nodes = nodes.withColumn("parent_id", F.when(~root, node_id(F.col("law_id"), F.lit("/law/root"))))
    twice = nodes.unionByName(nodes.where("pos = 7").withColumn("parent_id", F.lit("node_gone")).withColumn("pos", F.lit(n).cast("long")))

    def written() -> dict[int, int]:
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    found = {(r.code, r.subject) for r in diagnose(twice).collect()}
    moved = sum(size for stage, size in written().items() if stage not in before)
    seventh = nodes.where("pos = 7").first().node_id
    assert {c for c, s in found if s == seventh} == {"TEMPORAL_OVERLAP", "SEMANTIC_IDENTITY_DRIFT", "PARENT_MISSING", "TREE_UNREACHABLE"}
    assert moved < 450 * n
