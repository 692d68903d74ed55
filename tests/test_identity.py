from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from lawloom.functions.canonical import canonical_json, json_string, uuid5
from lawloom.functions.identity import law_id, normalized, parent_locator, segment, segment_problem, valid_locator
from lawloom.plans.compile import utc_timestamp
from lawloom.profile import ID_NAMESPACE


def test_canonical_json_escapes(spark):
    texts = ["".join(map(chr, range(128))), "\\u000B \x0b\x0b\\\x0b\\\\\x1f", 'é😀 "\n', ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string(F.col("t")).alias("j"), canonical_json({"b": F.col("t"), "a": F.lit(None).cast("string")}).alias("o")).collect()
    for r in rows:
        assert r.j == json.dumps(r.t, ensure_ascii=False)
        assert r.o == json.dumps({"a": None, "b": r.t}, ensure_ascii=False, separators=(",", ":"))


def test_uuid5(spark):
    row = spark.range(1).select(uuid5(F.lit("名 x"), ID_NAMESPACE).alias("u")).first()
    assert row.u == str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), "名 x"))


def test_normalized(spark):
    texts = ["  Ａ\t b\r\n c　", "x", "", " y ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(normalized(F.col("t"), fold=True).alias("n")).collect()
    assert [r.n for r in rows] == ["a b c", "x", "", "y", None]


def test_law_id_needs_its_parts(spark):
    df = spark.createDataFrame([("J", "A", "n", None), ("J", "A", None, "n"), ("J", " ", "n", None), ("J", "A", " ", "n"), ("J", "A", None, None)], "j string, a string, n string, s string")
    ids = [r[0] for r in df.select(law_id(F.col("j"), F.col("a"), F.col("n"), F.col("s"))).collect()]
    payload = json.dumps({"authority": "a", "jurisdiction": "j", "key": "n", "key_kind": "law_number"}, separators=(",", ":"))
    assert ids[0] == "law_" + str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), hashlib.sha256(payload.encode()).hexdigest()))
    assert ids[1] not in (None, ids[0]) and ids[2:] == [None, None, None]


def test_locators(spark):
    no, empty = F.lit(None).cast("int"), F.array().cast("array<int>")
    row = spark.range(1).select(
        segment(F.lit("article"), F.lit("x"), F.lit(3), F.array(F.lit(2), F.lit(1))).alias("a"),
        segment(F.lit("appendix"), F.lit("x"), F.lit(1), empty, tag=F.lit("AppdxTable")).alias("b"),
        segment(F.lit("item"), F.lit("Foo Bar"), no, empty).alias("c"),
        segment(F.lit("item"), F.lit("第"), no, empty, stable_key=F.lit("k")).alias("d"),
        parent_locator(F.lit("/law/root/article/article-1")).alias("p"),
        parent_locator(F.lit("/law/root")).alias("r"),
        valid_locator(F.lit("/law/root")).alias("ok"),
        valid_locator(F.lit("/law/Root\n")).alias("bad"),
    ).first()
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    assert (row.a, row.b) == ("article/article-3-2-1", "appendix/appendix-appdxtable-1")
    assert (row.c, row.d) == (f"item/u-{h('Foo Bar')}-foo-bar", f"item/u-{h('k')}")
    assert (row.p, row.r, row.ok, row.bad) == ("/law/root", None, True, False)


def test_blank_tags_and_unnamed_steps(spark):
    rows = spark.createDataFrame([("", 1), ("　 ", 1), ("第", 1), ("Ａｐｐｄｘ Ｔａｂｌｅ", 1), (None, 1), ("x", None)], "tag string, ordinal int")
    step = segment(F.lit("appendix"), F.lit("第"), F.col("ordinal"), F.array().cast("array<int>"), tag=F.col("tag"), stable_key=F.lit(""))
    got = [tuple(r) for r in rows.select(step.alias("s"), segment_problem(step, F.col("ordinal")).alias("p")).collect()]
    blank = (None, "LOCATOR_SOURCE_TAG_REQUIRED")
    assert got == [blank, blank, blank, ("appendix/appendix-appdx-table-1", None), ("appendix/appendix-1", None), (None, "LOCATOR_STABLE_SOURCE_KEY_REQUIRED")]


def test_utc_times():
    for good in ("2026-01-01T00:00:00Z", "2024-02-29T23:59:59.000001Z"):
        assert utc_timestamp(good)
    for bad in (None, 5, "", "2026-01-01T00:00:00", "2026-01-01 00:00:00Z", "2026-02-30T00:00:00Z", "2026-01-01T00:00:00.000000Z", "2026-01-01T00:00:00.5Z", "2026-01-01T24:00:00Z", "0000-01-01T00:00:00Z", "2026-01-01T00:00:00Z\n", "２026-01-01T00:00:00Z"):
        assert not utc_timestamp(bad)


def test_law_ids_move_no_rows_and_equal_the_expression(spark):
    from lawloom.functions.identity import law_id, with_law_id

    parts = ("jurisdiction", "authority", "law_number_key", "source_law_key")
    texts = [None, "", " ", "A  b", "\tＪapan\n", "ΑΣ", "İX", "ﬁ", 'q"\\\x01', "\x85a"]
    df = spark.createDataFrame([(j, "A", n, s) for j in texts for n in (None, "", "N 1") for s in texts], ", ".join(f"{c} string" for c in parts))
    told = with_law_id(df, "law_id")
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert told.where(~F.col("law_id").eqNullSafe(law_id(*map(F.col, parts)))).count() == 0
