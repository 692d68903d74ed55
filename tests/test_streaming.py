from __future__ import annotations

import json

import pytest

from lawloom.errors import InputError
from lawloom.plans.compile import RECEIPT, checked_receipts, compile_sources
from lawloom.plans.store import verify_corpora
from lawloom.profile import DEFAULT, SOURCE_AUTHORITY, SOURCE_FORMAT
from lawloom.sources.law_xml import Adapted
from lawloom.sources.tree import adapt_json
from lawloom.streaming.admission import arriving_files
from lawloom.streaming.compiling import committed, compile_batch, compile_log, compile_stream


def tree(text):
    return json.dumps({"authority": "A", "jurisdiction": "J", "source_law_key": text, "nodes": [{"kind": "law", "locator": "root", "text": text}]})


def test_a_restart_compiles_nothing_twice(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    run = lambda at: compile_stream(arriving_files(spark, str(inbox), glob="*.json"), out, at, adapt_json, check=False).awaitTermination(120)
    (inbox / "a.json").write_text(tree("one"))
    (inbox / "bad.json").write_text("{")
    run(state)
    held = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(held) == 1
    # what a crash leaves behind is no commit
    stale = tmp_path / "out" / f"{held[0]}.stage.x"
    stale.mkdir()
    (stale / "log.jsonl").write_text(json.dumps({"file": "z", "sha256": "0" * 64}) + "\n")
    (inbox / "copy.json").write_text(tree("one"))
    run(state)
    # a lost checkpoint reads all files again, and all of their contents are known
    run(str(tmp_path / "other"))
    assert len(list((tmp_path / "out").glob("*-committed"))) == 1
    log = {r.file.rsplit("/", 1)[1]: r.diagnostic for r in compile_log(spark, out).collect()}
    assert set(log) == {"a.json", "bad.json"} and log["a.json"] is None and log["bad.json"]
    assert [r.code for r in verify_corpora(spark, committed(out)).collect()] == [None]


def test_equal_contents_of_one_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("b", tree("x").encode()), ("a", tree("x").encode()), ("a", tree("x").encode()), ("n", None)], "file string, content binary")
    assert compile_batch(df, out, adapt_json, check=False) == 2
    assert {(r.file, r.diagnostic is None) for r in compile_log(spark, out).collect()} == {("a", True), ("n", False)}
    assert compile_batch(df, out, adapt_json, check=False) == 0
    assert compile_batch(df.where("false"), str(tmp_path / "none"), adapt_json) == 0 and not (tmp_path / "none").exists()


@pytest.mark.parametrize("change", [{"rights": "stated"}, {"schema": "other"}, {"official_law_id": ""}, {"law_number": "1\0"}])
def test_receipts_of_other_values(spark, change):
    row = dict.fromkeys(RECEIPT) | {"schema": DEFAULT.acquisition_schema, "source_authority": SOURCE_AUTHORITY, "source_format": SOURCE_FORMAT, "official_law_id": "L", "law_number": "1", "sha256": "0" * 64}
    ddl = ", ".join(f"{k} string" for k in ("file", *RECEIPT))
    good, bad = (spark.createDataFrame([{"file": "f"} | row | c], ddl) for c in ({}, change))
    assert checked_receipts(good, good).count() == 1
    with pytest.raises(InputError, match="ACQUISITION_VALUES"):
        checked_receipts(bad, bad)


def test_an_adapter_without_its_receipts_columns(spark):
    none = spark.createDataFrame([], "file string, sha256 string")
    with pytest.raises(InputError, match="ACQUISITION_ADAPTER_METADATA"):
        compile_sources(Adapted("egov_xml", none, none, none, acquisition=none))
