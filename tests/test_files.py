"""Files that tasks list and read: as Spark's readers see them, without a task a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawloom.files import files_below, lines_below
from lawloom.plans.compile import compile_sources
from lawloom.plans.store import replay, write_corpora
from lawloom.sources import tree
from lawloom.streaming.admission import arriving_files


def test_files_are_those_of_sparks_reader_and_nothing_runs_before_they_are_asked_for(spark, tmp_path):
    contents = {"c.jsonl": b"a\n\nb", "c.json": b"\xff\r\nx\n", "m.json": b"{}", "empty.json": b"", "_hidden.json": b"no", ".json": b"no"}
    for i in range(60):
        folder = tmp_path / ("_apart" if i == 0 else "in.stage" if i == 1 else f"f {i}+%41é") / "deep"
        folder.mkdir(parents=True)
        for name, content in contents.items():
            (folder / name).write_bytes(content)
    group = "listing of folders"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {name: (files_below(spark, str(tmp_path), name), lines_below(spark, f"{tmp_path}/[fi]*", name)) for name in ("*", "c.json*", "{c,m,empty}.json")}
        # a task a folder ran here, and every file's state came to the driver
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for name, (whole, lines) in got.items():
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(str(tmp_path))
        want = sorted((r.path, bytes(r.content)) for r in read.select("path", "content").collect())
        assert sorted((r.path, bytes(r.content)) for r in whole.collect()) == want and len(want) >= 59
        each = [(path, len(content), line) for path, content in want for line in content.removesuffix(b"\n").split(b"\n")]
        assert sorted((r.path, r.size, bytes(r.line)) for r in lines.collect()) == sorted(each)


def test_arriving_files_are_listed_in_few_tasks(spark, tmp_path):
    spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    arriving_files(spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 3 * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", "7")
    arriving_files(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "7"
    spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.parallelism")


def test_corpora_of_few_bytes_are_made_anew_in_several_tasks(spark, tmp_path, monkeypatch):
    source = lambda i: '{"authority":"A","jurisdiction":"J","source_law_key":"%d","nodes":[{"kind":"law","locator":"root","text":"t"}]}' % i
    given = spark.createDataFrame([(f"f{i}", source(i).encode()) for i in range(40)], "file string, content binary").coalesce(1)
    write_corpora(compile_sources(tree.adapt_json(given), check=False), str(tmp_path / "out"))
    seen, adapt = [], tree.adapt_json

    def counted(files, *args, **options):
        seen.append(files.select(F.spark_partition_id()).distinct().count())
        return adapt(files, *args, **options)

    monkeypatch.setattr(tree, "adapt_json", counted)
    assert {(r.code, r["count"]) for r in replay(spark, str(tmp_path / "out"), given).groupBy("code").count().collect()} == {(None, 40)}
    assert seen[0] > 1
