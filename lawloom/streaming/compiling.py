"""Arriving source files compiled to corpora, each content once, with one commit a micro-batch.

A batch's corpora and the log of what it read are staged and renamed together, so both
are there or neither is. A batch that is run again after a crash finds its contents in the
log and has nothing left to do; so do copies that arrive later, under whatever name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.compile import compile_sources
from ..plans.store import corpus_files, write_files
from ..sources.law_xml import Adapted
from ..tables import materialise, spread

LOG = "file string, sha256 string, diagnostic string"


def committed(out: str) -> str:
    """The folders of committed batches, as a glob; what a crash has left half written is not among them."""
    return f"{out.rstrip('/')}/*-committed"


def compile_log(spark: SparkSession, out: str) -> DataFrame:
    """(file, sha256, diagnostic) of every content that a committed batch has compiled or refused."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{committed(out)}/log.jsonl")
    store = found.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.globStatus(found):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{committed(out)}/log.jsonl")


def compile_batch(files: DataFrame, out: str, adapt: Callable[[DataFrame], Adapted], **options: object) -> int:
    """Compile those of ``files`` (file, content) whose content is new, and commit them; how many there were.

    Of several files of one content the least name counts. Files that are refused stand in
    the log with their diagnostic and are not tried again. ``options`` go to ``compile_sources``.
    """
    spark = files.sparkSession
    files = files.withColumn("sha256", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    first = files.groupBy("sha256").agg(F.min("file").alias("file")).join(compile_log(spark, out).select("sha256"), "sha256", "left_anti")
    new = materialise(spread(files.join(first, ["sha256", "file"], "left_semi").dropDuplicates(["file"]), "file"))
    n = new.count()
    if not n:
        return 0
    compiled = compile_sources(adapt(new.drop("sha256")), strict=False, **options)
    refused = compiled.failures.groupBy("file").agg(F.min("diagnostic").alias("diagnostic"))
    log = new.select("file", "sha256").join(refused, "file", "left")
    line = log.select(F.lit("log.jsonl").alias("path"), F.struct(F.array("sha256").alias("at"), F.lit(0).cast("long").alias("seq")).alias("part"), F.concat(F.to_json(F.struct("file", "sha256", "diagnostic")), F.lit("\n")).alias("content"))
    write_files(corpus_files(compiled).unionByName(line), f"{out.rstrip('/')}/{uuid.uuid4().hex}-committed")
    return n


def compile_stream(files: DataFrame, out: str, checkpoint: str, adapt: Callable[[DataFrame], Adapted], **options: object) -> StreamingQuery:
    """Compile what arrives (``arriving_files``) into ``out`` until nothing is left; a restart goes on where it stood."""

    def run(batch: DataFrame, _: int) -> None:
        compile_batch(batch, out, adapt, **options)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
