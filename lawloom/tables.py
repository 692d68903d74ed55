"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where the session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if root is None:
        root = "file://" + tempfile.mkdtemp(prefix="lawloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lawloom/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, which ends the lineage."""
    path = shared_dir(df.sparkSession)
    # zstd halves ids and digests, which the default leaves as long as they are
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df`` dealt over three tasks a slot by a hash of ``key``: for rows of few bytes and much work.

    The number is given, as an adaptive plan would bring such rows into few tasks, or one.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*key))


def evenly(df: DataFrame, key: str) -> DataFrame:
    """As ``spread``, by ``key`` itself, which an aggregate by it needs anyway: rows move once."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, key)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` with all rows of a key in one task, whatever stands before.

    Hashes are dealt, not keys: a shuffle by the same key, as of a join, would be taken for this one,
    and an adaptive plan may still turn that into a broadcast whose rows stay where they lie.
    """
    return df.repartition(F.xxhash64(key))
