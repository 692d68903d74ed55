"""Law XML files as a stream: each is admitted once, as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..profile import DEFAULT, Profile
from ..sources.law_xml import admissions, parse_laws

_LISTING, _LISTING_DEFAULT = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000"


def arriving_files(spark: SparkSession, folder: str, *, glob: str = "*.xml", files_per_trigger: int = 100) -> DataFrame:
    """(file, content) of files that appear in ``folder``, which may be a glob of folders.

    A micro-batch's files are listed before they are read. Unless the session states in how many
    tasks, it is set to three a slot: Spark's default is a task a file, whose results fill the driver.
    """
    if spark.conf.get(_LISTING) == _LISTING_DEFAULT:
        spark.conf.set(_LISTING, str(3 * spark.sparkContext.defaultParallelism))
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob)
    return reader.load(folder).select(F.col("path").alias("file"), "content")


def admit_stream(files: DataFrame, out: str, checkpoint: str, *, law_id: str | None = None, profile: Profile = DEFAULT) -> StreamingQuery:
    """Append each arriving file's report to a Parquet table; what is there stops the query. Restarts go on where it stood."""
    reports = admissions(parse_laws(files, law_id), profile)
    return reports.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
