"""Streaming ingestion: new files of a folder, each batch processed once and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Bytes of a file beyond which it is not held whole.
LARGE = 64 << 20

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, glob: str = "*", content: bool = True) -> StreamingQuery:
    """Run ``process`` on files (whose names fit ``glob``) that have come since the last run.  The checkpoint remembers files, so a
    restarted run reads none twice; a batch overwrites its own output, so a repeated one adds nothing.
    Without ``content`` a batch only lists its files, and none is read."""
    source = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).load(folder)
    if not content:
        source = source.drop("content")

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hashed(batch: DataFrame) -> DataFrame:
    return batch.select("path", "length", F.sha2("content", 256).alias("content_hash"))


def hashed_files(batch: DataFrame, large: int | None = None) -> DataFrame:
    """As ``hashed``, of a batch without content: files of more than ``large`` bytes are read as
    streams, one after the other, by the driver's JVM, whatever store they are in."""
    spark, large = batch.sparkSession, LARGE if large is None else large
    files = batch.select("path", "length").collect()
    long = [(r.path, r.length, _stream_hash(spark, r.path)) for r in files if r.length > large]
    out = spark.createDataFrame(long, "path string, length long, content_hash string")
    short = [r.path for r in files if r.length <= large]
    return out.unionAll(hashed(spark.read.format("binaryFile").load(short))) if short else out


def _stream_hash(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
