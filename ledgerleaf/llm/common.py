"""Shared pieces of the corpus operators: table access, materialisation, fixed-size filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold; bounds what a Python worker keeps at once.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and by bytes, so that very long texts stay cheap.

    Plans are lazy, so the bounds must still hold when the caller runs the result: they are left set
    in the session.
    """
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a fresh
    local one, but only if executors are on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerleaf-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and a
    lost executor costs no recomputation.  ``release`` deletes it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerleaf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` returned and nothing reads any more."""
    for df in tables:
        if df is not None and (path := vars(df).get("written_path")):
            spark = df.sparkSession
            held = spark._jvm.org.apache.hadoop.fs.Path(path)
            held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


#: Rows (or items in them) of a table that may be broadcast: some 30 to 60 MB.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """A written table, marked to be broadcast if it has few rows (or little ``weight`` in all), so
    that the other side, texts above all, is not shuffled; else to be joined by sorting."""
    held = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_ROWS else df.hint("merge")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (names compare case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
