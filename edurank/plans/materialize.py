"""Keeping intermediate results in storage every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "edurank-intermediate"
# How often the intermediate tables were dropped; what was kept before is gone.
_dropped = 0


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the session; a scratch folder only where none is named, on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder and folder.startswith(("file:/tmp/", "file:///tmp/")) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{folder} is a folder of one machine; set spark.checkpoint.dir to a shared one")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="edurank-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def generation() -> int:
    """Changes when :func:`drop_intermediate` makes results kept so far unreadable."""
    return _dropped


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, write as Parquet to the shared folder and read back.

    Several consumers then share one computation, lost executors do not matter,
    readers take only the columns they need and joins see the real size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{FOLDER}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all cores by a hash of ``by``, before work that takes long for each row.

    Many short rows are few bytes, so a shuffle would leave them to a few tasks.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def drop_intermediate(spark: SparkSession) -> None:
    """Delete all intermediate tables of the shared folder once no result needs them."""
    global _dropped
    _dropped += 1
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{FOLDER}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
