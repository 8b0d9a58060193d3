"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own if all runs on this machine, as in tests; an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: How many bytes a byte of a file counts for the planner: so many that no file is broadcast for its size. Sorted keys and repeated words take next to nothing in Parquet.
UNPACKED = 1_000_000


def sized_by_rows(spark: SparkSession) -> None:
    """From now on this session's planner takes no file for small. By the size of their files, millions of rows of a few columns seem small enough to be
    broadcast through the driver; what is small in fact, adaptive execution still finds and broadcasts by measured sizes."""
    option = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(option)) < UNPACKED:
        spark.conf.set(option, str(UNPACKED))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back: later plans are short, sizes are known to the planner, lost executors cost nothing."""
    spark = df.sparkSession
    sized_by_rows(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
