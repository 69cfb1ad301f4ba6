"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; in local mode only, a new local folder is made where it isn't set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under a shared path and read back: what several branches use is made once. Not broadcast, see ``shuffled``."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return shuffled(df.sparkSession.read.schema(df.schema).parquet(path))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` not to be broadcast, nor what it is next joined with.

    Spark takes the bytes of files for the size of a table, but compressed texts and rows made by an explode are many times
    that: such tables were broadcast whole by way of the driver.
    """
    return df.hint("merge")


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each made once per row however often later steps refer to it: they come out of a generator that makes one row."""
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))
