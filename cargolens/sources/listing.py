"""Listings of uploaded files: their paths and sizes, never what is in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """dossier_id, name, path, size, modified_at of every file below ``path``; a file's folder names its dossier.

    ``pattern``: only file names that match it. The content column isn't selected, so files are listed but not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    parts = F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/")
    return files.select(F.element_at(parts, -2).alias("dossier_id"), F.element_at(parts, -1).alias("name"), "path", "size", "modified_at")
