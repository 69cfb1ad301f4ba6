"""Helpers that the text operators share: table reading, lineage cuts, words and hashes."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words: blank and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Largest number of rows that an operator broadcasts after counting them.
BROADCAST_ROWS = 100_000
#: Largest number of narrow rows that an operator gathers in one partition after counting them.
COMPACT_ROWS = 20_000
#: Rows of a key beyond which its rows aren't dealt by that key. At most one key in so many rows is that hot.
HOT_ROWS = 1_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a new local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers if neither PYTHONPATH nor the working folder does so already."""
    root = Path(__file__).resolve().parents[2]
    if any(Path(p or ".").resolve() == root for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]):
        return
    if not getattr(spark.sparkContext, "_cargolens_shipped", False):
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "cargolens.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in (root / "cargolens").rglob("*.py"):
                z.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(archive)  # served by the driver to every executor
        spark.sparkContext._cargolens_shipped = True


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered_as_stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, a scan of Parquet files that Spark wrote, with ``name``: each row's place, from 0, by number of its file and row in it.

    A scan may read files in any order; this is the order in which they were written. Only file names and counts are joined.
    """
    path = F.col("_metadata.file_path")
    task = F.regexp_extract(F.col("__file"), r"part-(\d+)[^/]*$", 1).cast("long")
    files = df.groupBy(path.alias("__file")).agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy(task, "__file").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    offsets = cut(files.select("__file", F.coalesce(before, F.lit(0)).alias("__before")), "file-offsets")
    rows = df.select("*", path.alias("__at"), F.col("_metadata.row_index").alias("__row"))
    return rows.join(small(offsets), F.col("__at") == F.col("__file")).select(*df.columns, (F.col("__before") + F.col("__row")).alias(name))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a table from ``cut``) marked for broadcast if its counted rows are few, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def compact(df: DataFrame, rows: int = COMPACT_ROWS) -> DataFrame:
    """``df`` (a narrow table from ``cut``) in one partition if its counted rows are few, else as it is.

    Joins and groups of such tables then need no exchange; larger tables take the distributed way.
    """
    return df.coalesce(1) if df.count() <= rows else df


def spread_join(rows: DataFrame, unique: DataFrame, key: str, n: str, spread: Column, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` with ``unique``, a table from ``cut`` with one row per text key and ``n``, how many rows have it.

    A table of few rows is broadcast. Else keys with more than HOT_ROWS rows are broadcast if they are few, and their rows
    are dealt by ``spread`` in the shuffle that joins the other keys.
    """
    if unique.count() <= broadcast_rows:
        return rows.join(F.broadcast(unique), key, "left")
    rest = [c for c in unique.columns if c != key]
    hot = unique.filter(F.col(n) > HOT_ROWS).select(F.col(key).alias("__hot_key"), *(F.col(c).alias(f"__hot_{c}") for c in rest))
    if hot.isEmpty() or hot.count() > broadcast_rows:
        return rows.join(unique, key, "left")
    cold = unique.filter(F.col(n) <= HOT_ROWS).select(F.col(key).alias("__cold_key"), *(F.col(c).alias(f"__cold_{c}") for c in rest))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
    dealt = F.when(F.col("__hot_key").isNull(), F.col(key)).otherwise(F.concat(F.lit("~"), F.xxhash64(spread).cast("string")))
    out = marked.withColumn("__dealt", dealt).join(cold, F.col("__dealt") == F.col("__cold_key"), "left")
    return out.select(*rows.columns, *(F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in rest))


def literal_table(spark: SparkSession, rows: list[tuple], schema: dict[str, str]) -> DataFrame:
    """A small table of stated rows, parsed from one literal: no Python runs on executors for it."""
    body = json.dumps([dict(zip(schema, r, strict=True)) for r in rows])
    kind = "array<struct<" + ",".join(f"{k}:{v}" for k, v in schema.items()) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(body), kind)))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def sealed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each evaluated once per row.

    A filter on a costly column would otherwise be pushed below it with a copy of the whole expression. Spark doesn't
    push filters on what a generator makes below the generator, so the columns come out of one that makes one row.
    """
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def crc_bucket(key: Column, mod: int) -> Column:
    """crc32 of a key written as text, modulo ``mod``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)
