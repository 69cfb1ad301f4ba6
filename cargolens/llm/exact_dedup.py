"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

1. Lengths that two or more rows share. 2. Of rows with such a length, the prefix hashes that two or more share. 3. Of
rows with such a prefix, the full text is read and hashed. Each step is a narrow aggregation with map-side partial counts,
so a text that a third of all rows share costs one row per task, and only the last one touches more than a text's
beginning. Shared lengths and prefixes are broadcast after counting them. Beyond ``broadcast_rows`` shared prefixes,
moving the survivors' texts would cost more than hashing every text where it is read, so all are hashed there, and only
lengths, hashes and ids move.

The groups are joined back by their hash. Groups of more than ``common.HOT_ROWS`` rows, of which there are few, are
broadcast after counting them, so that their rows aren't dealt to one task.

Defined results: a null text counts as empty; empty texts are equal to each other. The row with the largest id stays;
null ids lose to any other id, and a group with null ids only keeps them. Rows that repeat an id and its text each
count in ``group_size`` and share their ``kept``. An empty table gives an empty result. Input columns whose names
clash with result columns are replaced in ``exact_duplicates`` and untouched in ``drop_exact_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, read_table, spread_join

_LEN, _PRE, _HASH, _KEEP, _N, _LEFT = (f"__dedup_{x}" for x in ("length", "prefix", "hash", "keep", "n", "left"))


def _shared(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys that two or more rows have."""
    return cut(rows.groupBy(*keys).agg(F.count("*").alias(_N)).filter(F.col(_N) > 1).select(*keys), name)


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _judged(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, broadcast_rows: int, every: bool) -> DataFrame:
    """``docs`` with the reserved columns _HASH, and _KEEP and _N (null for texts that occur once).

    ``every``: _HASH is each text's full hash; else it is that of survivors, and any text that no hash equals for others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumn(_LEN, F.length(text))
    prefix = F.xxhash64(F.substring(text, 1, prefix_chars))
    lengths = _shared(sized, [_LEN], "dedup-lengths")
    if lengths.count() <= broadcast_rows:
        prefixes = _shared(sized.join(F.broadcast(lengths), _LEN, "left_semi").withColumn(_PRE, prefix), [_LEN, _PRE], "dedup-prefixes")
    else:  # only lengths and prefix hashes move
        prefixes = _shared(sized.select(_LEN, prefix.alias(_PRE)).join(lengths, _LEN, "left_semi"), [_LEN, _PRE], "dedup-prefixes")
    if prefixes.count() <= broadcast_rows:
        marked = sized.withColumn(_PRE, prefix).join(F.broadcast(prefixes.withColumn(_LEFT, F.lit(True))), [_LEN, _PRE], "left")
        rows, own = marked.filter(_LEFT).select(F.col(id_col).alias(_KEEP), _hash(text).alias(_HASH)), F.col(_LEFT)
    else:  # the full hash is taken where a text is read, and only it and the id move
        marked = sized
        rows = sized.select(F.col(id_col).alias(_KEEP), _LEN, prefix.alias(_PRE), _hash(text).alias(_HASH)).join(prefixes, [_LEN, _PRE], "left_semi")
        own = F.lit(True)
    groups = cut(rows.groupBy(_HASH).agg(F.max(_KEEP).alias(_KEEP), F.count("*").alias(_N)).filter(F.col(_N) > 1), "dedup-groups")
    full = _hash(text) if every else F.when(own, _hash(text)).otherwise(F.concat(F.lit("~"), F.xxhash64(id_col).cast("string")))
    return spread_join(marked.withColumn(_HASH, full).drop(_LEN, _PRE, _LEFT), groups, _HASH, _N, F.col(id_col), broadcast_rows)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. Every text is hashed, where it is read, since its digest is reported; texts don't move."""
    found = _judged(docs.select(id_col, text_col), id_col, text_col, prefix_chars, broadcast_rows, True)
    keep: Column = F.when(F.col(_N).isNull(), F.col(id_col)).otherwise(F.col(_KEEP))
    return found.select(
        F.col(id_col),
        keep.alias("keep_id"),
        F.coalesce(F.col(_N), F.lit(1)).cast("long").alias("group_size"),
        F.col(id_col).eqNullSafe(keep).alias("kept"),
        F.col(_HASH).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Only texts that share length and prefix with another are hashed whole. Texts stay in place while the groups can be
    broadcast; beyond that, rows are dealt by hash once.
    """
    found = _judged(docs, id_col, text_col, prefix_chars, broadcast_rows, False)
    return found.filter(F.col(_N).isNull() | F.col(id_col).eqNullSafe(F.col(_KEEP))).select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
