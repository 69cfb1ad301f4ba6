"""From documents to packed training sequences: rules, exact and near deduplication, mixing, packing.

Each stage reads what the one before it wrote. All but the last return the columns of ``documents``. What mixing decides
is the order of the rows that it writes, which packing reads off the files and follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolens.llm.common import cut, numbered_as_stored, read_table
from cargolens.llm.exact_dedup import drop_exact_duplicates
from cargolens.llm.minhash import drop_near_duplicates
from cargolens.llm.mixing import in_mixed_order
from cargolens.llm.packing import pack, tokenizer_path
from cargolens.llm.quality_rules import keep_good

#: Packing's name for a document's place in the files that it reads.
PLACE = "__place"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles, the one with the smallest id."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves sources to their weights."""
    return in_mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences, which keep the order in which mixing wrote the documents."""
    return pack(numbered_as_stored(docs, PLACE), tokenizer_path(), order_col=PLACE)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_dedup", near), ("mixing", mix), ("packing", packing)]

#: SQL can't express tokenization, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
