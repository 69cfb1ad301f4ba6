"""Document classification, token linkage, reading order and entity deduplication."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import SIGNATURES
from ..sources.store import staged

FIRST_PAGES = 2
THRESHOLD = 0.70
#: Types of documents that hold tables of goods.
TABLE_TYPES = ("commercial_invoice", "packing_list", "unknown")


def signatures(spark: SparkSession, of: dict[str, tuple[float, list[str]]] = SIGNATURES) -> DataFrame:
    """document_type, ordinal, weight, n_keywords, keyword: a fixed table of some dozens of rows."""
    rows = [(t, i, w, len(words), k) for i, (t, (w, words)) in enumerate(of.items()) for k in words]
    return spark.createDataFrame(rows, "document_type string, ordinal int, weight double, n_keywords int, keyword string")


def _branches(words: set[str]) -> str:
    """A pattern for the longest of the words that a text goes on with; words that begin alike share their beginning."""
    ways = [re.escape(c) + _branches({w[1:] for w in words if w[:1] == c}) for c in sorted({w[0] for w in words if w})]
    return f"(?:{'|'.join(ways)})" + "?" * ("" in words) if ways else ""


def keyword_hits(docs: DataFrame, of: dict[str, tuple[float, list[str]]] = SIGNATURES, text: str = "text") -> DataFrame:
    """Each document with the stated keywords found in its text, and their document_type, ordinal, weight and n_keywords.

    A text is read once: at each of its places one look-ahead finds the longest keyword that begins there, overlapping
    ones included. The keywords that a found one begins with are there as well.
    """
    spark, words = docs.sparkSession, {k for _, ks in of.values() for k in ks}
    begins = F.create_map(*(x for w in sorted(words) for x in (F.lit(w), F.array(*(F.lit(k) for k in sorted(words) if w.startswith(k))))))
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"(?=({_branches(words)}))"), F.lit(1)))
    each = docs.withColumn("keyword", F.explode(F.array_distinct(F.flatten(F.transform(found, lambda w: F.try_element_at(begins, w))))))
    return each.join(F.broadcast(signatures(spark, of)), "keyword").select(*docs.columns, "document_type", "ordinal", "weight", "n_keywords", "keyword")


def first_pages(tokens: DataFrame, pages: int = FIRST_PAGES) -> DataFrame:
    """document_id, text: the words of each document's first pages, which decide its type."""
    rows = F.array_sort(F.collect_list(F.struct("page", "pos", "text")))
    return tokens.filter(F.col("page") <= pages).groupBy("document_id").agg(F.concat(F.array_join(F.transform(rows, lambda t: t["text"]), " "), F.lit(" ")).alias("text"))


def classify(docs: DataFrame, of: dict[str, tuple[float, list[str]]] = SIGNATURES, id_col: str = "document_id", text: str = "text") -> DataFrame:
    """id, document_type, confidence, evidence: share of keywords found, weighted, as part of all types' scores.

    Ties go to the type stated first; a document without any keyword is unknown, with an equal share of confidence.
    """
    return classified(docs.select(id_col, text), F.col(text), of).drop(text)


def classified(docs: DataFrame, text: Column, of: dict[str, tuple[float, list[str]]] = SIGNATURES) -> DataFrame:
    """``docs`` with document_type, confidence and evidence, as ``classify``: found in each row for itself."""
    none = F.array().cast("array<string>")
    docs = staged(docs, __low=F.lower(text))
    found = lambda words: F.filter(F.array(*map(F.lit, sorted(set(words)))), lambda w: F.contains(F.col("__low"), w))
    docs = staged(docs, **{f"__found{i}": found(words) for i, (_, words) in enumerate(of.values())})
    score = lambda i, w, words: F.round(F.size(F.col(f"__found{i}")) / F.lit(len(words)) * F.lit(w), 4)
    per = F.array(*(F.struct(score(i, w, words).alias("score"), F.lit(-i).alias("back"), F.lit(t).alias("document_type"), F.col(f"__found{i}").alias("evidence")) for i, (t, (w, words)) in enumerate(of.items())))
    docs = staged(docs, __per=F.filter(per, lambda p: F.size(p["evidence"]) > 0))
    best, total = F.array_max("__per"), F.round(F.aggregate("__per", F.lit(0.0), lambda s, p: s + p["score"]), 4)
    return docs.withColumns({"document_type": F.coalesce(best["document_type"], F.lit("unknown")), "confidence": F.coalesce(F.round(best["score"] / total, 4), F.lit(round(1 / len(of), 4))), "evidence": F.coalesce(best["evidence"], none)}).drop("__low", "__per", *(f"__found{i}" for i in range(len(of))))


def choose(keyword: DataFrame, model: DataFrame, id_col: str = "document_id", threshold: float = THRESHOLD) -> DataFrame:
    """The keyword result where it is sure enough or no model result (id, model_type, model_confidence) is there, else the model's."""
    out = keyword.join(model, id_col, "left")
    trust = (F.col("confidence") >= threshold) | F.col("model_type").isNull()
    return out.select(id_col, F.when(trust, F.col("document_type")).otherwise(F.col("model_type")).alias("document_type"), F.when(trust, F.col("confidence")).otherwise(F.col("model_confidence")).alias("confidence"))


def type_of_name(name: Column) -> Column:
    """Document type that a file name tells; an invoice if it tells none."""
    s = F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")
    has = lambda *words: F.rlike(s, F.lit("|".join(words)))
    return F.when(has("packing"), "packing_list").when(has("awb", "waybill"), "awb").when(has("lading", r"\bbl\b"), "bl").when(has("freight"), "freight_invoice").when(has("delivery"), "delivery_order").when(has("credit", r"\blc\b"), "letter_of_credit").otherwise("commercial_invoice")


def deduplicate(e: DataFrame, keys: list[str], confidence: str = "confidence", seq: str = "seq") -> DataFrame:
    """Of a document's entities with equal keys the surest, ties to the first."""
    rest = [c for c in e.columns if c not in keys]
    best = e.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(confidence), -F.col(seq))).alias("b"))
    return best.select(*keys, "b.*").select(*e.columns)


def box_union(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def reading_order(tokens: DataFrame, gap: float = 14.0) -> DataFrame:
    """document_id, page, row, text: rows begin where a token's middle lies more than ``gap`` below its row's first one.

    A page's middles part into islands where neighbours lie more than ``gap`` apart: a row never spans two, so each island's
    distinct middles are folded alone, once. Tokens only take part with their middle, and as the words of their row.
    """
    page = ["document_id", "page"]
    down, within = Window.partitionBy(*page).orderBy("mid"), Window.partitionBy(*page, "island")
    t = tokens.select(*page, ((F.col("y1") + F.col("y2")) / 2).alias("mid"), F.col("x1").alias("x"), "pos", "text").filter("document_id IS NOT NULL AND page IS NOT NULL AND mid IS NOT NULL")
    # windows by page move tokens that lie by document or by page no further; joins would deal them out by middle again
    t = t.withColumn("before", F.lag("mid").over(down)).withColumns({"far": F.coalesce(F.col("mid") - F.col("before") > gap, F.lit(True)).cast("int"), "new": F.coalesce(F.col("mid") != F.col("before"), F.lit(True))})
    t = t.withColumn("island", F.sum("far").over(down)).withColumn("mids", F.collect_list(F.when(F.col("new"), F.col("mid"))).over(within))
    begins = F.aggregate(F.array_sort("mids"), F.array().cast("array<double>"), lambda rows, m: F.when((F.size(rows) == 0) | (m - F.element_at(rows, -1) > gap), F.concat(rows, F.array(m))).otherwise(rows))
    t = t.withColumn("begins", F.when(F.col("far") == 1, begins)).drop("mids", "before", "new").withColumn("begins", F.first("begins", ignorenulls=True).over(within))
    earlier = F.sum(F.when(F.col("far") == 1, F.size("begins"))).over(Window.partitionBy(*page).orderBy("island").rangeBetween(Window.unboundedPreceding, -1))
    row = F.coalesce(earlier, F.lit(0)) + F.size(F.filter("begins", lambda m: m <= F.col("mid"))) - 1
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "pos", "text"))), lambda t: t["text"]), " ")
    return t.select(*page, row.cast("int").alias("row"), "x", "pos", "text").groupBy(*page, "row").agg(line.alias("text"))


def adjacent_values(tokens: DataFrame, labels: list[str], reach: int = 3) -> DataFrame:
    """Tokens that are labels, with the first of the next ``reach`` tokens that holds a digit."""
    w = Window.partitionBy("document_id").orderBy("pos")
    nxt = [F.lead("text", k).over(w) for k in range(1, reach + 1)]
    first = F.coalesce(*(F.when(F.rlike(x, F.lit("[0-9]")), x) for x in nxt))
    return tokens.withColumn("value", first).filter(F.lower("text").isin(*labels)).select("document_id", "pos", F.lower("text").alias("label"), "value")
