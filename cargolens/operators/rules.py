"""Match and consistency rules over flagged assertions and resolved fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import AUTHORITY, DEFAULT_AUTHORITY, SEVERITY, SEVERITY_RANK
from ..functions.scores import similarity
from .consensus import CARRIED, FIELD, TOLERANCE, canonical
from .linkage import may_reach, ratio

MATCH = 0.85


def outlier_pairs(flagged: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Each outlier (b_*) with the earliest assertion that isn't one, its field's representative (a_*), and the columns ``also``."""
    cols = [c for c in CARRIED if c in flagged.columns]
    return flagged.filter("is_outlier").select(*FIELD, "is_num", *(F.col(f"representative.{c}").alias(f"a_{c}") for c in cols), *(F.col(c).alias(f"b_{c}") for c in cols), *also)


def failures(pairs: DataFrame) -> DataFrame:
    """Pairs that break a rule: numbers more than TOLERANCE apart, texts less similar than MATCH. Mixed pairs never fail."""
    kind = F.when(F.col("a_num").isNotNull() & F.col("b_num").isNotNull(), "numeric").when(F.col("a_txt").isNotNull() & F.col("b_txt").isNotNull(), "text")
    delta, like = F.abs(F.col("a_num") - F.col("b_num")), similarity(F.col("a_txt"), F.col("b_txt"))
    # the one row that the generator makes holds what is costly: Spark would else take it once more for each use
    once = F.struct(kind.alias("kind"), F.when(kind == "numeric", delta).alias("delta"), F.when(kind == "text", like).alias("similarity"))
    out = pairs.select("*", F.inline(F.array(once)))
    out = out.filter(((F.col("kind") == "numeric") & (F.col("delta") > TOLERANCE)) | ((F.col("kind") == "text") & (F.col("similarity") < MATCH)))
    rule = F.when(F.col("kind") == "numeric", "NUMERIC_MATCH").otherwise("TEXT_MATCH")
    return out.withColumns({"rule": rule, "delta_text": F.when(F.col("kind") == "numeric", F.format_string("difference of %.2f", F.col("delta")))})


def discrepancies(failed: DataFrame) -> DataFrame:
    """Records of failures: id, severity (high for numbers), score 1 - product of confidences, both sources."""
    source = lambda x: F.struct(F.col(f"{x}_document_id").alias("document_id"), canonical(F.col(f"{x}_num"), F.col(f"{x}_txt")).alias("value"), F.col(f"{x}_confidence").alias("confidence"))
    return failed.withColumns({
        "discrepancy_id": F.concat_ws("_", "rule", "a_document_id", "b_document_id", "entity_type"),
        "severity": F.when(F.col("kind") == "numeric", "high").otherwise("medium"),
        "severity_score": F.round(1 - F.col("a_confidence") * F.col("b_confidence"), 4),
        "sources": F.array(source("a"), source("b")),
    })


def severity(entity_type: Column) -> Column:
    out = F.when(F.lit(False), "medium")
    for tier, names in SEVERITY.items():
        out = out.when(entity_type.isin(*names), tier)
    return out.otherwise("medium")


def tiered(conflicts: DataFrame) -> DataFrame:
    """Conflicts with severity by field, its rank, and their place within the shipment."""
    rank = F.when(F.col("severity") == "high", SEVERITY_RANK["high"]).when(F.col("severity") == "medium", SEVERITY_RANK["medium"]).otherwise(SEVERITY_RANK["low"])
    out = conflicts.withColumn("severity", severity(F.col("entity_type"))).withColumn("rank", rank)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("shipment_id").orderBy(F.desc("rank"), "entity_type")))


def must_match(edges: DataFrame, a: DataFrame) -> DataFrame:
    """Stated pairs (FIELD, a_seq, b_seq) whose numbers differ."""
    left, right = (a.select(*FIELD, F.col("seq").alias(f"{x}_seq"), F.col("num").alias(f"{x}_num")) for x in "ab")
    return edges.join(left, [*FIELD, "a_seq"]).join(right, [*FIELD, "b_seq"]).filter(F.abs(F.col("a_num") - F.col("b_num")) > TOLERANCE)


def weight_inconsistent(w: DataFrame, limit: float = 0.5) -> DataFrame:
    return w.filter(F.abs(F.col("net") + F.col("tare") - F.col("gross")) > limit)


def cif_inconsistent(f: DataFrame, limit: float = 1.0) -> DataFrame:
    """Declared totals that differ from what the terms make of total, freight and insurance; other terms aren't checked.

    Differences are told to four places, so that the last bits of a sum don't decide at the limit.
    """
    calculated = F.when(F.col("incoterm").isin("FOB", "EXW"), F.col("total") + F.col("freight") + F.col("insurance")).when(F.col("incoterm").isin("CIF", "CIP"), F.col("total"))
    return f.withColumn("calculated", calculated).filter(F.round(F.abs(F.col("calculated") - F.col("declared")), 4) > limit)


def relative_conflicts(a: DataFrame, share: float = 0.005) -> DataFrame:
    """Fields with any two numbers further apart than a share of the larger: the extremes decide."""
    r = a.groupBy(*FIELD).agg(F.max("num").alias("high"), F.min("num").alias("low"))
    return r.filter(F.col("high") - F.col("low") > share * F.greatest(F.abs("high"), F.abs("low")))


def text_conflicts(a: DataFrame, share: float = 0.90, exact: tuple[str, ...] = ("HS_CODE",)) -> DataFrame:
    """Fields with any two texts that differ by more than case (those of ``exact`` types), or whose ratio is under ``share``.

    Texts are folded to the distinct ones of a field first. Lengths alone settle most pairs; the ratio is taken of the rest.
    """
    v = a.filter("txt IS NOT NULL").select(*FIELD, F.lower(F.trim("txt")).alias("v")).distinct()
    pairs = v.join(v.withColumnRenamed("v", "w"), FIELD).filter("v < w")
    strict = F.col("entity_type").isin(*exact)
    sure = pairs.filter(strict | ~may_reach(F.col("v"), F.col("w"), share)).select(*FIELD)
    rest = pairs.filter(~strict & may_reach(F.col("v"), F.col("w"), share))
    return sure.unionByName(rest.filter(ratio(F.col("v"), F.col("w")) < share).select(*FIELD)).distinct()


def authority(document_type: Column, entity_type: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for d, fields in AUTHORITY.items() for e, w in fields.items() for x in (f"{d}/{e}", w)))
    return F.coalesce(F.try_element_at(pairs, F.concat_ws("/", document_type, entity_type)), F.lit(DEFAULT_AUTHORITY))


def truth(a: DataFrame) -> DataFrame:
    """Each field's value with the greatest sum of authority times confidence; ties go to the earliest."""
    v = a.withColumn("value", canonical(F.col("num"), F.col("txt"))).groupBy(*FIELD, "value")
    v = v.agg(F.round(F.sum(F.col("confidence") * authority(F.col("document_type"), F.col("entity_type"))), 4).alias("truth_score"), F.min("seq").alias("first"))
    best = v.groupBy(*FIELD).agg(F.max_by(F.struct("value", "truth_score"), F.struct("truth_score", -F.col("first"))).alias("b"))
    return best.select(*FIELD, "b.*")
