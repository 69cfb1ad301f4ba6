"""Cross-document consensus of a shipment's fields.

Inputs are assertions: shipment_id, entity_type, seq (order of evidence), num, txt, is_num, unit, confidence and what
else the caller carries. A field is one (shipment, entity type). Equal values are first folded to one row per value with
map-side partial sums, so a value that very many documents repeat costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import text_key
from ..sources.store import kept
from .fold import folded
from .islands import islands

FIELD = ["shipment_id", "entity_type"]
TOLERANCE = 0.01
#: Assertions of a field beyond which its numbers are folded by islands instead of in one row; the results are the same.
LARGE = 1000


def canonical(num: Column, txt: Column) -> Column:
    """Text that a value is compared by: whole numbers without a point."""
    n = F.when(num == F.floor(num), num.cast("decimal(38,0)").cast("string")).otherwise(num.cast("string"))
    return F.coalesce(txt, n, F.lit(""))


def _values(a: DataFrame, key: Column) -> DataFrame:
    rows = a.withColumn("key", key)
    first = F.struct("seq", "num", "txt")
    return rows.groupBy(*FIELD, "key").agg(F.count("*").alias("n"), F.sum("confidence").alias("weight"), F.min(first).alias("first"))


def text_consensus(a: DataFrame) -> DataFrame:
    """Largest cluster of equal text keys by (count, confidence, earliest): FIELD, consensus_key, consensus_txt, n_agree, n_clusters."""
    v = _values(a, text_key(canonical(F.col("num"), F.col("txt"))))
    rank = F.struct(F.col("n"), F.round("weight", 6).alias("w"), (-F.col("first.seq")).alias("s"))
    best = v.groupBy(*FIELD).agg(F.max_by(F.struct("key", "first", "n"), rank).alias("b"), F.count("*").alias("n_clusters"))
    return best.select(*FIELD, F.col("b.key").alias("consensus_key"), canonical(F.col("b.first.num"), F.col("b.first.txt")).alias("consensus_txt"), F.col("b.n").alias("n_agree"), "n_clusters")


#: What of an assertion stays with it as the representative of its field, where the input has it.
CARRIED = ("seq", "document_id", "num", "txt", "confidence", "page", "bbox")


def _folded(items: Column) -> Column:
    """Greedy numeric clusters of ``items`` (seq, num, n, w, first) in order; the winner as a struct, and their number."""
    none = F.slice(F.transform(items, lambda x: F.struct(x["num"].alias("num"), x["n"].alias("n"), x["w"].alias("w"), x["first"].alias("first"))), 1, 0)

    def add(clusters: Column, x: Column) -> Column:
        at = F.coalesce(F.array_min(F.transform(clusters, lambda c, i: F.when(F.abs(c["num"] - x["num"]) <= TOLERANCE, i))), F.lit(-1))
        one = lambda c, n, w: F.struct(c["num"].alias("num"), n.alias("n"), w.alias("w"), c["first"].alias("first"))
        grown = F.transform(clusters, lambda c, i: F.when(i == at, one(c, c["n"] + x["n"], c["w"] + x["w"])).otherwise(c))
        return F.when(at >= 0, grown).otherwise(F.concat(clusters, F.array(one(x, x["n"], x["w"]))))

    def winner(clusters: Column) -> Column:
        best = F.array_max(F.transform(clusters, lambda c: F.struct(c["n"].alias("n"), F.round(c["w"], 6).alias("w"), (-c["first"]["seq"]).alias("s"), c["num"].alias("num"), c["first"].alias("first"))))
        return F.struct(best.alias("best"), F.size(clusters).cast("long").alias("n_clusters"))

    return F.aggregate(F.array_sort(items), none, add, winner)


def _large(a: DataFrame, most: int) -> DataFrame | None:
    """Fields with more than ``most`` assertions, None if there are none: a count that reads the field's two columns only."""
    many = a.groupBy(*FIELD).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*FIELD)
    return None if many.isEmpty() else kept(many, "large-fields")


def _by_islands(v: DataFrame) -> DataFrame:
    """FIELD, x (best, n_clusters) of rows with an item each (seq, num, n, w, first).

    Sorted by number, values part into islands where neighbours lie further apart than the tolerance. A value and its
    cluster's first one are never in two islands, so each island is folded alone, and the field's best is the best of all.
    """
    apart = islands(v.withColumn("__num", F.col("item.num")), FIELD, "__num", lambda x, y: F.coalesce(y - x > TOLERANCE, F.lit(True)))
    per = apart.groupBy(*FIELD, "island").agg(_folded(F.collect_list("item")).alias("x"))
    return per.groupBy(*FIELD).agg(F.struct(F.max("x.best").alias("best"), F.sum("x.n_clusters").alias("n_clusters")).alias("x"))


def numeric_consensus(a: DataFrame, large: int = LARGE) -> DataFrame:
    """Greedy clusters in order of evidence: a value joins the first cluster whose first member is within TOLERANCE.

    FIELD, consensus_num, n_agree, n_clusters. Only distinct values are folded: repeats always follow their first one.
    """
    v = _values(a, F.col("num"))
    item = F.struct(F.col("first.seq").alias("seq"), F.col("first.num").alias("num"), "n", F.col("weight").alias("w"), "first")
    v = v.select(*FIELD, item.alias("item"))
    many = _large(a, large)
    rest = v if many is None else v.join(many, FIELD, "left_anti")
    per = rest.groupBy(*FIELD).agg(_folded(F.collect_list("item")).alias("x"))
    if rest is not v:
        per = per.unionByName(_by_islands(v.join(many, FIELD, "left_semi")))
    return per.select(*FIELD, F.col("x.best.num").alias("consensus_num"), F.col("x.best.n").alias("n_agree"), F.col("x.n_clusters").alias("n_clusters"))


def resolve(a: DataFrame, large: int = LARGE, carried: tuple[str, ...] = CARRIED, chosen: str | None = None) -> DataFrame:
    """One row per field: status, consensus_num, consensus_txt, unit, resolution_confidence, n_assertions, n_agree, n_clusters, representative.

    Values count as numbers only if all of a field's values are. pending: one assertion; match: all agree; warning: all
    agree but units differ; else conflict. The representative is the earliest assertion that agrees with the consensus.

    Fields are folded in arrays, shipment by shipment (``fold``), those with more than ``large`` assertions by
    aggregations and islands. ``carried`` names what a representative keeps of its assertion, beside seq, num and txt.
    ``chosen`` names a flag of assertions; fields then also have the values of their last one with it (num, txt), or null.
    """
    carried = _carried(a, carried)
    many = _large(a, large)
    few = folded(a if many is None else a.join(many, FIELD, "left_anti"), canonical(F.col("num"), F.col("txt")), carried, TOLERANCE, chosen=chosen)
    c, texts = F.col, canonical(F.col("representative.num"), F.col("representative.txt"))
    few = few.select(
        *FIELD, "status", F.when(c("all_num"), c("representative.num") + F.lit(0.0)).alias("consensus_num"), F.when(~c("all_num"), texts).alias("consensus_txt"), F.when(~c("all_num"), text_key(texts)).alias("consensus_key"),
        "unit", F.round(F.round(c("sum_w") / c("n_assertions"), 8), 4).alias("resolution_confidence"), "n_assertions", "n_agree", "n_clusters", "representative", *(["chosen"] if chosen else []),
    )
    if many is None:
        return few
    rest = a.join(many, FIELD, "left_semi")
    fields = _resolve_large(rest, carried)
    if chosen:
        fields = fields.join(rest.filter(F.col(chosen)).groupBy(*FIELD).agg(F.max_by(F.struct("num", "txt"), "seq").alias("chosen")), FIELD, "left")
    return few.unionByName(fields)


def _carried(a: DataFrame, carried: tuple[str, ...]) -> list[str]:
    return [c for c in CARRIED if c in a.columns and (c in carried or c in ("seq", "num", "txt"))]


def _resolve_large(a: DataFrame, carried: list[str]) -> DataFrame:
    """``resolve`` for fields with very many assertions: those are folded to one row per value and unit, those to one per text key, those to one per field; numbers by islands."""
    n_, w_ = F.sum("n").alias("n"), F.sum("w").alias("w")
    values = a.groupBy(*FIELD, "is_num", "num", "txt", "unit").agg(F.count("*").alias("n"), F.sum("confidence").alias("w"), F.min_by(F.struct(*carried), "seq").alias("first"))
    weight = F.coalesce("w", F.lit(0.0)).alias("w")  # confidences that are null count as nothing
    value = F.struct(F.col("first.seq").alias("seq"), "num", "n", weight, "first")
    rank = F.struct(F.col("n"), F.round(weight, 6).alias("w"), (-F.col("first.seq")).alias("s"))

    keys = values.withColumn("key", text_key(canonical(F.col("num"), F.col("txt")))).groupBy(*FIELD, "key").agg(
        n_, w_, F.min_by("first", "first.seq").alias("first"), F.bool_and("is_num").alias("all_num"),
        F.collect_set(F.when(F.col("unit") != "", F.lower("unit"))).alias("units"), F.min(F.when(F.col("unit").isNotNull(), F.struct("first.seq", "unit"))).alias("unit"),
    )
    roll = keys.groupBy(*FIELD).agg(
        F.sum("n").alias("n_assertions"), F.round(F.round(F.sum("w") / F.sum("n"), 8), 4).alias("resolution_confidence"), F.count("*").alias("n_keys"), F.max_by(F.struct("key", "first", "n"), rank).alias("text"),
        F.size(F.array_distinct(F.flatten(F.collect_set("units")))).alias("n_units"), F.min("unit")["unit"].alias("unit"), F.bool_and("all_num").alias("all_num"),
    )
    number = _by_islands(values.filter("is_num").select(*FIELD, value.alias("item")))
    roll = roll.join(number, FIELD, "left").withColumn("number", F.when(F.col("all_num"), F.col("x"))).drop("x")
    c = F.col
    either = lambda x, y: F.when(c("all_num"), c(x)).otherwise(c(y))
    clusters = either("number.n_clusters", "n_keys")
    status = F.when(c("n_assertions") == 1, "pending").when(clusters > 1, "conflict").when(c("n_units") > 1, "warning").otherwise("match")
    return roll.select(
        *FIELD, status.alias("status"), c("number.best.num").alias("consensus_num"), F.when(~c("all_num"), canonical(c("text.first.num"), c("text.first.txt"))).alias("consensus_txt"), F.when(~c("all_num"), c("text.key")).alias("consensus_key"),
        "unit", "resolution_confidence", "n_assertions", either("number.best.n", "text.n").alias("n_agree"), clusters.alias("n_clusters"), either("number.best.first", "text.first").alias("representative"),
    )


def flagged(a: DataFrame, fields: DataFrame) -> DataFrame:
    """Assertions with their field's status and representative, is_consensus, is_outlier (only under conflict) and, for numbers, variance from the consensus."""
    f = fields.select(*FIELD, "status", "consensus_num", "consensus_key", *(["representative"] if "representative" in fields.columns else []))
    numeric = F.col("consensus_num").isNotNull()
    agrees = F.when(numeric, F.abs(F.col("num") - F.col("consensus_num")) <= TOLERANCE).otherwise(text_key(canonical(F.col("num"), F.col("txt"))) == F.col("consensus_key"))
    out = a.join(f, FIELD).withColumn("is_consensus", F.coalesce(agrees, F.lit(False)))
    return out.withColumns({"is_outlier": (F.col("status") == "conflict") & ~F.col("is_consensus"), "variance": F.when(numeric, F.round(F.abs(F.col("num") - F.col("consensus_num")), 4))}).drop("consensus_num", "consensus_key")


def judged(a: DataFrame, keep: list[str], carried: tuple[str, ...] = CARRIED, outliers: bool = False, large: int = LARGE) -> DataFrame:
    """``flagged(a, resolve(a))`` in one pass over the assertions, with the columns ``keep`` of ``a``; with ``outliers`` only those."""
    many, carried = _large(a, large), _carried(a, carried)
    keep = list(dict.fromkeys([*FIELD, "seq", "num", "txt", *keep]))
    few = folded(a if many is None else a.join(many, FIELD, "left_anti"), canonical(F.col("num"), F.col("txt")), carried, TOLERANCE, keep, outliers)
    few = few.withColumns({"is_outlier": (F.col("status") == "conflict") & ~F.col("is_consensus"), "variance": F.round(F.abs(F.col("num") - F.col("consensus_num")), 4)}).drop("consensus_num")
    if many is None:
        return few
    rest = a.join(many, FIELD, "left_semi")
    rest = flagged(rest, _resolve_large(rest, carried)).select(*few.columns)
    return few.unionByName(rest.filter("is_outlier") if outliers else rest)


def overlay(fields: DataFrame, choices: DataFrame) -> DataFrame:
    """Reviewer decisions (FIELD, value_num, value_txt) replace the consensus; such fields are resolved."""
    c = choices.select(*FIELD, F.struct(F.col("value_num").alias("num"), F.col("value_txt").alias("txt")).alias("chosen"))
    return _overlaid(fields.join(c, FIELD, "left"))


def overlay_own(a: DataFrame, chosen: str, carried: tuple[str, ...] = CARRIED, large: int = LARGE) -> DataFrame:
    """``overlay`` of the fields of ``a`` with the last of their assertions that is flagged ``chosen``, in the pass that resolves them."""
    return _overlaid(resolve(a, large, carried, chosen))


def _overlaid(fields: DataFrame) -> DataFrame:
    there, c = F.col("chosen").isNotNull(), F.col
    return fields.withColumns({"status": F.when(there, "resolved").otherwise(c("status")), "consensus_num": F.when(there, c("chosen.num")).otherwise(c("consensus_num")), "consensus_txt": F.when(there, c("chosen.txt")).otherwise(c("consensus_txt"))}).drop("chosen")


def validated(choices: DataFrame, a: DataFrame) -> DataFrame:
    """``choices`` (FIELD, seq) with why each is rejected: UNKNOWN_FIELD, UNKNOWN_ASSERTION, or null if it may stand."""
    known = a.select(*FIELD, "seq").distinct().withColumn("__there", F.lit(True))
    fields = a.select(*FIELD).distinct().withColumn("__field", F.lit(True))
    out = choices.join(fields, FIELD, "left").join(known, [*FIELD, "seq"], "left")
    return out.withColumn("rejected", F.when(F.col("__field").isNull(), "UNKNOWN_FIELD").when(F.col("__there").isNull(), "UNKNOWN_ASSERTION")).drop("__field", "__there")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last one by ``order``: an upsert as union and latest-wins, with partial maxima."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*rows.columns)
