"""Party roles from an organisation's own name, and from labels near a value on the page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import PARTY_TYPES
from ..functions.normalize import party_role
from ..sources.store import kept, shuffled
from .linkage import contained, parted

ACCEPT = 0.75


def named_role(value: Column) -> Column:
    """Role that an organisation's own name tells."""
    v = F.lower(value)
    return F.when(F.rlike(v, F.lit(r"\b(?:bank|bancorp|banking)\b")), "issuing_bank").when(F.rlike(v, F.lit(r"\b(?:air|airlines?|air cargo|airways|cargo)\b")), "carrier")


#: How far apart values and labels may be for each kind of evidence, and the width of the bands that they are dealt to.
ROW_REACH, BELOW_REACH, SIDE_REACH, SLACK = 48, 180, 180, 16


def _bands(low: Column, high: Column, width: int) -> Column:
    """The bands of ``width`` that the stretch from low to high touches."""
    return F.sequence(F.floor(low / width), F.floor(high / width))


def _near(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Values with the labels of their page that may be evidence: on the same row to their left, or above them.

    A label is dealt to the bands in which a value may lie for which it counts: of y for values on its row, which may be
    any way to the right, of y and x for those below it. A value is dealt to the bands of its middle, and of its upper left
    corner. So a value meets the labels near it, however many its page has.
    """
    mid = lambda y1, y2: (F.col(y1) + F.col(y2)) / 2
    ry, by, bx = ROW_REACH, BELOW_REACH + SLACK, SIDE_REACH
    row = labels.select("*", F.lit("row").alias("way"), F.explode(_bands(mid("t_y1", "t_y2") - ry, mid("t_y1", "t_y2") + ry, ry)).alias("band_y"), F.lit(0).cast("long").alias("band_x"))
    below = labels.select("*", F.lit("below").alias("way"), F.explode(_bands(F.col("t_y2") - SLACK, F.col("t_y2") + BELOW_REACH, by)).alias("band_y"), F.explode(_bands(F.col("t_x1") - bx, F.col("t_x1") + bx, bx)).alias("band_x"))
    own = lambda way, y, x: F.struct(F.lit(way).alias("way"), F.floor(y).alias("band_y"), F.floor(x).alias("band_x"))
    dealt = values.select("*", F.inline(F.array(own("row", mid("y1", "y2") / ry, F.lit(0)), own("below", F.col("y1") / by, F.col("x1") / bx))))
    return dealt.join(row.unionByName(below), ["document_id", "page", "way", "band_y", "band_x"])


def _seen(v: Callable[[str], Column], t: Callable[[str], Column]) -> tuple[Column, Column, Column, Column]:
    """Whether a value (its columns by name) is on the row of a token, and whether it is below it, and the score of each."""
    same_row = (F.abs((v("y1") + v("y2")) / 2 - (t("y1") + t("y2")) / 2) <= ROW_REACH) & (v("x1") >= t("x2") - SLACK)
    down = v("y1") - t("y2")
    below = (down >= -SLACK) & (down <= BELOW_REACH) & (F.abs(v("x1") - t("x1")) <= SIDE_REACH)
    across = F.least(F.greatest(v("x1") - t("x2"), F.lit(0)), F.lit(300))
    return same_row, below, 0.92 - across / 3000, 0.82 - F.least(down, F.lit(160)) / 1600


def nearest_role(value: Column, page: Column, box: Column, tokens: Column) -> Column:
    """The role that the nearest role label among a document's ``tokens`` gives a value, by the scores of ``label_evidence``; null if none does."""
    plain = F.lower(F.trim(value))

    def scored(t: Column) -> Column:
        same_row, below, beside, under = _seen(box.getField, t.getField)
        holds = (plain != "") & F.contains(t["text"], F.lit(":")) & F.contains(F.lower(t["text"]), plain)
        return F.struct(F.round(F.when(holds, F.lit(1.0)).when(same_row, beside).when(~same_row & below, under), 6).alias("score"), (-t["pos"]).alias("back"), t["text"].alias("text"))

    near = F.filter(F.transform(F.filter(tokens, lambda t: t["page"] == page), scored), lambda x: x["score"] >= ACCEPT)
    named = F.transform(near, lambda x: F.struct(x["score"].alias("score"), x["back"].alias("back"), party_role(x["text"]).alias("role")))
    return F.array_max(F.filter(named, lambda x: x["role"].isNotNull()))["role"]


def label_evidence(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """Values (document_id, page, value_id, value, x1, y1, x2, y2) to role and score of the nearest role label.

    The same token with a colon 1.0; on the same row, to the right of a label, 0.92 less distance; below a label 0.82
    less distance. Only label tokens enter the joins: on pages of few pairs each value meets each label; on the others by
    the bands near a value, and for tokens that hold label and value by the value's text. A value whose own name tells
    its role doesn't ask for labels.
    """
    pages = ["document_id", "page"]
    t = tokens.withColumn("role", F.explode(F.array(party_role(F.col("text"))))).filter("role IS NOT NULL")  # a generator's column is taken once
    t = kept(t.select(*pages, "role", F.col("pos").alias("t_pos"), F.col("text").alias("t_text"), *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2"))), "labels")
    asked = values.filter(named_role(F.col("value")).isNull())
    same_row, below, beside, under = _seen(F.col, lambda c: F.col(f"t_{c}"))
    rest = ["document_id", "value_id", "role", "score", "t_pos"]
    few_v, few_t, many_v, many_t = parted(asked, t, pages)
    plain = F.lower(F.trim("value"))
    holds = (plain != "") & F.contains("t_text", F.lit(":")) & F.contains(F.lower("t_text"), plain)
    scored = shuffled(few_v).join(few_t, pages).withColumn("score", F.when(holds, F.lit(1.0)).when(same_row, beside).when(~same_row & below, under)).select(*rest)
    if many_v is not None:
        near = _near(many_v, many_t.drop("t_text")).withColumn("score", F.when((F.col("way") == "row") & same_row, beside).when((F.col("way") == "below") & ~same_row & below, under))
        # a label's own token holds the value, which is then one of the texts that its colons leave
        held = many_t.filter(F.contains("t_text", F.lit(":"))).select(*pages, "role", "t_pos", F.lower("t_text").alias("h")).distinct()
        inside = contained(many_v.select(*pages, plain.alias("n")).distinct(), held.select(*pages, "h").distinct(), pages).join(held, [*pages, "h"])
        own = many_v.withColumn("n", plain).join(inside, [*pages, "n"]).withColumn("score", F.lit(1.0))
        scored = scored.unionByName(near.select(*rest)).unionByName(own.select(*rest))
    scored = scored.withColumn("score", F.round("score", 6)).filter(F.col("score") >= ACCEPT)
    best = scored.groupBy("document_id", "value_id").agg(F.max_by(F.struct("role", "score"), F.struct("score", -F.col("t_pos"))).alias("b"))
    return best.select("document_id", "value_id", "b.*")


def roles(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """``values`` with their role: what their name tells, else the nearest label's; null if neither does."""
    near = label_evidence(values, tokens).select("document_id", "value_id", F.col("role").alias("__near"))
    return values.join(near, ["document_id", "value_id"], "left").withColumn("role", F.coalesce(named_role(F.col("value")), "__near")).drop("__near")


def resolve_party(entities: DataFrame) -> DataFrame:
    """``entities`` (entity_type, role) with effective_type and eligible.

    Only names found as consignees are judged: a consignee stays one, another role gives its own type, and without a
    role there is no type. Only consignees may become the shipment's.
    """
    effective, may = resolved(F.col("entity_type"), F.col("role"))
    return entities.withColumns({"effective_type": effective, "eligible": may})


def resolved(entity_type: Column, role: Column) -> tuple[Column, Column]:
    """effective_type and eligible of ``resolve_party``."""
    own = F.try_element_at(F.create_map(*(F.lit(x) for kv in PARTY_TYPES.items() for x in kv)), role)
    consignee = F.coalesce(role == "consignee", F.lit(False))
    judged = entity_type == "CONSIGNEE_NAME"
    return F.when(~judged | consignee, entity_type).otherwise(own), ~judged | consignee


def eligible(a: DataFrame, flag: str = "eligible", role: str = "role") -> DataFrame:
    """Assertions that may speak for the consignee: by their flag, or where it is missing by a role that isn't another one. Other fields stay."""
    again = F.col(role).isNull() | (F.col(role) == "consignee")
    return a.filter((F.col("entity_type") != "CONSIGNEE_NAME") | F.coalesce(F.col(flag), again))
