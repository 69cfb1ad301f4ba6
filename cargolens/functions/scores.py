"""Confidence and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_confidence(ocr: Column, match: Column, warned: Column) -> Column:
    penalty = F.when(F.coalesce(warned, F.lit(False)), 0.85).otherwise(1.0)
    raw = 0.55 * F.coalesce(ocr, F.lit(0.8)) + 0.35 * F.coalesce(match, F.lit(0.75)) + 0.10 * penalty
    return F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.95), raw)), 6), 2)  # first to 6: a sum may lie a hair under a half


def model_confidence(has_box: Column, ocr: Column) -> Column:
    return F.when(~has_box, F.lit(0.55)).otherwise(F.least(F.lit(0.93), (0.82 + ocr) / 2))


def consistent_total(quantity: Column, price: Column, total: Column) -> Column:
    """Quantity times price within 2 % of the total, or a cent."""
    return F.abs(quantity * price - total) <= F.greatest(0.02 * F.abs(total), F.lit(0.01))


def line_item_confidence(quantity: Column, price: Column, total: Column) -> Column:
    known = quantity.isNotNull() & price.isNotNull() & total.isNotNull() & (quantity > 0) & (price > 0) & (total > 0)
    return F.when(~known, F.lit(0.75)).when(F.abs(quantity * price - total) <= 0.02 * F.abs(total) + 0.01, F.lit(0.92)).otherwise(F.lit(0.70))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")


def close(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    """Within a share of the expected value, at least 1e-9."""
    return F.abs(a - b) <= F.greatest(F.abs(b) * tolerance, F.lit(1e-9))


def plain_words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.trim(F.replace(F.lower(text), F.lit("."), F.lit(""))), r"\s+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    x, y = plain_words(a), plain_words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), F.lit(False)), dot(a, b) / norm).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column, vector_a: Column | None = None, vector_b: Column | None = None) -> Column:
    """1 for equal texts; else cosine where both vectors are there, else Jaccard of the words."""
    same = F.regexp_replace(F.lower(F.trim(a)), r"\.", "") == F.regexp_replace(F.lower(F.trim(b)), r"\.", "")
    other = jaccard(a, b)
    if vector_a is not None and vector_b is not None:
        other = F.when(vector_a.isNotNull() & vector_b.isNotNull(), cosine(vector_a, vector_b)).otherwise(other)
    return F.when(same, 1.0).otherwise(other)


def spread_scores(types: Column, winner: Column, confidence: Column) -> Column:
    """Map of type to score: the winner keeps its confidence, the others share the rest."""
    rest = F.round((1 - confidence) / (F.size(types) - 1), 4)
    return F.map_from_arrays(types, F.transform(types, lambda t: F.when(t == winner, F.round(confidence, 4)).otherwise(rest)))
