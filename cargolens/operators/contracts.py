"""Checks of incoming data as arrays of violation codes, so that bad rows can be set apart instead of stopping a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import REQUIRED_PROFILE

RESULT_KEYS = "document_id document_type classification_confidence classification_evidence entities raw_ocr processing_time_ms errors".split()
ENTITY_KEYS = "entity_type value normalized_value unit page bbox extraction_confidence classification_confidence normalization_warning".split()
TOKEN_KEYS = "text page bbox ocr_confidence".split()
LONGEST = {"description": 1000, "unit": 50, "source_reference": 500}
LONGEST_METADATA = 200
_MAPS = "array<map<string,string>>"


def _lacking(keys: Column, need: list[str], code: str) -> Column:
    return F.transform(F.array_except(F.array(*map(F.lit, need)), keys), lambda k: F.concat(F.lit(f"{code}:"), k))


def _share(value: Column) -> Column:
    """Whether a text is a number from 0 to 1."""
    return F.coalesce(value.try_cast("double").between(0, 1), F.lit(False))


def _each(rows: Column, need: list[str], name: str, confidences: list[str]) -> Column:
    lacking = F.flatten(F.transform(rows, lambda r: _lacking(F.map_keys(r), need, f"MISSING_{name}_FIELD")))
    unsure = F.exists(rows, lambda r: ~F.forall(F.array(*(F.struct(F.map_contains_key(r, c).alias("k"), _share(F.try_element_at(r, F.lit(c))).alias("s")) for c in confidences)), lambda x: ~x["k"] | x["s"]))
    return F.concat(F.array_sort(F.array_distinct(lacking)), F.array_compact(F.array(F.when(unsure, f"BAD_{name}_CONFIDENCE"))))


def result_violations(raw: Column) -> Column:
    """Codes of what an extraction result's JSON text lacks or states wrongly; an empty array if it keeps the contract.

    All keys there, confidences from 0 to 1, boxes null or four numbers, keys of entities and tokens.
    """
    keys = F.json_object_keys(raw)
    entities = F.coalesce(F.from_json(F.get_json_object(raw, "$.entities"), _MAPS), F.array().cast(_MAPS))
    words = F.coalesce(F.from_json(F.get_json_object(raw, "$.raw_ocr"), _MAPS), F.array().cast(_MAPS))
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
    box = lambda r: F.try_element_at(r, F.lit("bbox"))
    bad_box = F.exists(entities, lambda r: F.coalesce(~F.rlike(box(r), F.lit(rf"^\[\s*{number}(?:\s*,\s*{number}){{3}}\s*\]$")), F.lit(False)))
    sure = ~F.array_contains(keys, "classification_confidence") | _share(F.get_json_object(raw, "$.classification_confidence"))
    found = F.concat(
        F.array_sort(_lacking(keys, RESULT_KEYS, "MISSING_FIELD")), F.array_compact(F.array(F.when(~sure, "BAD_CONFIDENCE"))),
        _each(entities, ENTITY_KEYS, "ENTITY", ["extraction_confidence", "classification_confidence"]), F.array_compact(F.array(F.when(bad_box, "BAD_BOX"))),
        _each(words, TOKEN_KEYS, "TOKEN", ["ocr_confidence"]),
    )
    return F.when(keys.isNull(), F.array(F.lit("NOT_AN_OBJECT"))).otherwise(found)


def line_violations(row: dict[str, Column]) -> Column:
    """Codes for a goods row: description, unit, source_reference (texts), quantity, unit_price, total_price (numbers or texts of them)."""
    text = {k: F.trim(F.coalesce(row[k].cast("string"), F.lit(""))) for k in LONGEST}
    finite = lambda x: F.when((x != F.lit(float("inf"))) & (x != F.lit(float("-inf"))) & ~F.isnan(x), x)
    q, p, t = (finite(row[k].try_cast("double")) for k in ("quantity", "unit_price", "total_price"))
    return F.array_compact(
        F.array(
            F.when(F.least(*(F.length(x) for x in text.values())) == 0, "REQUIRED_TEXT"),
            F.when(F.coalesce(*(F.when(F.length(text[k]) > n, F.lit(True)) for k, n in LONGEST.items())), "TOO_LONG"),
            F.when(q.isNull() | p.isNull() | t.isNull(), "NOT_A_NUMBER"),
            F.when((q <= 0) | (p < 0) | (t <= 0), "NOT_POSITIVE"),
            F.when(F.abs(q * p - t) > F.greatest(t * 0.02, F.lit(0.01)), "TOTAL_MISMATCH"),
        )
    )


def metadata_violations(values: Column, allowed: list[str] = REQUIRED_PROFILE) -> Column:
    """Codes for a map of declaration values: unknown keys, nothing but blanks, a value that is too long."""
    cleaned = cleaned_metadata(values)
    unknown = F.array_sort(F.array_except(F.map_keys(values), F.array(*map(F.lit, allowed))))
    return F.concat(
        F.transform(unknown, lambda k: F.concat(F.lit("UNKNOWN_KEY:"), k)),
        F.array_compact(F.array(F.when(F.size(cleaned) == 0, "EMPTY"), F.when(F.exists(F.map_values(cleaned), lambda v: F.length(v) > LONGEST_METADATA), "TOO_LONG"))),
    )


def cleaned_metadata(values: Column) -> Column:
    """The map without blank values, the others trimmed."""
    trimmed = F.transform_values(values, lambda _, v: F.trim(v))
    return F.map_filter(trimmed, lambda _, v: F.coalesce(v != "", F.lit(False)))


def split(rows: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that don't, with ``violations``)."""
    judged = rows.withColumn("violations", violations)
    return judged.filter(F.size("violations") == 0).drop("violations"), judged.filter(F.size("violations") > 0)
