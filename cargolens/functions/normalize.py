"""Normalisation of raw field values as column expressions. Every function is null-safe and never fails on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import CURRENCY_ALIASES, INCOTERM_ALIASES, INCOTERM_ORDER, NULL_WORDS, PARTY_ROLE_LABELS


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def number(raw: Column) -> Column:
    """First signed number of a text, with European or American separators; null if there is none.

    A digit followed by the letter O is a misread zero and makes the number invalid.
    """

    def plain(t: Column) -> Column:
        comma, dot = F.locate(",", F.reverse(t)), F.locate(".", F.reverse(t))
        no_commas, decimal_comma = F.replace(t, F.lit(","), F.lit("")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return (
            F.when((comma > 0) & (dot > 0), F.when(comma < dot, decimal_comma).otherwise(no_commas))
            .when(comma > 0, F.when(F.rlike(t, F.lit(r",[0-9]{3}$")), no_commas).otherwise(decimal_comma))
            .otherwise(t)
        )

    def parsed(s: Column) -> Column:
        token = F.regexp_replace(F.regexp_extract(s, r"[-+]?[0-9][0-9.,]*", 0), r"[.,]+$", "")
        return F.when(~F.rlike(s, F.lit("[0-9]O")), F.regexp_extract(let(token, plain), r"[-+]?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double"))

    return let(F.regexp_replace(F.upper(F.trim(raw)), r"^[A-Z]{3}\s*", ""), parsed)


def _value(num: Column, unit: Column, warn: Column) -> Column:
    """(value, unit, warn); without a number all else is null and the warning is set."""
    return F.struct(num.alias("value"), F.when(num.isNotNull(), unit).alias("unit"), (num.isNull() | warn).alias("warn"))


def _word(text: Column, words: str) -> Column:
    return F.rlike(F.lower(F.trim(text)), F.lit(rf"\b(?:{words})\b"))


def weight(raw: Column) -> Column:
    kg, lb, tonne, g = _word(raw, "kg|kgs|kilogram|kilograms"), _word(raw, "lb|lbs|pound|pounds"), _word(raw, "mt|metric ton|metric tons|tonne|tonnes"), _word(raw, "g|gram|grams")
    unit = F.when(kg, "kg").when(lb, "lb").when(tonne, "t").when(g, "g")
    return let(
        F.struct(number(raw).alias("n"), unit.alias("u")),
        lambda x: _value(
            F.when(x["u"] == "lb", F.round(x["n"] * 0.453592, 3)).when(x["u"] == "t", F.round(x["n"] * 1000.0, 3)).when(x["u"] == "g", F.round(x["n"] / 1000.0, 6)).otherwise(x["n"]), F.lit("kg"), x["u"].isNull()
        ),
    )


def volume(raw: Column) -> Column:
    cbm = _word(raw, "cbm|m3|cubic meter|cubic meters") | F.rlike(F.lower(raw), F.lit("\\bm\u00b3"))
    unit = F.when(cbm, "cbm").when(_word(raw, "l|liter|liters|litre|litres"), "l")
    return let(F.struct(number(raw).alias("n"), unit.alias("u")), lambda x: _value(F.when(x["u"] == "l", F.round(x["n"] * 0.001, 6)).otherwise(x["n"]), F.lit("cbm"), x["u"].isNull()))


def package_count(raw: Column) -> Column:
    unit = F.when(_word(raw, "ctn|ctns|carton|cartons"), "cartons").when(_word(raw, "pc|pcs|piece|pieces"), "pieces").when(_word(raw, "bale|bales"), "bales").when(_word(raw, "roll|rolls"), "rolls")
    return let(F.struct(number(raw).alias("n"), unit.alias("u")), lambda x: _value(F.when(x["n"] >= 0, F.floor(x["n"])).otherwise(F.ceil(x["n"])).cast("double"), x["u"], x["u"].isNull()))


def _alias(raw: Column, aliases: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.try_element_at(pairs, F.lower(F.trim(raw)))


def incoterm(raw: Column) -> Column:
    codes = F.coalesce(*(F.when(_word(raw, code.lower()), F.lit(code)) for code in INCOTERM_ORDER))
    return F.coalesce(_alias(raw, INCOTERM_ALIASES), codes, F.upper(F.trim(raw)))


def currency(raw: Column) -> Column:
    return F.coalesce(_alias(raw, CURRENCY_ALIASES), F.upper(F.trim(raw)))


def iso_date(raw: Column) -> Column:
    """yyyy-MM-dd from a fixed list of forms; with slashes the month comes first, unless its number exceeds 12."""
    s = F.regexp_replace(F.trim(raw), r"\s+", " ")
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "M-d-yyyy", "d-M-yyyy")
    return F.date_format(F.coalesce(*(F.try_to_date(s, f) for f in forms)), "yyyy-MM-dd")


def identifier(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, r"[\s\-/.]", ""))


def amount(raw: Column) -> Column:
    return _value(number(raw), F.lit(None).cast("string"), F.lit(False))


def semantic_key(entity_type: Column, raw: Column) -> Column:
    """TYPE:words in order of the alphabet."""
    words = F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(raw), r"[^a-z0-9]+", " ")), " "), "")
    return F.concat(entity_type, F.lit(":"), F.array_join(F.sort_array(words), " "))


def text_key(text: Column) -> Column:
    """What two texts must share to be equal: letters and digits, lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def is_null_like(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value)).isin(*NULL_WORDS)


def strip_fences(text: Column) -> Column:
    """Without a markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^```[a-zA-Z]*\n?", ""), r"\n?```$", ""))


def first_number(text: Column) -> Column:
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def country_code(text: Column) -> Column:
    return F.when(F.rlike(F.upper(F.trim(text)), F.lit("^[A-Z]{2}$")), F.upper(F.trim(text)))


def party_role(label: Column) -> Column:
    """Role that a label names; the first role in order whose label occurs in it."""
    plain = F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))
    hits = lambda p: (F.when(F.coalesce(*(F.when(F.contains(p, F.lit(x)), F.lit(True)) for x in labels)), F.lit(role)) for role, labels in PARTY_ROLE_LABELS)
    return let(plain, lambda p: F.coalesce(*hits(p)))


def event_hash(ts: Column, module: Column, action: Column, outcome: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", ts, module, action, outcome).cast("binary"), 256), 1, 16)


def ocr_text(text: Column) -> Column:
    """Letters and digits only, lower case: what two readings of a page are compared by."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def character_error_rate(found: Column, truth: Column) -> Column:
    a, b = ocr_text(found), ocr_text(truth)
    return F.when(F.length(b) == 0, F.when(F.length(a) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(b))


def by_type(entity_type: Column, raw: Column) -> Column:
    """(num, text, unit, warn) by the type of a field; unknown types keep their trimmed text. A failure is null with a warning."""
    kind = F.when(entity_type.isin("GROSS_WEIGHT", "NET_WEIGHT", "TARE_WEIGHT"), "weight").when(entity_type == "VOLUME", "volume").when(entity_type == "PACKAGE_COUNT", "count")
    kind = kind.when(entity_type.isin("TOTAL_AMOUNT", "FREIGHT_AMOUNT", "INSURANCE_AMOUNT", "UNIT_PRICE", "CIF_TOTAL"), "amount").when(entity_type.isin("INVOICE_DATE", "EXPIRY_DATE"), "date")
    kind = kind.when(entity_type == "INCOTERM", "incoterm").when(entity_type == "CURRENCY_CODE", "currency")
    kind = kind.when(entity_type.isin("AWB_NUMBER", "BL_NUMBER", "CONTAINER_NUMBER", "HS_CODE", "INVOICE_NUMBER", "DO_NUMBER", "LC_NUMBER"), "identifier").otherwise("text")
    text = F.when(kind == "date", iso_date(raw)).when(kind == "incoterm", incoterm(raw)).when(kind == "currency", currency(raw)).when(kind == "identifier", identifier(raw)).when(kind == "text", F.trim(raw))
    measured = F.when(kind == "weight", weight(raw)).when(kind == "volume", volume(raw)).when(kind == "count", package_count(raw)).when(kind == "amount", amount(raw))
    return let(
        F.struct(measured.alias("m"), text.alias("t")),
        lambda x: F.struct(x["m"]["value"].alias("num"), x["t"].alias("text"), x["m"]["unit"].alias("unit"), F.coalesce(x["m"]["warn"], x["t"].isNull()).alias("warn")),
    )
