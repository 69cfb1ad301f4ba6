"""What a field's value looks like in running text, built from the words of units, the code lists and the published forms of transport numbers."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import CODE_FIELDS, CURRENCIES, INCOTERM_ORDER, NAME_FIELDS, NUMBER_FIELDS
from .normalize import let

WEIGHT_UNITS = ("kg", "kgs", "kilogram", "kilograms")
PACKAGE_UNITS = ("carton", "cartons", "ctn", "ctns", "pc", "pcs", "piece", "pieces", "package", "packages", "box", "boxes", "pallet", "pallets", "unit", "units", "roll", "rolls", "bale", "bales")
VOLUME_UNITS = ("cbm", "m3", "cubic meter", "cubic meters", "cubic metre", "cubic metres")
PAYMENT_METHODS = ("T/T", "L/C", "D/P", "D/A", "CAD", "open account")


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_DIGITS = r"\d(?:[\d.,]*\d)?"
_MONTH = _any([m for k in range(1, 13) for m in (calendar.month_name[k], calendar.month_abbr[k])])
_MONEY = _any(CURRENCIES)


def _measured(units) -> str:
    return rf"(?<![\w.,])({_DIGITS}\s*{_any(units)})\b"


#: One expression for each way to write a field; the first group is the value, and the first one that matches counts.
PATTERNS = {
    "INVOICE_NUMBER": [r"\b(inv(?:oice)?[-/][a-z0-9/-]*\d[a-z0-9/-]*)\b"],
    "INVOICE_DATE": [r"\b(\d{4}[-/.](?:0\d|1[0-2])[-/.][0-3]\d)\b", rf"\b([0-3]?\d[ -]{_MONTH}[ -]\d{{4}})\b", r"\b([0-3]?\d[-/.][0-3]?\d[-/.]\d{4})\b"],
    **dict.fromkeys(("GROSS_WEIGHT", "NET_WEIGHT", "TARE_WEIGHT"), [_measured(WEIGHT_UNITS)]),
    "PACKAGE_COUNT": [_measured(PACKAGE_UNITS)],
    "VOLUME": [_measured(VOLUME_UNITS)],
    "CURRENCY_CODE": [rf"\b({_MONEY})\b"],
    "TOTAL_AMOUNT": [rf"\b{_MONEY}\s*({_DIGITS})", rf"(?<![\w.,])({_DIGITS})\s*{_MONEY}\b"],
    "INCOTERM": [rf"\b({_any(INCOTERM_ORDER)}(?: [a-z]+)?)\b"],
    "AWB_NUMBER": [r"(?<![\d-])(\d{3}[- ]\d{4} ?\d{4})(?![\d-])"],  # airline prefix and serial number
    "FLIGHT_NUMBER": [r"\b((?:[a-z]{2}|[a-z]\d|\d[a-z]) ?\d{3,4})\b"],  # airline designator and number
    "CONTAINER_NUMBER": [r"\b([a-z]{3}[ujz] ?\d{6} ?\d)\b"],  # owner, category, serial and check digit
    "BL_NUMBER": [r"\b([a-z]{4}\d{8,12})\b", r"\bb/?l[- #:]+([a-z0-9-]*\d[a-z0-9-]{4,})\b"],  # carrier code and number
    "PAYMENT_TERMS": [r"\b(\d{1,3} days? (?:from|after) [a-z]+(?: [a-z]+)?)\b", rf"(?<!\w)({_any(PAYMENT_METHODS)})(?!\w)"],
    "ORIGIN": [r"\b(?:origin|departure|from)\s*:\s*([a-z][^\n:]{1,40})"],
    "DESTINATION": [r"\b(?:destination|to)\s*:\s*([a-z][^\n:]{1,40})"],
}


def by_shape(text: Column, patterns: list[str]) -> Column:
    """The first group of the first expression that matches, whatever the case; null if none does."""
    found = [F.regexp_extract(text, f"(?i){p}", 1) for p in patterns]
    return F.coalesce(*(let(x, lambda v: F.when(F.length(v) > 0, F.trim(v))) for x in found))


def plausible(entity_type: Column, text: Column) -> Column:
    """Whether a text's shape suits the field; a text that is a label is for the caller to refuse."""
    t = F.trim(text)
    number, code, words = F.rlike(t, F.lit(r"\d[\d,.]")), F.rlike(t, F.lit(r"\b[A-Z0-9]{3,}\b")), F.rlike(t, F.lit(r"\S\s+\S"))
    shape = (
        F.when(entity_type.isin(*NUMBER_FIELDS), number).when(entity_type == "CURRENCY_CODE", F.upper(t).isin(*CURRENCIES))
        .when(entity_type.isin(*CODE_FIELDS), code | F.rlike(t, F.lit(r"[-/]\d"))).when(entity_type.isin(*NAME_FIELDS), words).otherwise(number | words | code)
    )
    return F.coalesce((F.length(t) >= 2) & shape, F.lit(False))
