"""Personal data: expressions propose spans, checksums confirm them, context words move their score.

Everything is a column expression over one row, so the job is a scan without a shuffle whatever the sizes of sources
or groups of copies. Expressions are written so that each character is visited a bounded number of times: runs are
possessive and can't start in their own middle, so neither long runs nor long texts cost more than their length.

Kinds: email, ip (parts to 255), card (Luhn), phone; and, as the method's own, iban (mod-97) always, and
``national_id`` and ``local_phone``, whose shape proves little, only if nearby words raise their score to
``threshold``. Scores of the first five start at or above the threshold, so context never removes them.

Defined results: null texts count as empty and have no spans; offsets are code points, ends exclusive; spans of
different kinds may overlap and are all returned; repeated rows are each returned; an empty table gives no rows.
Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, sealed
from .spans import joined, with_spans

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "national_id", "local_phone")

#: kind: (expression, score before context, words nearby that raise it)
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write|correo|courriel"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server|client"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.8, r"card|visa|master|credit|tarjeta|karte|carte"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.8, r"phone|tel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])", 0.9, r"iban|account|konto|bank|cuenta|compte"),
    "national_id": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", 0.3, r"\bssn\b|social security|national id|identity"),
    "local_phone": (r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", 0.3, r"phone|\btel\b|\bcall\b|mobile|\bfax\b"),
}
#: What context words add, and how many characters on either side they are sought in.
CONTEXT_GAIN, CONTEXT_CHARS = 0.4, 40


#: Characters of the pieces that a text is cut into, so that a span's context is found without reading from its start.
PIECE = 1024


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _ip_ok(v: Column) -> Column:
    """Each part at most 255; leading zeros don't matter."""
    return F.forall(F.split(v, r"\."), lambda p: F.rlike(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def _iban_ok(v: Column) -> Column:
    """The remainder modulo 97 of the rearranged number, taken character by character, is 1."""
    plain = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    code = lambda ch: F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(F.length(ch) == 0, acc).otherwise((acc * F.when(code(ch) > 9, 100).otherwise(10) + code(ch)) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


_CONFIRM = {
    "ip": _ip_ok,
    "card": lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": _iban_ok,
}
#: A character without which the kind can't occur: a cheap test before its expression runs.
_NEEDS = {"email": "@", "phone": "+"}


def _score(kind: str, x: Column) -> Column:
    """The kind's score, raised by context words near a span: looked for in the pieces of text that it touches and the next ones."""
    _, base, words = PATTERNS[kind]
    pieces = F.col("__pii_pieces")
    piece = lambda k: F.coalesce(F.get(pieces, k.cast("int")), F.lit(""))
    first, last = F.floor(x["start"] / PIECE), F.floor(x["end"] / PIECE)
    before = F.concat(F.when(first > 0, piece(first - 1)).otherwise(F.lit("")), F.substring(piece(first), F.lit(1), (x["start"] - first * PIECE).cast("int")))
    after = F.concat(F.substring(piece(last), (x["end"] - last * PIECE + 1).cast("int"), F.lit(CONTEXT_CHARS)), piece(last + 1))
    near = F.lower(F.concat_ws(" ", F.right(before, F.lit(CONTEXT_CHARS)), F.left(after, F.lit(CONTEXT_CHARS))))
    return F.when(F.rlike(near, F.lit(words)), F.least(F.lit(1.0), F.lit(base + CONTEXT_GAIN))).otherwise(F.lit(base))


def _confirmed(kind: str) -> Column:
    return F.filter(F.col(f"__pii_{kind}"), lambda x: _CONFIRM[kind](x["value"])) if kind in _CONFIRM else F.col(f"__pii_{kind}")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, and for each kind an array of (start, end, value, score) of the spans whose score reaches the threshold."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = (*BASE, *EXTRA)
    out = docs.select(F.col(id_col), text.alias("__pii_text"))
    text = F.col("__pii_text")
    out = with_spans(out, "__pii_text", {f"__pii_{k}": (PATTERNS[k][0], 0, F.contains(text, F.lit(_NEEDS[k])) if k in _NEEDS else F.rlike(text, F.lit("[0-9]"))) for k in kinds})

    found = F.size(F.concat(*(F.col(f"__pii_{k}") for k in kinds))) > 0
    out = sealed(out, {"__pii_pieces": F.when(found, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))})

    def scored(k: str) -> Column:
        with_score = F.transform(_confirmed(k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _score(k, x).alias("score")))
        return with_score if k in BASE else F.filter(with_score, lambda x: x["score"] >= threshold)

    return sealed(out, {k: scored(k) for k in kinds}).select(id_col, *kinds)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    kinds = [(k, F.col(k)) for k in (*BASE, *EXTRA)]
    return found.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{k}") for k, c in kinds[:4]),
        F.sha2(joined(kinds[:4]).cast("binary"), 256).alias("base_sha256"),
        joined(kinds).alias("spans"),
    )
