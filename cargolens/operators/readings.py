"""The document job on documents that are one row each, their tokens in an array.

Every step adds a column to the document's row: nothing is dealt out, sorted or joined, and no table of tokens is made.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import DOCUMENT_FIELDS, LABELS
from ..functions.normalize import by_type, let
from ..functions.scores import entity_confidence
from ..functions.shapes import PATTERNS, by_shape, plausible
from ..sources.store import staged
from . import documents as D
from .linkage import kinds_of, plain_texts, texts_of, token_parts
from .parties import named_role, nearest_role, resolved

GATE = 0.60
LABEL_RATIO, REFUSED_RATIO = 0.85, 0.90
#: Bits of ``label_kinds``.
LABEL, OWN = 61, 62
#: A text without the colons at its end, as Spark's ``:+$`` finds them.
_COLONS = re.compile(r":+(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)")


def label_kinds(texts: Column, own: Column, labels: dict[str, list[str]] = LABELS) -> Column:
    """What ``extract.label_texts`` tells of each text of an array (trimmed, lower case), as the bits of a number: for each field of ``labels`` whether the text names it; LABEL, whether it is a label; OWN, whether the text of ``own`` at its place is one.

    The labels are a fixed table. A worker keeps what it has found, by text without its digits: where labels have none,
    it doesn't matter which digits a text has.
    """
    fields = list(labels)
    if len(fields) > 60:
        raise ValueError("at most 60 fields")
    rows, least, refused, colons, kinds = [(1 << i, x, len(x)) for i, e in enumerate(fields) for x in labels[e]], LABEL_RATIO, REFUSED_RATIO, _COLONS, kinds_of()
    label_bit, own_bit = 1 << LABEL, 1 << OWN
    free = [d for d in "0123456789" if not any(d in x for _, x, _ in rows)]
    plain = str.maketrans(dict.fromkeys(free, free[0])) if free else {}

    def run(lists: pa.Array, owns: pa.Array) -> pa.Array:
        import sys
        from difflib import SequenceMatcher

        import pyarrow as pa

        marked = [(e, x, n, kinds(x)) for e, x, n in rows]
        of_length: dict = {}  # labels that a text of so many letters may be like

        def like(text: str) -> list[tuple[str, float]]:
            """Fields with labels that a text is LABEL_RATIO like, which is less than REFUSED_RATIO, and how much."""
            m, other = len(text), kinds(text)
            near = of_length.get(m)
            if near is None:
                near = of_length[m] = [(e, x, n, own, (least - 1e-9) * (n + m) / 2) for e, x, n, own in marked if 2 * min(n, m) >= (least - 1e-9) * (n + m)]
            out = []
            for e, x, n, own, need in near:
                if n - (own & ~other).bit_count() >= need and m - (other & ~own).bit_count() >= need:
                    r = SequenceMatcher(None, x, text).ratio()
                    if r >= least:
                        out.append((e, r))
            return out

        def told(t: str) -> int:
            cmp = colons.sub("", t)
            same, m = like(cmp), 0
            for bit, x, _ in rows:
                if x in cmp:
                    m |= bit
            for bit, _ in same:
                m |= bit
            return m | label_bit if any(r > refused for _, r in (same if t == cmp else like(t))) else m

        known: dict = sys.modules.setdefault("_cargolens_labels", {}).setdefault(tuple(rows), {})  # lives as long as the worker

        def of(flat: pa.Array) -> list[int]:
            out = []
            for t in flat.to_numpy(zero_copy_only=False).tolist():
                if not t:
                    out.append(0)
                    continue
                t = t.translate(plain)
                m = known.get(t)
                if m is None:
                    if len(known) > 1_000_000:
                        known.clear()
                    m = known[t] = told(t)
                out.append(m)
            return out

        all_own = of(owns.flatten())
        bits = [m | own_bit if o & label_bit else m for m, o in zip(of(lists.flatten()), all_own, strict=True)]
        ends = [0]
        for n in lists.value_lengths().fill_null(0).to_pylist():
            ends.append(ends[-1] + n)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bits, pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(texts, own)


def value_after(e: Column, own: Column, own_is_label: Column, x: Column, following: list[tuple[Column, Column]]) -> Column:
    """value, confidence, pos and page of what a label ``x`` of a field (struct of text, confidence, pos, page) stands for: ``own``, the text after its colon, else the first suitable one of the tokens that follow, each with whether it is a label."""
    found = lambda value, most, t: F.struct(value.alias("value"), F.least(F.lit(most), t["confidence"]).alias("confidence"), t["pos"].alias("pos"), t["page"].alias("page"))
    ways = [F.when(own.isNotNull() & ~own_is_label & plausible(e, own), found(own, 0.88, x))]
    ways += [F.when(t.isNotNull() & ~label & plausible(e, t["text"]), found(F.trim(t["text"]), 0.85, t)) for t, label in following]
    return F.coalesce(*ways)


def _by_label(tokens: str, own: str, kinds: str, fields: list[str]) -> Column:
    """Array of what each label among a document's tokens stands for: entity_type, rank, first (the label's place), and the value."""
    has = lambda i, bit: F.coalesce(F.getbit(F.get(kinds, i), F.lit(bit)) == 1, F.lit(False))
    known = F.array(*(F.struct(F.lit(e).alias("e"), F.lit(1 << n).alias("bit")) for n, e in enumerate(fields)))

    def of(i: Column) -> Column:
        x = F.get(tokens, i)
        value = lambda e: value_after(e, F.get(own, i), has(i, OWN), x, [(F.get(tokens, i + k), has(i + k, LABEL)) for k in (1, 2, 3)])
        named = F.filter(known, lambda e: F.get(kinds, i).bitwiseAND(e["bit"]) != 0)
        each = F.transform(named, lambda e: F.struct(e["e"].alias("entity_type"), F.lit(0).alias("rank"), x["pos"].alias("first"), value(e["e"]).alias("f")))
        return F.filter(each, lambda r: r["f"].isNotNull())

    named = F.filter(F.transform(kinds, lambda k, i: F.when(k.bitwiseAND(F.lit((1 << len(fields)) - 1)) != 0, i)), lambda i: i.isNotNull())
    return F.flatten(F.transform(named, of))


def _by_pattern(tokens: str, found: str) -> Column:
    """Array of what patterns found (structs of entity_type and value), as of ``_by_label``: of those tokens that hold the value or lie within it the least confidence, and a little more."""

    def of(x: Column) -> Column:
        near = F.filter(tokens, lambda t: F.contains(F.lower(t["text"]), F.lower(x["value"])) | F.contains(F.lower(x["value"]), F.lower(t["text"])))

        def made(near: Column) -> Column:
            at = F.array_min(F.transform(near, lambda t: F.struct(t["pos"].alias("pos"), t["page"].alias("page"))))
            sure = F.coalesce(F.least(F.lit(0.90), F.array_min(F.transform(near, lambda t: t["confidence"])) + 0.05), F.lit(0.65))
            return F.struct(x["value"].alias("value"), sure.alias("confidence"), at["pos"].alias("pos"), at["page"].alias("page"))

        return F.struct(x["entity_type"].alias("entity_type"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("first"), let(near, made).alias("f"))

    return F.transform(found, of)


def _first_of(rows: str, same) -> Column:
    """Of the structs of an array in order the first of those that follow each other with the same values of ``same``."""
    return F.filter(rows, lambda x, i: (i == 0) | ~F.coalesce(same(x).eqNullSafe(same(F.get(rows, i - 1))), F.lit(False)))


def found_fields(docs: DataFrame, labels: dict[str, list[str]] = LABELS, patterns: dict[str, list[str]] = PATTERNS, gate: float = GATE) -> DataFrame:
    """``docs`` (document_id, tokens in order, text) with ``found``: array of entity_type, value, confidence, pos, page, source.

    A field's labelled value where there is one, else its pattern's; those under the gate are left out.
    """
    rest = docs.columns
    after = lambda t: F.trim(F.regexp_extract(t["text"], r":([\s\S]*)$", 1))
    docs = staged(docs, __texts=F.transform("tokens", lambda t: F.lower(F.trim(t["text"]))), __own=F.transform("tokens", lambda t: F.when(F.contains(t["text"], F.lit(":")), let(after(t), lambda a: F.when(F.length(a) > 1, a)))))
    docs = docs.withColumn("__kinds", label_kinds(F.col("__texts"), F.transform("__own", lambda t: F.lower(F.trim(t))), labels))
    ways = {tuple(p): f"way{i}" for i, p in enumerate(dict.fromkeys(map(tuple, patterns.values())))}  # fields may share their patterns
    docs = staged(docs, __shapes=F.struct(*(by_shape(F.col("text"), list(p)).alias(c) for p, c in ways.items())))
    each = F.array(*(F.struct(F.lit(e).alias("entity_type"), F.col("__shapes")[ways[tuple(p)]].alias("value")) for e, p in patterns.items()))
    docs = staged(docs, __matched=F.filter(each, lambda x: x["value"].isNotNull()), __labelled=_by_label("tokens", "__own", "__kinds", list(labels)))
    docs = staged(docs, __all=F.sort_array(F.concat("__labelled", _by_pattern("tokens", "__matched"))))
    best = F.filter(_first_of("__all", lambda x: x["entity_type"]), lambda x: x["f"]["confidence"] >= gate)
    out = F.transform(best, lambda x: F.struct(x["entity_type"].alias("entity_type"), *(x["f"][c].alias(c) for c in ("value", "confidence", "pos", "page")), F.when(x["rank"] == 0, "label").otherwise("pattern").alias("source")))
    return staged(docs, found=out).select(*rest, "found")


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` (document_id, tokens, ...) with the tokens in order of ``pos``, and ``text``, if it isn't there: their texts in order of page and place."""
    fields = ["pos", "page", "text", "x1", "y1", "x2", "y2", "confidence"]
    rest = [c for c in docs.columns if c != "tokens"]
    docs = staged(docs.select(*rest, F.col("tokens").alias("__tokens")), tokens=F.sort_array(F.transform("__tokens", lambda t: F.struct(*(t[c].alias(c) for c in fields))))).drop("__tokens")
    if "text" in rest:
        return docs
    by_page = F.sort_array(F.transform("tokens", lambda t: F.struct(t["page"].alias("page"), t["pos"].alias("pos"), t["text"].alias("text"))))
    return staged(docs, text=F.array_join(F.transform(by_page, lambda t: t["text"]), " "))


def typed(docs: DataFrame, pages: int = D.FIRST_PAGES) -> DataFrame:
    """``docs`` with document_type, confidence and evidence by the keywords on each document's first pages."""
    first = F.sort_array(F.transform(F.filter("tokens", lambda t: t["page"] <= pages), lambda t: F.struct(t["page"].alias("page"), t["pos"].alias("pos"), t["text"].alias("text"))))
    docs = staged(docs, __first=F.concat(F.array_join(F.transform(first, lambda t: t["text"]), " "), F.lit(" ")))
    return D.classified(docs, F.col("__first")).drop("__first")


def judged_fields(docs: DataFrame, fields: dict[str, list[str]] = DOCUMENT_FIELDS) -> DataFrame:
    """``docs`` (document_id, tokens in order, text, document_type) with ``found``: the fields that a document of its type should state, placed and judged.

    Array of entity_type, value, confidence, pos, page, source, box, ocr (confidence of the value's tokens), role, effective_type, eligible.
    """
    rest = docs.columns
    stated = F.create_map(*(x for d, es in fields.items() for x in (F.lit(d), F.array(*map(F.lit, es)))))
    docs = staged(found_fields(docs), __stated=F.coalesce(F.try_element_at(stated, F.col("document_type")), F.array().cast("array<string>")))
    docs = staged(docs.withColumnRenamed("found", "__found"), __wanted=F.filter("__found", lambda x: F.array_contains(F.col("__stated"), x["entity_type"])))
    docs = staged(docs, __values=F.transform("__wanted", lambda x: F.lower(F.trim(x["value"]))), __texts=plain_texts(F.col("tokens")))
    docs = docs.withColumn("__at", token_parts(F.col("__values"), F.col("__texts")))

    def placed(x: Column, i: Column) -> Column:
        def of(at: Column) -> Column:
            least, most = (lambda c: F.array_min(F.transform(at, lambda t: t[c]))), (lambda c: F.array_max(F.transform(at, lambda t: t[c])))
            box = F.struct(least("x1").alias("x1"), least("y1").alias("y1"), most("x2").alias("x2"), most("y2").alias("y2"))
            return F.struct(*(x[c].alias(c) for c in ("entity_type", "value", "confidence", "pos", "source")), F.coalesce(x["page"], F.lit(1)).alias("page"), F.when(F.size(at) > 0, box).alias("box"), least("confidence").alias("ocr"))

        return let(F.transform(F.get("__at", i), lambda k: F.get("tokens", k)), of)

    def judged(x: Column) -> Column:
        near = F.coalesce(named_role(x["value"]), nearest_role(x["value"], x["page"], x["box"], F.col("tokens")))
        role = F.when(x["entity_type"] == "CONSIGNEE_NAME", near)

        def of(role: Column) -> Column:
            effective, eligible = resolved(x["entity_type"], role)
            return F.struct(*(x[c].alias(c) for c in ("entity_type", "value", "confidence", "pos", "page", "source", "box", "ocr")), role.alias("role"), effective.alias("effective_type"), eligible.alias("eligible"))

        return let(role, of)

    docs = staged(docs, __placed=F.transform("__wanted", placed))
    return staged(docs, found=F.transform("__placed", judged)).select(*rest, "found")


def entities(docs: DataFrame) -> DataFrame:
    """``docs`` with ``entities`` of its ``found`` (of ``judged_fields``), normalised and scored, of equal values the surest, ties to the first; those without a role are left out."""
    rest = docs.columns

    def made(x: Column) -> Column:
        def of(n: Column) -> Column:
            score = entity_confidence(F.coalesce(x["ocr"], x["confidence"]), F.when(x["box"].isNotNull(), 1.0).otherwise(0.0), n["warn"])
            return F.struct(
                x["effective_type"].alias("entity_type"), F.coalesce(n["num"].cast("string"), n["text"], x["value"]).alias("key"), (-score).alias("back"), x["pos"].isNull().alias("nowhere"), x["pos"].alias("pos"),
                x["value"].alias("value"), n["num"].alias("num"), n["text"].alias("text"), n["unit"].alias("unit"), n["warn"].alias("warn"), *(x[c].alias(c) for c in ("page", "box", "role", "eligible", "source")), score.alias("score"),
            )

        return let(by_type(x["effective_type"], x["value"]), of)

    docs = staged(docs, __made=F.sort_array(F.transform(F.filter("found", lambda x: x["effective_type"].isNotNull()), made)))
    return staged(docs, entities=_first_of("__made", lambda x: F.struct(x["entity_type"], x["key"]))).select(*rest, "entities")


def warnings(found: Column) -> Column:
    """One text for each organisation of ``judged_fields`` that has no role and so is left out."""
    out = F.filter(found, lambda x: x["effective_type"].isNull())
    return F.sort_array(F.transform(out, lambda x: F.concat(F.lit("Left out as consignee, no role is near it: "), x["value"])))
