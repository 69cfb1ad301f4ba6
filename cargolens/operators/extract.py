"""Field extraction from page tokens: by label and neighbour, by pattern, and the whole document job (its steps are in ``readings``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import LABELS
from ..functions.shapes import PATTERNS, by_shape
from ..sources.store import kept, staged
from . import readings as R
from .linkage import letters, link_parts, may_reach, ratio
from .parties import resolve_party, roles
from .readings import GATE, LABEL_RATIO, REFUSED_RATIO, value_after


def label_texts(texts: DataFrame, labels: dict[str, list[str]] = LABELS) -> DataFrame:
    """t, entity_types, is_label for those of the distinct ``texts`` (t: trimmed, lower case) that name a field or are a label.

    A text names a field if, without its last colons, it holds one of the field's labels or is 0.85 like one. It is a
    label, and so no value, if it is more than 0.90 like one. The labels are a fixed table.
    """
    dim = texts.sparkSession.createDataFrame([(e, x) for e, xs in labels.items() for x in xs], "entity_type string, label string").withColumn("ll", letters(F.col("label")))
    x = texts.withColumn("cmp", F.regexp_replace("t", ":+$", "")).withColumns({"lc": letters(F.col("cmp")), "lt": letters(F.col("t"))})
    holds = F.contains("cmp", F.col("label"))
    like = may_reach(F.col("label"), F.col("cmp"), LABEL_RATIO, F.col("ll"), F.col("lc"))
    same = may_reach(F.col("label"), F.col("t"), REFUSED_RATIO, F.col("ll"), F.col("lt"))
    both = x.join(F.broadcast(dim), holds | like | same).withColumns({"holds": holds, "r": ratio(F.col("label"), F.col("cmp"), ~holds & like), "s": ratio(F.col("label"), F.col("t"), same)})
    per = both.groupBy("t").agg(F.collect_set(F.when(F.col("holds") | (F.col("r") >= LABEL_RATIO), F.col("entity_type"))).alias("entity_types"), F.bool_or(F.coalesce(F.col("s") > REFUSED_RATIO, F.lit(False))).alias("is_label"))
    return per.filter("is_label OR size(entity_types) > 0")


def by_label(tokens: DataFrame, labels: dict[str, list[str]] = LABELS) -> DataFrame:
    """document_id, entity_type, value, confidence, pos, page: after a label's colon, else the first suitable one of the next three tokens.

    ``tokens``: document_id, page, pos, text, confidence. The first label in order that has a value counts.
    """
    plain = lambda c: F.lower(F.trim(c))
    after = F.trim(F.regexp_extract("text", r":([\s\S]*)$", 1))
    base = tokens.select("document_id", "page", "pos", "text", "confidence", plain("text").alias("t"), F.when(F.length(after) > 1, after).alias("own"))
    known = kept(label_texts(base.select("t").union(base.filter("own IS NOT NULL").select(plain("own"))).filter("t != ''").distinct(), labels), "label-texts")
    refused = known.filter("is_label").select(F.col("t").alias("own_t"), F.lit(True).alias("own_is_label"))
    base = base.join(known, "t", "left").withColumn("own_t", plain("own")).join(refused, "own_t", "left")
    w = Window.partitionBy("document_id").orderBy("pos")
    candidate = F.struct("text", "confidence", F.coalesce("is_label", F.lit(False)).alias("label"), "pos", "page")
    hit = base.withColumns({f"n{k}": F.lead(candidate, k).over(w) for k in (1, 2, 3)}).filter("size(entity_types) > 0").withColumn("entity_type", F.explode("entity_types"))
    f = value_after(F.col("entity_type"), F.col("own"), F.col("own_is_label").isNotNull(), F.struct("confidence", "pos", "page"), [(F.col(f"n{k}"), F.col(f"n{k}.label")) for k in (1, 2, 3)])
    best = hit.withColumn("f", f).filter("f IS NOT NULL").groupBy("document_id", "entity_type").agg(F.min_by("f", "pos").alias("f"))
    return best.select("document_id", "entity_type", "f.*")


def by_pattern(docs: DataFrame, tokens: DataFrame | None = None, patterns: dict[str, list[str]] = PATTERNS, text: str = "text") -> DataFrame:
    """document_id, entity_type, value, confidence, pos, page of the first matching pattern of each field in running text.

    With tokens, the least confidence of those that hold the value or lie within it, and a little more; without any, 0.65.
    """
    each = F.array(*(F.struct(F.lit(e).alias("entity_type"), by_shape(F.col(text), ps).alias("value")) for e, ps in patterns.items()))
    found = docs.select("document_id", F.inline(each)).filter("value IS NOT NULL")
    if tokens is None:
        return found.select("document_id", "entity_type", "value", F.lit(0.65).alias("confidence"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("page"))
    v, t = F.lower("value"), F.lower("text")
    near = found.join(tokens.select("document_id", "text", F.col("confidence").alias("c"), "pos", "page"), "document_id").filter(F.contains(t, v) | F.contains(v, t))
    near = near.groupBy("document_id", "entity_type").agg(F.min("c").alias("c"), F.min(F.struct("pos", "page")).alias("at"))
    sure = F.coalesce(F.least(F.lit(0.90), F.col("c") + 0.05), F.lit(0.65))
    return found.join(near, ["document_id", "entity_type"], "left").select("document_id", "entity_type", "value", sure.alias("confidence"), F.col("at.pos").alias("pos"), F.col("at.page").alias("page"))


def combined(labelled: DataFrame, matched: DataFrame, gate: float = GATE) -> DataFrame:
    """A field's labelled value where there is one, else its pattern's; those under the gate are left out."""
    key, rest = ["document_id", "entity_type"], ["value", "confidence", "pos", "page"]
    a = labelled.select(*key, F.struct(*rest).alias("a"))
    b = matched.select(*key, F.struct(*rest).alias("b"))
    best = a.join(b, key, "full").select(*key, F.coalesce("a", "b").alias("x"), F.when(F.col("a").isNotNull(), "label").otherwise("pattern").alias("source"))
    return best.select(*key, "x.*", "source").filter(F.col("confidence") >= gate)


def placed(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """``found`` (document_id, value, page, ...) with box, ocr (confidence of the value's tokens) and page, 1 if it has none."""
    box = link_parts(found.select("document_id", "value"), tokens).select("document_id", "value", F.struct("x1", "y1", "x2", "y2").alias("box"), F.col("confidence").alias("ocr"))
    return found.join(box, ["document_id", "value"], "left").withColumn("page", F.coalesce("page", F.lit(1)))


def judged(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """``found`` (document_id, entity_type, value, page, box) with role, effective_type and eligible: consignees by their name and the labels near them."""
    found = kept(found, "placed")  # used for its names and for the result
    names = found.filter("entity_type = 'CONSIGNEE_NAME'").select("document_id", "page", F.col("entity_type").alias("value_id"), "value", "box.*")
    return resolve_party(found.join(roles(names, tokens).select("document_id", F.col("value_id").alias("entity_type"), "role"), ["document_id", "entity_type"], "left"))


def excluded(found: DataFrame) -> DataFrame:
    """document_id, warnings: one for each organisation of ``judged`` rows that has no role and so is left out."""
    text = F.concat(F.lit("Left out as consignee, no role is near it: "), F.col("value"))
    return found.filter("effective_type IS NULL").groupBy("document_id").agg(F.array_sort(F.collect_list(text)).alias("warnings"))


def document_job(tokens: DataFrame, docs: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """One row per entity: document_id, document_type, entity_type, value, num, text, unit, warn, page, box, role, eligible, source, score.

    Classified by the keywords of its first pages unless ``types`` are given, extracted, placed on the page, parties
    judged, normalised, scored, and of equal values the surest. Organisations without a role are left out.
    """
    token = F.struct("page", "pos", "text", "x1", "y1", "x2", "y2", "confidence")
    each = tokens.groupBy("document_id").agg(F.array_sort(F.collect_list(token)).alias("tokens")).join(docs.select("document_id", "text"), "document_id")
    return job_rows(each if types is None else each.join(types.select("document_id", "document_type"), "document_id"))


def job_rows(documents: DataFrame) -> DataFrame:
    """``document_job`` of documents that are one row each: document_id, tokens; their text and document_type if they are stated."""
    docs = R.in_order(documents)
    docs = docs if "document_type" in docs.columns else R.typed(docs).drop("confidence", "evidence")
    e = R.entities(R.judged_fields(docs)).select("document_id", "document_type", F.inline("entities"))
    return e.select("document_id", "document_type", "entity_type", "value", "num", "text", "unit", "warn", "page", "box", "role", "eligible", "source", "score")


#: Columns of an entity in a document's result.
ENTITY = ["entity_type", "value", "num", "text", "unit", "warn", "page", "box", "role", "eligible", "score"]
RESULT_ENTITY = "struct<entity_type:string,value:string,num:double,text:string,unit:string,warn:boolean,page:bigint,box:struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>,role:string,eligible:boolean,score:double>"
RESULT_TOKEN = "struct<page:bigint,pos:bigint,text:string,x1:bigint,y1:bigint,x2:bigint,y2:bigint,confidence:double>"


def faults(tokens: Column) -> Column:
    """Why an array of RESULT_TOKEN can't be processed, as codes; empty if it can."""
    bad = lambda code, broken: F.when(F.exists(tokens, broken), code)
    return F.array_compact(F.array(
        F.when(tokens.isNull() | (F.size(tokens) == 0), "NO_TOKENS"), bad("NO_TEXT", lambda t: t["text"].isNull()), bad("BAD_PAGE", lambda t: F.coalesce(t["page"] < 1, F.lit(True))),
        bad("BAD_BOX", lambda t: ~F.coalesce((t["x1"] <= t["x2"]) & (t["y1"] <= t["y2"]), F.lit(False))), bad("BAD_CONFIDENCE", lambda t: ~F.coalesce(t["confidence"].between(0, 1), F.lit(False))),
    ))


def error_results(documents: DataFrame, errors: Column) -> DataFrame:
    """The contract's row of documents (document_id) that couldn't be processed: unknown, nothing found, ``errors`` (an array)."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return documents.select(
        "document_id", F.lit("unknown").alias("document_type"), F.lit(0.0).alias("classification_confidence"), none("string").alias("classification_evidence"), none(RESULT_ENTITY).alias("entities"),
        none(RESULT_TOKEN).alias("raw_ocr"), errors.alias("errors"), none("string").alias("warnings"),
    )


def results(documents: DataFrame) -> DataFrame:
    """One row of the contract per document (document_id, tokens: array of RESULT_TOKEN), whatever befalls it.

    document_id, document_type, classification_confidence, classification_evidence, entities, raw_ocr, errors, warnings.
    Documents with ``faults`` get an error row each and don't enter the job; the others aren't touched by them.
    """
    told = staged(documents.select("document_id", F.col("tokens").cast(f"array<{RESULT_TOKEN}>").alias("raw_ocr")), __faults=faults(F.col("raw_ocr")))
    docs = R.typed(R.in_order(told.filter("size(__faults) = 0").select("document_id", "raw_ocr", F.col("raw_ocr").alias("tokens"))))
    docs = docs.withColumnsRenamed({"confidence": "classification_confidence", "evidence": "classification_evidence"})
    entity = lambda e: F.struct(*(e[c].alias(c) for c in ENTITY)).cast(RESULT_ENTITY)
    done = R.entities(R.judged_fields(docs)).select(
        "document_id", "document_type", "classification_confidence", "classification_evidence", F.array_sort(F.transform("entities", entity)).alias("entities"), "raw_ocr", F.array().cast("array<string>").alias("errors"), R.warnings(F.col("found")).alias("warnings")
    )
    return done.unionByName(error_results(told.filter("size(__faults) > 0"), F.col("__faults")))
