"""Explanations of failures, counterfactual options, and the evidence graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.scores import band
from ..sources.store import kept
from . import rules
from .consensus import FIELD, LARGE, TOLERANCE, _carried, _large, canonical, judged, resolve
from .fold import beside, by_shipment, distinct_rows, folded, folder, gathered
from .linkage import rater, ratio

#: Advice by field; other fields get the last one. Our own wording.
ADVICE = {
    "GROSS_WEIGHT": "Weigh the goods again or ask the shipper which document is right.",
    "NET_WEIGHT": "Ask the shipper for the weight without packing and compare it with the packing list.",
    "PACKAGE_COUNT": "Count the packages and have the other document amended.",
    "TOTAL_AMOUNT": "Compare with the sum of the goods rows and have the wrong document reissued.",
    "CONSIGNEE_NAME": "Check the consignee's registered name.",
    "SHIPPER_NAME": "Check the shipper's registered name.",
    "HS_CODE": "Look the goods up in the tariff and use one code in all documents.",
    "INCOTERM": "Use the term of the sales contract in all documents.",
    "CURRENCY_CODE": "Use the currency of the invoice in all documents.",
    "VOLUME": "Work the volume out from the cartons' measures.",
    "WEIGHT_CONSISTENCY": "Correct the document whose net and tare weights don't add up to its gross weight.",
    None: "Ask the issuer of the document that differs to amend it.",
}
MOST_OPTIONS = 4
#: Ratios from which two texts are called a likely misspelling or similar.
MISSPELT, SIMILAR = 0.90, 0.70


def advice(entity_type: Column) -> Column:
    return F.coalesce(*(F.when(entity_type == k, v) for k, v in ADVICE.items() if k), F.lit(ADVICE[None]))


def explained(failed: DataFrame) -> DataFrame:
    """Failures with four layers: provenance, reasoning, confidence, recommendation."""
    extra = [c for c in ("page", "bbox") if f"a_{c}" in failed.columns]
    side = lambda x: F.struct(
        F.col(f"{x}_document_id").alias("document_id"), F.col(f"{x}_seq").alias("seq"), canonical(F.col(f"{x}_num"), F.col(f"{x}_txt")).alias("snippet"),
        F.concat_ws(":", F.lit("assertion"), f"{x}_document_id", "entity_type", f"{x}_seq").alias("assertion_id"), *(F.col(f"{x}_{c}").alias(c) for c in extra),
    )
    mean = F.round((F.col("a_confidence") + F.col("b_confidence")) / 2, 4)
    return failed.withColumns({
        "provenance": F.struct(side("a").alias("a"), side("b").alias("b")),
        "reasoning": F.struct(reasoning_steps().alias("steps"), F.col("rule").alias("rule"), F.lit("conflict").alias("conclusion")),
        "confidence": F.struct(mean.alias("mean"), F.round(F.col("a_confidence") * F.col("b_confidence"), 4).alias("product"), F.coalesce(F.col("similarity"), F.lit(0.0)).alias("semantic"), band(mean).alias("level")),
        "recommendation": F.struct(advice(F.col("entity_type")).alias("advice"), (F.col("a_num") - F.col("b_num")).alias("delta"), F.when(F.col("kind") == "numeric", F.format_string("%+.4f", F.col("a_num") - F.col("b_num"))).otherwise("reconcile the texts").alias("change")),
    })


def reasoning_steps() -> Column:
    """Four steps from what two documents state to the failure of a rule, for rows of ``rules.failures``."""
    a, b = canonical(F.col("a_num"), F.col("a_txt")), canonical(F.col("b_num"), F.col("b_txt"))
    return F.array(
        F.concat(F.lit("Document "), F.col("a_document_id"), F.lit(" states "), a),
        F.concat(F.lit("Document "), F.col("b_document_id"), F.lit(" states "), b),
        F.concat(F.lit("Rule "), F.col("rule"), F.lit(" compares them")),
        F.concat(F.lit("They differ: "), F.coalesce(F.col("delta_text"), F.format_string("similarity %.2f", F.col("similarity")))),
    )


def source_pairs(a: DataFrame) -> DataFrame:
    """Differing pairs of a field's sources, the first before the second, with their difference in percent of the second."""
    left, right = (a.select(*FIELD, F.col("seq").alias(f"{x}_seq"), F.col("num").alias(f"{x}_num"), F.col("document_type").alias(f"{x}_type")) for x in "ab")
    pairs = left.join(right, FIELD).filter("a_seq < b_seq AND a_num != b_num")
    percent = F.when(F.col("b_num") != 0, F.abs(F.col("a_num") - F.col("b_num")) / F.abs("b_num") * 100)
    return pairs.withColumn("percent", percent)


def _title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def _sources(a: DataFrame, most: int) -> DataFrame:
    """FIELD, conflict_type, sources (seq, doc, value, num) in order: those from which the field's first ``most`` options can come.

    Options name a source's document type and value only, its class. Let v be the first source's value. Every class with
    another value gives a new option beside the first source, and every class with v one beside any class with another
    value, before a class that comes later gives any; the first pair gives two. So ``most`` classes with v and ``most`` - 1
    with other values are enough. Of a class, a pair that is new takes its first place, or its next one after the first
    place of another class: so of the places between two first places of classes the first is enough. Both bounds
    depend on ``most`` alone, not on how many sources a field has.
    """
    v = _said(a)
    classes = v.groupBy(*FIELD, "doc", "value").agg(F.min("seq").alias("first"), F.min_by("num", "seq").alias("num"), F.bool_and(F.col("num").isNotNull()).alias("numeric"), F.bool_and(F.col("txt").isNotNull()).alias("text"))
    kinds = classes.groupBy(*FIELD, "value").agg(F.bool_and("numeric").alias("numeric"), F.bool_and("text").alias("text"), F.min("first").alias("first")).groupBy(*FIELD)
    kinds = kinds.agg(F.bool_and("numeric").alias("numeric"), F.bool_and("text").alias("text"), F.count("*").alias("n"), F.min_by("value", "first").alias("v"))
    kind = F.when((F.col("n") > 1) & F.col("numeric"), "numeric_variance").when((F.col("n") > 1) & F.col("text"), "text_mismatch").otherwise("other")
    near = classes.drop("numeric", "text").join(kinds.select(*FIELD, kind.alias("conflict_type"), "v"), FIELD).withColumn("same", F.col("value") == F.col("v"))
    rank = F.row_number().over(Window.partitionBy(*FIELD, "same").orderBy("first"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= most).filter(F.col("same") | (F.col("rank") < most))
    near = kept(near.withColumn("firsts", F.collect_list("first").over(Window.partitionBy(*FIELD))), "classes")  # at most 2 * most - 1 rows of a field
    placed = v.select(*FIELD, "doc", "value", "seq").join(near.select(*FIELD, "doc", "value", "num", "firsts"), [*FIELD, "doc", "value"])
    slot = F.size(F.filter("firsts", lambda f: f <= F.col("seq")))
    few = placed.groupBy(*FIELD, "doc", "value", slot.alias("slot")).agg(F.min("seq").alias("seq"), F.first("num").alias("num"))
    listed = few.groupBy(*FIELD).agg(F.array_sort(F.collect_list(F.struct("seq", "doc", "value", "num"))).alias("sources"))
    return listed.join(near.select(*FIELD, "conflict_type").distinct(), FIELD).select(*FIELD, "conflict_type", "sources")


def _collected(options: DataFrame, most: int) -> DataFrame:
    """FIELD, options: those of rows (FIELD, k, texts) in order, each once, at most ``most``."""
    rows = F.array_sort(F.collect_list(F.struct("k", "texts")))
    return options.groupBy(*FIELD).agg(rows.alias("x")).select(*FIELD, F.slice(F.array_distinct(F.flatten(F.transform("x", lambda r: r["texts"]))), 1, most).alias("options"))


#: Rows of ``_few``: beside the field, the pairs that its first options come from, or the sources to be verified.
_SOURCE = StructType([StructField("doc", StringType()), StructField("value", StringType()), StructField("num", DoubleType())])
_PAIRS = ArrayType(StructType([StructField("x", _SOURCE), StructField("y", _SOURCE), StructField("alike", DoubleType())]))


def _doc() -> Column:
    return _title(F.coalesce("document_type", F.lit("unknown")))


def _value() -> Column:
    return canonical(F.col("num"), F.col("txt"))


def _low() -> Column:
    return F.when(F.col("txt").isNotNull(), F.lower(_value()))


def _said(a: DataFrame) -> DataFrame:
    return a.select(*FIELD, "seq", "num", "txt", _doc().alias("doc"), _value().alias("value"))


def _few(a: DataFrame, most: int, kinds: tuple[str, ...] | None):
    """The assertions that a fold needs, the fold, and the schema of what it makes: FIELD, conflict_type, pairs, listed: of every field the pairs of classes, in order, until they give ``most`` options, and its first ``most`` classes.

    Shipment by shipment in Arrow batches, as ``fold`` does. A class is a document type with a value.
    """
    one = a.select(*FIELD, "seq", "num", _doc().alias("doc"), _value().alias("value"), _low().alias("low"))
    types = {f.name: f.dataType for f in a.schema.fields}
    schema = StructType([*(StructField(c, types[c]) for c in FIELD), StructField("conflict_type", StringType()), StructField("pairs", _PAIRS), StructField("listed", ArrayType(_SOURCE))])
    rate = rater()

    def fold(t):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        col = lambda c: t.column(c).combine_chunks()

        def codes(column, missing=-1):
            """A number for each text, in the order of the texts, and the texts."""
            d = column.dictionary_encode()
            words = d.dictionary.to_pylist()
            place = np.empty(len(words) + 1, np.int64)
            place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            place[-1] = missing
            return place[d.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)], sorted(words)

        ship, n = col("shipment_id"), t.num_rows
        new = np.zeros(n, np.int64)
        new[1:] = pc.fill_null(pc.not_equal(ship[1:], ship[:-1]), True).to_numpy(zero_copy_only=False)
        entity, names = codes(col("entity_type"))
        field = np.cumsum(new) * (len(names) + 1) + entity
        (doc, docs), (value, values), (low, lows) = (codes(col(c)) for c in ("doc", "value", "low"))
        known = col("seq").is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((value, doc, col("seq").fill_null(0).to_numpy(zero_copy_only=False), known, field))
        field = field[order]
        f0 = np.flatnonzero(np.append(True, field[1:] != field[:-1]))
        ends = np.append(f0[1:], n)
        doc, value, low = doc[order], value[order], low[order]
        differ = np.minimum.reduceat(value, f0) != np.maximum.reduceat(value, f0)
        all_num = np.logical_and.reduceat(col("num").is_valid().to_numpy(zero_copy_only=False)[order], f0)
        kind = np.where(differ & all_num, "numeric_variance", np.where(differ & np.logical_and.reduceat(low >= 0, f0), "text_mismatch", "other"))
        wanted = np.arange(len(f0)) if kinds is None else np.flatnonzero(np.isin(kind, kinds))
        d_, v_, l_ = doc.tolist(), value.tolist(), low.tolist()
        first, second, alike, n_pairs, listed, n_listed = [], [], [], [0], [], [0]
        for begin, end, k in zip(f0[wanted].tolist(), ends[wanted].tolist(), kind[wanted].tolist(), strict=True):
            at: dict = {}  # the first place of each class
            for i in range(begin, end):
                at.setdefault((d_[i], v_[i]), i)
            if k == "other":
                listed += list(at.values())[:most]
            else:
                seen, told = set(), set()
                for i in range(begin, end):
                    d, v = d_[i], v_[i]
                    for j in range(i + 1, end):
                        e, w = d_[j], v_[j]
                        if v == w or (d, v, e, w) in seen:
                            continue
                        seen.add((d, v, e, w))
                        told.update((f"{docs[d]} were {values[w]} instead of {values[v]}", f"{docs[e]} were {values[v]} instead of {values[w]}"))
                        first.append(at[d, v])
                        second.append(at[e, w])
                        alike.append(rate(lows[l_[i]], lows[l_[j]]) if k == "text_mismatch" else None)
                        if len(told) >= most:
                            break
                    if len(told) >= most:
                        break
            n_pairs.append(len(first))
            n_listed.append(len(listed))
        num = col("num")

        def sources(rows):
            rows = pa.array(order[np.array(rows, np.int64)])
            return pa.StructArray.from_arrays([col("doc").take(rows), col("value").take(rows), num.take(rows)], names=["doc", "value", "num"])

        out = to_arrow_schema(schema)
        pairs = pa.StructArray.from_arrays([sources(first), sources(second), pa.array(alike, pa.float64())], names=["x", "y", "alike"])
        lists = (pa.ListArray.from_arrays(pa.array(o, pa.int32()), x) for o, x in ((n_pairs, pairs), (n_listed, sources(listed))))
        at0 = pa.array(order[f0[wanted]])
        arrays = [ship.take(at0), col("entity_type").take(at0), pa.array(kind[wanted].tolist(), pa.string()), *lists]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, out, strict=True)], schema=out)

    return one, fold, schema


def _texts(p: Column, label: Column, numeric: Column) -> Column:
    """Options that a pair of sources (x, y, alike) gives: what either would have to be, and how far or how alike they are."""
    x, y, alike = p["x"], p["y"], p["alike"]
    percent = F.when(numeric & (y["num"] != 0), F.abs(x["num"] - y["num"]) / F.abs(y["num"]) * 100)
    were = lambda p, q: F.concat(F.lit("If the "), label, F.lit(" of "), p["doc"], F.lit(" were "), q["value"], F.lit(" instead of "), p["value"], F.lit(", the documents would agree."))
    far = F.when(percent >= 0.01, F.concat(x["doc"], F.lit(" and "), y["doc"], F.lit(" differ by "), F.format_string("%.2f%%", F.round(percent, 2))))
    hint = F.when(alike >= MISSPELT, "likely a misspelling").when(alike >= SIMILAR, "similar names: ask")
    near = F.when(hint.isNotNull(), F.concat(x["value"], F.lit(" and "), y["value"], F.format_string(" are %.0f%% alike: ", alike * 100), hint))
    return F.array_compact(F.array(were(x, y), were(y, x), F.coalesce(far, near)))


def _label() -> Column:
    return F.lower(F.replace("entity_type", F.lit("_"), F.lit(" ")))


def _said_of_pairs(most: int) -> Column:
    numeric = F.col("conflict_type") == "numeric_variance"
    return F.slice(F.array_distinct(F.flatten(F.transform("pairs", lambda p: _texts(p, _label(), numeric)))), 1, most)


def _advised(out: DataFrame, most: int, verify: str, options: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """FIELD, conflict_type, options, recommendation, and the columns ``keep``: ``options``, or where there is nothing to compare the sources in ``verify``."""
    each = F.slice(F.array_distinct(F.transform(verify, lambda q: F.concat(F.lit("Verify the "), _label(), F.lit(" of "), q["doc"], F.lit(": "), q["value"]))), 1, most)
    chosen = F.when(F.col("conflict_type") == "other", each).otherwise(options)
    sure = F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.concat(F.lit("Verify the "), _label(), F.lit(" in all documents."))))
    return out.select(*FIELD, "conflict_type", sure.alias("options"), advice(F.col("entity_type")).alias("recommendation"), *keep)


def counterfactuals(a: DataFrame, most: int = MOST_OPTIONS, kinds: tuple[str, ...] | None = None, large: int = LARGE) -> DataFrame:
    """FIELD, conflict_type, options, recommendation of every field of the assertions, or of those whose conflict_type is in ``kinds``.

    Numbers and texts: for each differing pair of sources, in order, what either would have to be, and how far or how
    alike they are. Other fields: each source to be verified. Every field has at least one option and at most ``most``.

    Fields are folded shipment by shipment, those with more than ``large`` assertions by aggregations.
    """
    many = _large(a, large)
    few = by_shipment(*_few(a if many is None else a.join(many, FIELD, "left_anti"), most, kinds))
    few = _advised(few, most, "listed", _said_of_pairs(most))
    if many is None:
        return few
    rest = _counterfactuals_large(a.join(many, FIELD, "left_semi"), most)
    return few.unionByName(rest if kinds is None else rest.filter(F.col("conflict_type").isin(*kinds)))


def _counterfactuals_large(a: DataFrame, most: int) -> DataFrame:
    """``counterfactuals`` of fields with very many assertions."""
    s = kept(_sources(a, most), "sources")
    paired = F.flatten(F.transform("sources", lambda x, i: F.transform(F.slice("sources", i + 2, F.size("sources")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    differing = F.filter(paired, lambda p: p["x"]["value"] != p["y"]["value"])
    pairs = s.filter("conflict_type != 'other'").select(*FIELD, "conflict_type", F.posexplode(differing).alias("k", "p"))
    once = F.min(F.struct("k", "p", "conflict_type"))  # later pairs of two classes in the same order say the same
    pairs = pairs.groupBy(*FIELD, "p.x.doc", "p.x.value", F.col("p.y.doc").alias("doc2"), F.col("p.y.value").alias("value2")).agg(once.alias("o")).select(*FIELD, "o.*")
    numeric = F.col("conflict_type") == "numeric_variance"
    alike = ratio(F.lower("p.x.value"), F.lower("p.y.value"), ~numeric)
    pairs = pairs.withColumn("alike", alike).withColumn("p", F.struct("p.x", "p.y", "alike"))
    made = _collected(pairs.select(*FIELD, "k", _texts(F.col("p"), _label(), numeric).alias("texts")), most)
    return _advised(s.join(made, FIELD, "left"), most, "sources", F.col("options"))


def inconsistencies(w: DataFrame) -> DataFrame:
    """``w`` (document_type, net, tare, gross: documents whose weights don't add up) with options and recommendation."""
    detail = F.format_string("net %.2f and tare %.2f make %.2f, not %.2f", F.col("net"), F.col("tare"), F.col("net") + F.col("tare"), F.col("gross"))
    options = F.array(F.concat(F.lit("Correct "), _title(F.col("document_type")), F.lit(" so that net and tare weight make the gross weight.")), F.concat(F.lit("Found: "), detail), F.lit("Weigh the shipment again and amend all documents."))
    return w.withColumns({"options": options, "recommendation": F.lit(ADVICE["WEIGHT_CONSISTENCY"])})


def with_counterfactuals(discrepancies: DataFrame, a: DataFrame) -> DataFrame:
    """Discrepancies of fields with their options and recommendation; fields without assertions get the general ones."""
    out = discrepancies.join(counterfactuals(a).drop("conflict_type"), FIELD, "left")
    general = F.array(F.concat(F.lit("Verify the "), F.lower(F.replace("entity_type", F.lit("_"), F.lit(" "))), F.lit(" in all documents.")))
    return out.withColumns({"options": F.coalesce("options", general), "recommendation": F.coalesce("recommendation", advice(F.col("entity_type")))})


def discrepancies_with_options(a: DataFrame, most: int = MOST_OPTIONS, large: int = LARGE) -> DataFrame:
    """FIELD, discrepancy_id, options, recommendation of every discrepancy of the assertions: ``with_counterfactuals`` in the pass that finds the outliers."""
    keep, carried = [*FIELD, "seq", "num", "txt", "is_num", "document_id", "confidence"], _carried(a, ("document_id", "confidence"))
    many = _large(a, large)
    few = a if many is None else a.join(many, FIELD, "left_anti")
    rows, of_rows, row_schema = folder(few.withColumns({"doc": _doc(), "value": _value(), "low": _low()}), canonical(F.col("num"), F.col("txt")), carried, TOLERANCE, [*keep, "doc", "value", "low"], outliers=True)
    _, of_fields, field_schema = _few(few, most, None)
    judged_rows = by_shipment(rows, *beside((of_rows, row_schema), (of_fields, field_schema))).withColumn("is_outlier", F.lit(True))  # outliers only
    also = ("conflict_type", "pairs", "listed")
    found = rules.discrepancies(rules.failures(rules.outlier_pairs(judged_rows, also)))
    out = _advised(found, most, "listed", _said_of_pairs(most), ("discrepancy_id",)).drop("conflict_type")
    if many is None:
        return out
    rest = a.join(many, FIELD, "left_semi")
    pairs = rules.outlier_pairs(judged(rest, ["is_num", "document_id", "confidence"], ("document_id", "confidence"), outliers=True, large=large))
    options = counterfactuals(rest, most, large=large).drop("conflict_type")
    return out.unionByName(rules.discrepancies(rules.failures(pairs)).select(*FIELD, "discrepancy_id").join(options, FIELD))


def text_options(pairs: DataFrame) -> DataFrame:
    """Text pairs (a_txt, b_txt) with their ratio and a hint how to settle them."""
    out = pairs.withColumn("ratio", ratio(F.lower("a_txt"), F.lower("b_txt")))
    hint = F.when(F.col("ratio") >= MISSPELT, "likely a misspelling").when(F.col("ratio") >= SIMILAR, "similar names: ask").otherwise("different values")
    return out.withColumn("hint", hint)


def _field_id():
    return F.concat_ws(":", F.lit("shipment"), "shipment_id", F.lit("field"), "entity_type")


def _assertion_id():
    return F.concat_ws(":", F.lit("assertion"), "document_id", "entity_type", "seq")


def nodes(a: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """id, kind of shipments, documents, fields and assertions, beside the columns to keep."""
    kinds = {"shipment": F.col("shipment_id").cast("string"), "document": F.col("document_id"), "field": _field_id(), "assertion": _assertion_id()}
    return a.select(*(keep or []), F.inline(F.array(*(F.struct(v.alias("id"), F.lit(k).alias("kind")) for k, v in kinds.items())))).distinct()


def edges(a: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """source, target, relation of the evidence graph, beside shipment_id if it is to keep; neighbours in a field's order must match.

    An edge names its shipment, so edges are told apart shipment by shipment, where the assertions lie.
    """
    a = distinct_rows(a)
    last = F.concat_ws(":", F.lit("assertion"), F.concat_ws("-", "shipment_id", F.col("seq") - 1), "entity_type", F.col("seq") - 1)
    rows = F.array(
        F.when(F.col("first_of_document"), F.struct(F.col("shipment_id").cast("string").alias("source"), F.col("document_id").alias("target"), F.lit("CONTAINS").alias("relation"))),
        F.when(F.col("first_of_field"), F.struct(F.col("shipment_id").cast("string").alias("source"), _field_id().alias("target"), F.lit("HAS_FIELD").alias("relation"))),
        F.struct(_assertion_id().alias("source"), _field_id().alias("target"), F.lit("ASSERTS_VALUE_FOR").alias("relation")),
        F.when(F.col("seq") > 1, F.struct(_assertion_id().alias("source"), last.alias("target"), F.lit("MUST_MATCH").alias("relation"))),
    )
    return a.select(*(keep or []), F.inline(F.array_compact(rows)))


def graphs(a: DataFrame) -> DataFrame:
    """shipment_id, nodes (id, kind), edges (source, target, relation): ``nodes`` and ``edges`` of each shipment, in order, made of its assertions in one pass."""
    g = gathered(a, ["document_id", "entity_type", "seq"])
    ship = F.col("shipment_id").cast("string")
    field = lambda e: F.concat_ws(":", F.lit("shipment"), "shipment_id", F.lit("field"), e)
    said = lambda r: F.concat_ws(":", F.lit("assertion"), r["document_id"], r["entity_type"], r["seq"])
    last = lambda r: F.concat_ws(":", F.lit("assertion"), F.concat_ws("-", "shipment_id", r["seq"] - 1), r["entity_type"], r["seq"] - 1)
    ids = {"document": F.array_distinct(F.transform("rows", lambda r: r["document_id"])), "field": F.array_distinct(F.transform("rows", lambda r: field(r["entity_type"]))), "assertion": F.array_distinct(F.transform("rows", said))}
    g = g.withColumn("ids", F.struct(*(v.alias(k) for k, v in ids.items())))
    node = lambda kind: F.transform(f"ids.{kind}", lambda i: F.struct(i.alias("id"), F.lit(kind).alias("kind")))
    edge = lambda source, target, relation: F.struct(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"))
    all_nodes = F.concat(F.array(F.struct(ship.alias("id"), F.lit("shipment").alias("kind"))), *map(node, ids))
    all_edges = F.concat(
        F.transform("ids.document", lambda i: edge(ship, i, "CONTAINS")), F.transform("ids.field", lambda i: edge(ship, i, "HAS_FIELD")),
        F.transform("rows", lambda r: edge(said(r), field(r["entity_type"]), "ASSERTS_VALUE_FOR")), F.transform(F.filter("rows", lambda r: r["seq"] > 1), lambda r: edge(said(r), last(r), "MUST_MATCH")),
    )
    return g.select("shipment_id", F.array_sort(all_nodes).alias("nodes"), F.array_sort(all_edges).alias("edges"))


def node_status(a: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``nodes`` with their status: their own (id, status) where there is one, else conflict for outliers, match for others.

    ``a``: flagged assertions.
    """
    out = a.filter("is_outlier").select(_assertion_id().alias("id"), F.lit("conflict").alias("__flag")).distinct()
    n = nodes(a).join(out, "id", "left")
    stated = F.lit(None).cast("string")
    if own is not None:
        n, stated = n.join(own.select("id", F.col("status").alias("__own")), "id", "left"), F.col("__own")
    return n.select("id", "kind", F.coalesce(stated, "__flag", F.lit("match")).alias("status"))


def graph_status(a: DataFrame, large: int = LARGE) -> DataFrame:
    """``node_status`` of the nodes of assertions, fields with their own status: one pass over each shipment. A document belongs to one shipment.

    Shipments that have a field with more than ``large`` assertions are joined.
    """
    many = _large(a, large)
    if many is not None:
        ships = many.select("shipment_id").distinct()
        rest, a = a.join(ships, "shipment_id", "left_semi"), a.join(ships, "shipment_id", "left_anti")
    rows = folded(a, canonical(F.col("num"), F.col("txt")), _carried(a, ()), TOLERANCE, [*FIELD, "seq", "document_id"], marks=True)
    match = F.lit("match")
    node = lambda first, i, kind, status: F.when(F.col(first), F.struct(i.alias("id"), F.lit(kind).alias("kind"), status.alias("status")))
    each = F.array(
        node("first_of_shipment", F.col("shipment_id").cast("string"), "shipment", match), node("first_of_document", F.col("document_id"), "document", match),
        node("first_of_field", _field_id(), "field", F.col("status")), node("first_of_assertion", _assertion_id(), "assertion", F.when(F.col("any_outlier"), "conflict").otherwise(match)),
    )
    out = rows.select(F.inline(F.array_compact(each)))
    if many is None:
        return out
    own = resolve(rest, large, carried=()).select(_field_id().alias("id"), "status")
    return out.unionByName(node_status(judged(rest, ["document_id"], carried=(), large=large), own))


def neighbours(edges: DataFrame, targets: DataFrame, relation: str | None = None) -> DataFrame:
    """target, source, relation: the nodes with an edge to each of ``targets`` (id)."""
    e = edges if relation is None else edges.filter(F.col("relation") == relation)
    return e.join(targets.select(F.col("id").alias("target")), "target", "left_semi").select("target", "source", "relation")


def asserted(a: DataFrame) -> DataFrame:
    """``neighbours`` of the fields of assertions by ASSERTS_VALUE_FOR: that edge always ends at a field of the same assertions, so no nodes are looked up."""
    return distinct_rows(a).select(_field_id().alias("target"), _assertion_id().alias("source"), F.lit("ASSERTS_VALUE_FOR").alias("relation"))
