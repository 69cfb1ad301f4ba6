"""Queries of the scalar functions: raw texts are built from known numbers, and the SQL states the numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import scores as S
from ..sources.bindings import LINE_KEY, assertions, lines, sql, table

_K = ", ".join(LINE_KEY)


def _pick(k: Column, *options) -> Column:
    """The option that ``k`` modulo their number names."""
    out = F.when(k % len(options) == 0, options[0])
    for i, o in enumerate(options[1:], 1):
        out = out.when(k % len(options) == i, o)
    return out


def _grouped(cents: Column, thousands: str, point: str) -> Column:
    whole, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    high = F.floor(whole / 1000)
    text = F.when(high > 0, F.concat(high.cast("string"), F.lit(thousands), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    return F.concat(text, F.lit(point), rest)


def _line_query(**columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = lines(spark, sf_dir)
        return base.select(*LINE_KEY, *(make(base).alias(k) for k, make in columns.items()))

    return run


def _parsed_query(make, *fields: str):
    """The fields of one parsed struct per line."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = lines(spark, sf_dir)
        return base.select(*LINE_KEY, make(base).alias("x")).select(*LINE_KEY, *(f"x.{f}" for f in fields))

    return run


def _raw_number(_) -> Column:
    c = F.col("cents")
    return _pick(F.col("l_linenumber"), F.concat(F.lit("USD "), _grouped(c, ",", ".")), F.concat(_grouped(c, ".", ",")), F.concat(F.lit("lkr"), _grouped(c, ",", "."), F.lit(" only")), F.concat(F.floor(c / 100).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0")))


def _raw_weight(_) -> Column:
    q = F.col("q").cast("string")
    return _pick(F.col("l_linenumber"), F.concat(q, F.lit(" KGS")), F.concat(q, F.lit(" lbs")), F.concat(q, F.lit(" MT")), F.concat(q, F.lit(" g")), q)


def _raw_count(_) -> Column:
    q = F.col("q").cast("string")
    return _pick(F.col("l_linenumber"), F.concat(q, F.lit(" CTNS")), F.concat(q, F.lit(".7 Pieces")), F.concat(q, F.lit(" bales")), F.concat(q, F.lit(" rolls of cloth")), q)


def _raw_volume(_) -> Column:
    q = F.col("q").cast("string")
    return _pick(F.col("l_linenumber"), F.concat(q, F.lit(".5 CBM")), F.concat(q, F.lit(" liters")), F.concat(q, F.lit(" m³")), q)


def _raw_date(_) -> Column:
    d = F.col("l_shipdate")
    return _pick(F.col("l_linenumber"), *(F.date_format(d, f) for f in ("yyyy-MM-dd", "yyyy.MM.dd", "d-MMM-yyyy", "MM/dd/yyyy", "MMMM d, yyyy")), F.lit("31-FOO-2026"))


def fn12_normalize_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lines(spark, sf_dir)
    kind = _pick(F.col("l_linenumber"), F.lit("GROSS_WEIGHT"), F.lit("VOLUME"), F.lit("PACKAGE_COUNT"), F.lit("TOTAL_AMOUNT"), F.lit("HS_CODE"), F.lit("SHIPPING_MARKS"))
    q = F.col("q").cast("string")
    raw = _pick(F.col("l_linenumber"), F.concat(q, F.lit(" kg")), F.concat(q, F.lit(" cbm")), F.concat(q, F.lit(" cartons")), F.lit("unknown"), F.concat(F.lit("85.16 "), q), F.concat(F.lit("  marks "), q, F.lit(" ")))
    v = N.by_type(F.col("kind"), F.col("raw"))
    return base.select(*LINE_KEY, kind.alias("kind"), raw.alias("raw")).withColumn("v", v).select(*LINE_KEY, "kind", "raw", "v.num", "v.text", "v.unit", "v.warn")


def fn10_semantic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.semantic_key(F.lit("GOODS"), F.concat_ws(" - ", "p_type", "p_name", "p_brand")).alias("cache_key"))


def fn13_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.text_key(F.col("text")).alias("text_key"))


def fn17_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b = F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", F.lower("p_type"), F.lit("small box."))
    return p.select("p_partkey", F.round(S.jaccard(a, b), 6).alias("similarity"))


def set4_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x, y = S.plain_words(F.concat_ws(" ", "p_name", "p_type")), S.plain_words(F.concat_ws(" ", "p_type", F.lit("red box")))
    return p.select("p_partkey", F.size(F.array_intersect(x, y)).alias("n_both"), F.size(F.array_union(x, y)).alias("n_either"))


def _beside_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector beside the mean vector of its label."""
    v = table(spark, sf_dir, "embeddings")
    at = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = at.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))
    return v.join(mean, "label")


def fn18_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beside_means(spark, sf_dir).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("center")), 5).alias("cosine"))


def fn19_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of ports: some equal but for case and dots, some with vectors, some with words only."""
    k = F.col("vec_id") % 3
    name = F.concat(F.lit("Port "), F.col("label"))
    other = F.when(k == 0, F.concat(F.lower(name), F.lit("."))).otherwise(F.concat(F.lit("Port of "), F.col("label")))
    like = S.similarity(name, other, F.when(k < 2, F.col("embedding")), F.col("center"))
    return _beside_means(spark, sf_dir).select("vec_id", F.round(like, 5).alias("similarity"))


def fn14_entity_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ocr, match = F.when(F.col("l_linenumber") % 3 > 0, F.col("confidence")), F.when(F.col("l_linenumber") % 2 > 0, F.round(1 - F.col("l_tax"), 2))
    base = lines(spark, sf_dir)
    score = S.entity_confidence(ocr, match, F.col("l_returnflag") == "R")
    # Weights times hundredths are whole ten-thousandths: rounding is by whole numbers, alike in any engine.
    return base.select(*LINE_KEY, score.alias("score"))


def fn15_model_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(*LINE_KEY, F.round(S.model_confidence(F.col("l_linenumber") % 3 > 0, F.col("confidence")), 4).alias("confidence"))


def fn30_spread_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["a", "b", "c", "d"]))
    m = S.spread_scores(kinds, F.get(kinds, (F.col("l_linenumber") % 4).cast("int")), F.col("confidence"))
    return lines(spark, sf_dir).select(*LINE_KEY, m.alias("m")).select(*LINE_KEY, F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.c").alias("c"), F.col("m.d").alias("d"))


def fn28_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assertions(spark, sf_dir)
    return a.select(F.concat_ws(":", F.lit("shipment"), "shipment_id", F.lit("field"), "entity_type").alias("canonical_field_id"), F.concat_ws(":", F.lit("assertion"), "document_id", "entity_type", "seq").alias("assertion_id"))


def fn25_event_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", N.event_hash(ts, F.col("event_type"), F.lit("record"), F.col("props")).alias("event_hash"))


def fn23_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    read = F.translate(F.concat_ws(" ", "p_name", "p_brand"), "aeo", "sz0")
    return p.select("p_partkey", F.round(N.character_error_rate(read, F.concat_ws("-", "p_name", "p_brand")), 6).alias("error_rate"))


def fn29_strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"id": '), F.col("c_custkey").cast("string"), F.lit("}"))
    raw = _pick(F.col("c_custkey"), body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit(" ```\n"), body, F.lit("```\n")))
    return table(spark, sf_dir, "customer").select("c_custkey", N.strip_fences(raw).alias("body"))


def fn26_party_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = _pick(F.col("c_custkey"), *(F.concat(F.lit(x), F.lit(" / "), F.col("c_name")) for x in ("Exporter / Shipper", "Notify", "CONSIGNEE:", "Issuing  Bank", "Cargo-Agent", "handling agent", "Buyer", "Vessel")))
    return table(spark, sf_dir, "customer").select("c_custkey", N.party_role(label).alias("role"))


def fn21_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _pick(F.col("n_nationkey"), F.col("n_name"), F.lower(F.substring("n_name", 1, 2)), F.concat(F.lit(" "), F.substring("n_name", 1, 2)))
    return table(spark, sf_dir, "nation").select("n_nationkey", N.country_code(raw).alias("code"))


def fn22_declaration_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..dims import INCOTERM_ORDER

    currency = _pick(F.col("l_linenumber"), F.lit("USD"), F.lit("usd"), F.lit("US"), F.lit("EURO"))
    term = _pick(F.col("seq"), F.lit("fob"), F.lit("CIF"), F.lit("ABC"))
    number = _pick(F.col("q"), F.col("q").cast("string"), F.lit("-1"), F.lit("n/a"))
    return lines(spark, sf_dir).select(
        *LINE_KEY,
        "seq",
        F.rlike(F.upper(currency), F.lit("^[A-Z]{3}$")).alias("currency_ok"),
        F.upper(term).isin(*INCOTERM_ORDER).alias("incoterm_ok"),
        F.coalesce(number.try_cast("double") > 0, F.lit(False)).alias("number_ok"),
    )


QUERIES = {
    "fn01_number": _line_query(value=lambda d: N.number(_raw_number(d))),
    "fn02_weight": _parsed_query(lambda d: N.weight(_raw_weight(d)), "value", "unit", "warn"),
    "fn03_volume": _parsed_query(lambda d: N.volume(_raw_volume(d)), "value", "warn"),
    "fn04_package_count": _parsed_query(lambda d: N.package_count(_raw_count(d)), "value", "unit", "warn"),
    "fn05_incoterm": _line_query(code=lambda d: N.incoterm(_pick(F.col("l_linenumber"), F.lit(" Free On Board "), F.lit("CIF London"), F.lit("delivered duty paid"), F.lit("terms: fca, exw"), F.concat(F.lit("x"), F.col("q").cast("string"))))),
    "fn06_currency": _line_query(code=lambda d: N.currency(_pick(F.col("l_linenumber"), F.lit("usd"), F.lit("US Dollars"), F.lit(" yen"), F.lit("Chf"), F.lit("Sri Lankan Rupee"), F.lit("franc")))),
    "fn07_date": _line_query(day=lambda d: N.iso_date(_raw_date(d))),
    "fn08_identifier": _line_query(code=lambda d: N.identifier(_pick(F.col("l_linenumber"), F.concat(F.lit("maeu 12-"), F.col("q").cast("string")), F.concat(F.lit("a/b."), F.col("q").cast("string"))))),
    "fn09_amount": _line_query(value=lambda d: N.amount(_raw_number(d))["value"], warn=lambda d: N.amount(F.when(F.col("l_linenumber") % 2 == 0, _raw_number(d)))["warn"]),
    "fn10_semantic_key": fn10_semantic_key,
    "fn11_trimmed_text": _line_query(value=lambda d: F.trim(F.concat(F.lit("  "), F.col("l_returnflag"), F.lit(" x ")))),
    "fn12_normalize_dispatch": fn12_normalize_dispatch,
    "fn13_text_key": fn13_text_key,
    "fn14_entity_confidence": fn14_entity_confidence,
    "fn15_model_confidence": fn15_model_confidence,
    "fn17_jaccard": fn17_jaccard,
    "fn18_cosine": fn18_cosine,
    "fn19_similarity": fn19_similarity,
    "fn20_first_number": _line_query(value=lambda d: N.first_number(F.concat(F.lit("about -"), _grouped(F.col("cents"), ",", "."), F.lit(" or 7")))),
    "fn21_country": fn21_country,
    "fn22_declaration_formats": fn22_declaration_formats,
    "fn23_error_rate": fn23_error_rate,
    "fn24_net_mass": _line_query(net=lambda d: F.greatest(F.lit(0.0), F.col("l_quantity") * 10 - F.col("l_linenumber") * 22.5)),
    "fn25_event_hash": fn25_event_hash,
    "fn26_party_role": fn26_party_role,
    "fn28_ids": fn28_ids,
    "fn29_strip_fences": fn29_strip_fences,
    "fn30_spread_scores": fn30_spread_scores,
    "flt10_confidence_band": _line_query(band=lambda d: S.band(F.col("confidence"))),
    "flt13_null_like": _line_query(null_like=lambda d: N.is_null_like(_pick(F.col("l_linenumber"), F.lit(" N/A "), F.lit(None).cast("string"), F.lit("0.00"), F.col("l_returnflag")))),
    "flt17_numeric_close": _line_query(close=lambda d: S.close(F.col("l_quantity"), F.col("l_quantity") * (1 + F.col("l_tax") / 10))),
    "set4_token_sets": set4_token_sets,
}

def _lines(columns: str) -> str:
    return sql("lines", f"SELECT {_K}, {columns} FROM lines")


ORACLES = {
    "fn01_number": _lines("cents / 100 AS value"),
    "fn02_weight": _lines("CASE l_linenumber % 5 WHEN 0 THEN q WHEN 1 THEN round(q * 0.453592, 3) WHEN 2 THEN q * 1000 WHEN 3 THEN round(q / 1000, 6) ELSE q END AS value, 'kg' AS unit, l_linenumber % 5 = 4 AS warn"),
    "fn03_volume": _lines("CASE l_linenumber % 4 WHEN 0 THEN q + 0.5 WHEN 1 THEN round(q * 0.001, 6) ELSE q END AS value, l_linenumber % 4 = 3 AS warn"),
    "fn04_package_count": _lines("q::DOUBLE AS value, ['cartons', 'pieces', 'bales', 'rolls', NULL][l_linenumber % 5 + 1] AS unit, l_linenumber % 5 = 4 AS warn"),
    "fn05_incoterm": _lines("['FOB', 'CIF', 'DDP', 'EXW', 'X' || q][l_linenumber % 5 + 1] AS code"),
    "fn06_currency": _lines("['USD', 'USD', 'JPY', 'CHF', 'LKR', 'FRANC'][l_linenumber % 6 + 1] AS code"),
    "fn07_date": _lines("CASE WHEN l_linenumber % 6 < 5 THEN strftime(l_shipdate, '%Y-%m-%d') END AS day"),
    "fn08_identifier": _lines("CASE l_linenumber % 2 WHEN 0 THEN 'MAEU12' || q ELSE 'AB' || q END AS code"),
    "fn09_amount": _lines("cents / 100 AS value, l_linenumber % 2 = 1 AS warn"),
    "fn10_semantic_key": r"SELECT p_partkey, 'GOODS:' || list_aggregate(list_sort(list_filter(string_split_regex(lower(p_type || ' ' || p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> '')), 'string_agg', ' ') AS cache_key FROM part",
    "fn11_trimmed_text": _lines("l_returnflag || ' x' AS value"),
    "fn12_normalize_dispatch": _lines(
        """['GROSS_WEIGHT', 'VOLUME', 'PACKAGE_COUNT', 'TOTAL_AMOUNT', 'HS_CODE', 'SHIPPING_MARKS'][l_linenumber % 6 + 1] AS kind,
        [q || ' kg', q || ' cbm', q || ' cartons', 'unknown', '85.16 ' || q, '  marks ' || q || ' '][l_linenumber % 6 + 1] AS raw,
        CASE WHEN l_linenumber % 6 < 3 THEN q::DOUBLE END AS num, CASE l_linenumber % 6 WHEN 4 THEN '8516' || q WHEN 5 THEN 'marks ' || q END AS text,
        CASE l_linenumber % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'cbm' WHEN 2 THEN 'cartons' END AS unit, l_linenumber % 6 = 3 AS warn"""
    ),
    "fn13_text_key": "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS text_key FROM documents",
    "fn14_entity_confidence": _lines(
        "floor(least(9500, 55 * (CASE WHEN l_linenumber % 3 > 0 THEN round(confidence * 100) ELSE 80 END) + 35 * (CASE WHEN l_linenumber % 2 > 0 THEN round((1 - l_tax) * 100) ELSE 75 END) + CASE WHEN l_returnflag = 'R' THEN 850 ELSE 1000 END) / 100 + 0.5) / 100 AS score"
    ),
    "fn15_model_confidence": _lines("CASE WHEN l_linenumber % 3 = 0 THEN 0.55 ELSE round(least(0.93, (0.82 + confidence) / 2), 4) END AS confidence"),
    "fn17_jaccard": "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS a, string_split(lower(p_type) || ' small box', ' ') AS b FROM part)",
    "fn18_cosine": """WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
        p AS (SELECT vec_id, sum(x * m) AS d, sqrt(sum(x * x)) AS a, sqrt(sum(m * m)) AS b FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) JOIN c USING (label, i) GROUP BY vec_id)
        SELECT vec_id, round(d / (a * b), 5) AS cosine FROM p""",
    "fn19_similarity": """WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
        p AS (SELECT vec_id, sum(x * m) AS d, sqrt(sum(x * x)) AS a, sqrt(sum(m * m)) AS b FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) JOIN c USING (label, i) GROUP BY vec_id)
        SELECT vec_id, round(CASE vec_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN d / (a * b) ELSE 2 / 3 END, 5) AS similarity FROM p""",
    "fn20_first_number": _lines("-cents / 100 AS value"),
    "fn21_country": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN length(n_name) = 2 THEN upper(n_name) END ELSE upper(left(n_name, 2)) END AS code FROM nation",
    "fn22_declaration_formats": _lines("seq, l_linenumber % 4 < 2 AS currency_ok, seq % 3 < 2 AS incoterm_ok, q % 3 = 0 AND q > 0 AS number_ok"),
    "fn23_error_rate": "SELECT p_partkey, round(levenshtein(lower(regexp_replace(translate(p_name || ' ' || p_brand, 'aeo', 'sz0'), '[^A-Za-z0-9]', '', 'g')), t) / length(t), 6) AS error_rate FROM (SELECT *, lower(regexp_replace(p_name || p_brand, '[^A-Za-z0-9]', '', 'g')) AS t FROM part)",
    "fn24_net_mass": _lines("greatest(0, l_quantity * 10 - l_linenumber * 22.5) AS net"),
    "fn25_event_hash": "SELECT event_id, left(sha256(strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || event_type || '|record|' || props), 16) AS event_hash FROM events",
    "fn26_party_role": "SELECT c_custkey, ['shipper', 'notify_party', 'consignee', 'issuing_bank', 'carrier', 'freight_forwarder', 'consignee', NULL][c_custkey % 8 + 1] AS role FROM customer",
    "fn28_ids": sql("assertions", "SELECT 'shipment:' || shipment_id || ':field:' || entity_type AS canonical_field_id, 'assertion:' || document_id || ':' || entity_type || ':' || seq AS assertion_id FROM assertions"),
    "fn29_strip_fences": "SELECT c_custkey, '{\"id\": ' || c_custkey || '}' AS body FROM customer",
    "fn30_spread_scores": _lines(", ".join(f"CASE WHEN l_linenumber % 4 = {i} THEN confidence ELSE round((1 - confidence) / 3, 4) END AS {x}" for i, x in enumerate("abcd"))),
    "flt10_confidence_band": _lines("CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band"),
    "flt13_null_like": _lines("l_linenumber % 4 < 3 AS null_like"),
    "flt17_numeric_close": _lines("abs(l_quantity - l_quantity * (1 + l_tax / 10)) <= greatest(l_quantity * (1 + l_tax / 10) * 0.005, 1e-9) AS close"),
    "set4_token_sets": "SELECT p_partkey, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_either FROM (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS a, string_split(lower(p_type) || ' red box', ' ') AS b FROM part)",
}
