"""Queries of tables that are changed in place, batch by batch with a replay, and of streams in several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators import ledger as K
from ..sources.bindings import decisions, goods, lines, paper_readings, sql, table
from ..sources.store import shared_path
from ..sources.stored import StoredTable
from ..streaming import ingest as I
from .intake import _CACHE, _cache

CACHE = "cache_key string, canonical string, used struct<l_shipdate:date,l_orderkey:long,seq:long>, hit_count long, batch long, deleted boolean"
BATCHES = 3


def _table(spark, name: str, schema: str, keys: tuple, by: tuple = (), buckets: int = 8) -> StoredTable:
    return StoredTable(spark, shared_path(spark, name), schema, keys, by, buckets)


def _batches(rows: DataFrame, by) -> list[DataFrame]:
    """The rows in batches by a number; the second arrives twice, as after a failure."""
    parts = [rows.filter(F.pmod(by, F.lit(BATCHES)) == k) for k in range(BATCHES)]
    return [parts[0], parts[1], parts[1], *parts[2:]]


def _stored_cache(spark, sf_dir) -> StoredTable:
    """The normalisation cache, stored: upserts of all uses, in batches."""
    t = _table(spark, "norm-cache", CACHE, ("cache_key",))
    used = _cache(spark, sf_dir)
    used = used.select("cache_key", "canonical", F.col("used").cast("struct<l_shipdate:date,l_orderkey:long,seq:long>").alias("used"), F.lit(0).cast("long").alias("hit_count"), F.lit(-1).cast("long").alias("batch"), F.lit(False).alias("deleted"))
    for batch in _batches(used, F.col("used.l_orderkey")):
        t.upsert(batch, ["used"])
    return t


def snk03_stored_cache(spark, sf_dir):
    return _stored_cache(spark, sf_dir).read().select("cache_key", "canonical")


def snk04_hit_counter(spark, sf_dir):
    """Hits of lookups in two batches, the second one replayed, added to the stored counts; every key has one row."""
    t = _stored_cache(spark, sf_dir)
    looked = _cache(spark, sf_dir).filter("used.seq % 2 = 0")
    for k, part in ((0, 0), (1, 1), (1, 1)):
        t.count_up(looked.filter(F.col("used.l_orderkey") % 2 == part), "hit_count", k)
    return t.read().select("cache_key", "hit_count")


def snk04_hits_of_cache(spark, sf_dir):
    """The same counts without a stored table, upon one hit that each key has already."""
    c = K.cache_upsert(_cache(spark, sf_dir), [F.col("used")]).withColumn("hit_count", F.lit(1).cast("long"))
    return K.hit_counts(c, _cache(spark, sf_dir).filter("used.seq % 2 = 0")).select("cache_key", "hit_count")


def snk05_cache_purge(spark, sf_dir):
    """Of a cache of goods and ports what is left when only goods are kept."""
    c = _cache(spark, sf_dir).select(F.when(F.col("used.seq") % 3 == 0, F.regexp_replace("cache_key", "^GOODS", "PORT")).otherwise(F.col("cache_key")).alias("cache_key"))
    return K.purged(c, ["GOODS"]).groupBy("cache_key").agg(F.count("*").alias("n"))


def snk05_stored_purge(spark, sf_dir):
    """The same on a stored cache, where deleted entries are marked; keys of an even length are ports."""
    t = _table(spark, "purged-cache", "cache_key string, canonical string, deleted boolean", ("cache_key",))
    port = F.when(F.length("cache_key") % 2 == 0, F.regexp_replace("cache_key", "^GOODS", "PORT")).otherwise(F.col("cache_key"))
    t.upsert(_cache(spark, sf_dir).select(port.alias("cache_key"), "canonical", F.lit(False).alias("deleted")), ["deleted"])
    for _ in range(2):
        t.mark(~K.of_types(["GOODS"]), "deleted")
    return t.read().filter("NOT deleted").select("cache_key")


def snk06_stored_resolutions(spark, sf_dir):
    """Reviewers' decisions, upserted in batches."""
    t = _table(spark, "resolutions", "shipment_id long, entity_type string, seq long, value_num double, value_txt string", ("shipment_id", "entity_type"), ("shipment_id",))
    for batch in _batches(decisions(spark, sf_dir), F.col("seq")):
        t.upsert(batch, ["seq"])
    return t.read()


def snk07_stored_metadata(spark, sf_dir):
    """Declaration data, trimmed and not blank, upserted in batches."""
    t = _table(spark, "metadata", "shipment_id long, field_name string, value string, seq long", ("shipment_id", "field_name"), ("shipment_id",))
    m = lines(spark, sf_dir).select(F.col("l_orderkey").alias("shipment_id"), F.lit("transport_mode").alias("field_name"), F.trim(F.when(F.col("q") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("q").cast("string")))).alias("value"), "seq")
    for batch in _batches(m.filter("value != ''"), F.col("seq")):
        t.upsert(batch, ["seq"])
    return t.read().select("shipment_id", "field_name", "value")


def snk08_stored_rows(spark, sf_dir):
    """Goods rows appended in batches, the second one twice; each goes on from its shipment's last row index."""
    t = _table(spark, "goods-rows", "shipment_id long, row_index long, seq long, description string, batch long", ("shipment_id", "row_index"), ("shipment_id",))
    g = goods(spark, sf_dir).select("shipment_id", "seq", "description")
    for k, rows in ((0, "seq % 3 = 2"), (1, "seq % 3 = 0"), (1, "seq % 3 = 0"), (2, "seq % 3 = 1")):
        t.append(g.filter(rows), "row_index", [F.col("seq")], k)
    return t.read().select("shipment_id", "seq", "row_index")


def _status_events(spark, sf_dir) -> DataFrame:
    failed = F.when(F.col("event_type") == "error", F.concat(F.lit("failed at "), F.col("event_id")))
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), failed.alias("error"), F.col("ts").alias("at"), "event_id")


def snk09_status_update(spark, sf_dir):
    u = K.status_update(_status_events(spark, sf_dir), "user_id", [F.col("at"), F.col("event_id")])
    return u.select("user_id", "status", "error", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def snk09_stored_status(spark, sf_dir):
    """The same in a stored table, in batches."""
    t = _table(spark, "statuses", "user_id long, at timestamp_ntz, event_id long, status string, error string", ("user_id",))
    for batch in _batches(_status_events(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp_ntz")), F.col("event_id")):
        t.upsert(batch, ["at", "event_id"])
    return t.read().select("user_id", "status", "error", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def str03_live_progress(spark, sf_dir):
    """Progress of dossiers from files of status events that arrive one after the other, the second one again at the end."""
    where = shared_path(spark, "progress")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    for k, part in enumerate((0, 1, 2, 1)):
        o.filter(F.col("o_orderkey") % 3 == part).coalesce(1).write.parquet(f"{where}/in/{k}")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "error").otherwise("pending")
    both = lambda rows: rows.select(F.col("o_custkey").alias("dossier_id"), F.col("o_orderkey").cast("string").alias("document_id"), F.explode(F.array(F.struct(F.lit("pending").alias("status"), F.lit("2026-01-01").cast("timestamp").alias("at")), F.struct(status.alias("status"), F.lit("2026-01-02").cast("timestamp").alias("at")))).alias("e")).select("dossier_id", "document_id", "e.*")
    I.live_progress(spark, f"{where}/in/*", o.schema, where, f"{where}/checkpoint", both, files=1, buckets=8)
    return I.progress_tables(spark, where, 8)[1].read().drop("at")


def str01_document_stream(spark, sf_dir):
    """The document job over readings of papers that arrive in three batches; every 37th can't be read and goes to the dead letters."""
    where = shared_path(spark, "documents")
    r = paper_readings(spark, sf_dir).withColumn("tokens", F.when(F.col("document_id") % 37 > 0, F.col("tokens")))
    for part in range(3):  # as many files as there are tasks
        r.filter(F.col("document_id") % 3 == part).write.parquet(f"{where}/in/{part}")
    fault = E.faults(F.col("tokens"))
    I.ingest(spark, f"{where}/in/*", r.schema, f"{where}/out", f"{where}/checkpoint", E.results, F.size(fault) == 0, lambda bad: E.error_results(bad, fault), files=int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = spark.read.parquet(f"{where}/out/done").unionByName(spark.read.parquet(f"{where}/out/dead"))
    return out.select("document_id", "document_type", F.array_join("errors", ",").alias("errors"), (F.size("entities") > 0).alias("has_entities"), F.size("raw_ocr").alias("n_tokens"))


def str02_audit_stream(spark, sf_dir):
    """Audit events without repeats: every event comes twice within the watermark."""
    where = shared_path(spark, "stream")
    one = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    twice = one.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    e = twice.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("events").alias("module"), F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("outcome"))
    q = I.audit_events(e).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/out").select("event_hash", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


QUERIES = {
    f.__name__: f
    for f in (
        snk03_stored_cache, snk04_hit_counter, snk04_hits_of_cache, snk05_cache_purge, snk05_stored_purge, snk06_stored_resolutions, snk07_stored_metadata, snk08_stored_rows, snk09_status_update, snk09_stored_status,
        str01_document_stream, str02_audit_stream, str03_live_progress,
    )
}

_LAST_STATUS = "SELECT user_id, event_type AS status, CASE WHEN event_type = 'error' THEN 'failed at ' || event_id END AS error, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
_HITS = "SELECT cache_key, {} + count(*) FILTER (seq % 2 = 0) AS hit_count FROM cache GROUP BY 1"
ORACLES = {
    "snk03_stored_cache": sql("lines", f", {_CACHE} SELECT cache_key, canonical FROM cache QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY l_shipdate DESC, l_orderkey DESC, seq DESC) = 1"),
    "snk04_hit_counter": sql("lines", f", {_CACHE} {_HITS.format(0)}"),
    "snk04_hits_of_cache": sql("lines", f", {_CACHE} {_HITS.format(1)}"),
    "snk05_cache_purge": sql("lines", f", {_CACHE} SELECT cache_key, count(*) AS n FROM cache WHERE seq % 3 <> 0 GROUP BY 1"),
    "snk05_stored_purge": sql("lines", f", {_CACHE} SELECT DISTINCT cache_key FROM cache WHERE length(cache_key) % 2 = 1"),
    "snk06_stored_resolutions": sql("decisions", "SELECT shipment_id, entity_type, max(seq) AS seq, arg_max(value_num, seq) AS value_num, arg_max(value_txt, seq) AS value_txt FROM decisions GROUP BY 1, 2"),
    "snk07_stored_metadata": sql("lines", "SELECT l_orderkey AS shipment_id, 'transport_mode' AS field_name, arg_max(q::VARCHAR, seq) AS value FROM lines WHERE q % 4 <> 0 GROUP BY 1"),
    "snk08_stored_rows": sql("goods", "SELECT shipment_id, seq, row_number() OVER (PARTITION BY shipment_id ORDER BY (seq + 1) % 3, seq) AS row_index FROM goods"),
    "snk09_status_update": _LAST_STATUS,
    "snk09_stored_status": _LAST_STATUS,
    "str01_document_stream": sql("papers", "SELECT document_id, CASE WHEN document_id % 37 = 0 THEN 'unknown' ELSE any_value(document_type) END AS document_type, CASE WHEN document_id % 37 = 0 THEN 'NO_TOKENS' ELSE '' END AS errors, document_id % 37 > 0 AS has_entities, CASE WHEN document_id % 37 = 0 THEN 0 ELSE count(*) END AS n_tokens FROM papers GROUP BY document_id"),
    "str02_audit_stream": "SELECT DISTINCT left(sha256(strftime(ts, '%Y-%m-%d %H:%M:%S') || '|events|' || event_type || '|' || event_id), 16) AS event_hash, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events",
    "str03_live_progress": "SELECT o_custkey AS dossier_id, count(*) AS n_documents, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'O') AS n_error FROM orders GROUP BY 1",
}
