"""Tables of dossiers, documents, cache entries and events: checks on intake, upserts, deletions, listings and trails.

Every function takes and returns DataFrames of all dossiers at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import semantic_key, strip_fences
from .consensus import latest

DONE, ERROR, PENDING, PROCESSING = "done", "error", "pending", "processing"


# Intake


def intake(files: DataFrame, dossier: str = "dossier_id", name: str = "name") -> DataFrame:
    """dossier, accepted, n_files: a dossier is refused as a whole if any of its files isn't a PDF."""
    return files.groupBy(dossier).agg(F.bool_and(F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))).alias("accepted"), F.count("*").alias("n_files"))


def stored_names(files: DataFrame, name: str = "name") -> DataFrame:
    """``files`` with file_id and file_name: stored names are the id, an underscore and the original name."""
    parts = F.split(name, "_", 2)
    return files.withColumns({"file_id": F.get(parts, F.lit(0)), "file_name": F.get(parts, F.lit(1))})


def new_files(files: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose keys no known file has."""
    return files.join(known.select(*keys).distinct(), keys, "left_anti")


def usable(documents: DataFrame, schema: str, raw: str = "raw", status: str = "status") -> DataFrame:
    """Done documents whose JSON is an object, parsed as ``x``."""
    rows = documents.filter((F.col(status) == DONE) & F.rlike(raw, F.lit(r"^\s*\{")))
    return rows.withColumn("x", F.from_json(raw, schema)).filter("x IS NOT NULL")


def entity_rows(parsed: DataFrame, entities: str = "x.entities") -> DataFrame:
    """One row per entity, with its ordinal ``ent_seq`` in the document."""
    return parsed.select("*", F.posexplode(entities).alias("ent_seq", "entity"))


def goods_rows(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """``documents`` with a row for each goods row of their JSON list: row_index, description, quantity, unit, unit_price, total_price.

    Each element is read alone: one that is no object, has no description or a number that can't be read is left out, and
    the others stay. Missing numbers are 0, a missing unit is pieces, a missing row_index is the row's number among those
    that stay. Texts that aren't lists, or not JSON at all, give no rows; fences around them are ignored.
    """
    items = F.try_variant_get(F.try_parse_json(strip_fences(F.col(raw))), "$", "array<variant>")
    numbers = ("quantity", "unit_price", "total_price")

    def row(e: Column) -> Column:
        text = lambda c: F.trim(F.try_variant_get(e, f"$.{c}", "string"))
        number = lambda c: F.try_variant_get(e, f"$.{c}", "double")
        readable = F.lit(True)
        for c in numbers:
            readable = readable & (F.coalesce(text(c), F.lit("")).isin("") | number(c).isNotNull())
        index = F.try_variant_get(e, "$.row_index", "long")
        readable = readable & (text("row_index").isNull() | index.isNotNull())
        fields = [F.coalesce(text("description"), F.lit("")).alias("description"), F.coalesce(text("unit"), F.lit("pieces")).alias("unit"), *(F.coalesce(number(c), F.lit(0.0)).alias(c) for c in numbers)]
        return F.struct(*fields, index.alias("stated"), readable.alias("readable"))

    good = F.filter(F.transform(items, row), lambda r: r["readable"] & (r["description"] != ""))
    out = documents.select("*", F.posexplode(good).alias("__k", "__r"))
    rest = [F.col(f"__r.{c}").alias(c) for c in ("description", "quantity", "unit", "unit_price", "total_price")]
    return out.select(*(F.col(c) for c in documents.columns), F.coalesce("__r.stated", (F.col("__k") + 1).cast("long")).alias("row_index"), *rest)


def document_type(column: Column, parsed: Column) -> Column:
    return F.coalesce(column, parsed, F.lit("unknown"))


def source_label(label: Column, name: Column) -> Column:
    return F.concat_ws(" — ", label, name)


def labelled(rows: DataFrame, key: str, labels: dict[str, str]) -> DataFrame:
    """``rows`` with ``label``: the stated one, else the key in title case."""
    stated = F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), F.col(key))
    return rows.withColumn("label", F.coalesce(stated, F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))))


# The normalisation cache


def cache_upsert(events: DataFrame, order: list[Column]) -> DataFrame:
    """cache_key, canonical: the last value of each key."""
    return latest(events, ["cache_key"], order).select("cache_key", "canonical")


def hit_counts(cache: DataFrame, lookups: DataFrame) -> DataFrame:
    """``cache`` (cache_key, hit_count, ...) with one hit more for each lookup of a key; keys that aren't looked up stay as they are."""
    n = lookups.groupBy("cache_key").agg(F.count("*").alias("__n"))
    return cache.join(n, "cache_key", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).select(*cache.columns)


def of_types(types: list[str], key: str = "cache_key") -> Column:
    """Whether a cache key is of one of the types; a key begins with its type and a colon."""
    return F.split_part(key, F.lit(":"), F.lit(1)).isin(*types)


def purged(cache: DataFrame, keep: list[str]) -> DataFrame:
    """Entries of the types to keep; all others are deleted."""
    return cache.filter(of_types(keep))


def seeded(cache: DataFrame, seeds: list[tuple[str, str]]) -> DataFrame:
    """The cache and those seed rows (key, canonical; a fixed list) whose key it doesn't have."""
    rows = cache.sparkSession.createDataFrame(seeds, "cache_key string, canonical string")
    return cache.select("cache_key", "canonical").unionByName(rows.join(cache, "cache_key", "left_anti"))


def canonical_lookup(values: DataFrame, cache: DataFrame) -> DataFrame:
    """``values`` (entity_type, raw, ...) with cache_key and canonical; canonical is null for a miss."""
    return values.withColumn("cache_key", semantic_key(F.col("entity_type"), F.col("raw"))).join(cache.select("cache_key", "canonical"), "cache_key", "left")


def canonicalize_misses(values: DataFrame, cache: DataFrame, fn=None) -> DataFrame:
    """cache_key, entity_type, raw, canonical for each distinct miss, to be put into the cache.

    ``fn`` is a ``mapInPandas`` function from and to these columns (canonical comes in as the trimmed raw value, which
    is the result without ``fn``). Of raw values with one key the first in order of the alphabet is asked for.
    """
    keyed = values.withColumn("cache_key", semantic_key(F.col("entity_type"), F.col("raw"))).filter("cache_key IS NOT NULL")
    misses = keyed.groupBy("cache_key", "entity_type").agg(F.min("raw").alias("raw")).join(cache.select("cache_key"), "cache_key", "left_anti")
    misses = misses.select("cache_key", "entity_type", "raw", F.trim("raw").alias("canonical"))
    return misses if fn is None else misses.mapInPandas(fn, misses.schema)


# Declaration data


def metadata_upsert(rows: DataFrame, order: list[Column]) -> DataFrame:
    """shipment_id, field_name, value: of values that aren't blank the last one, trimmed."""
    r = rows.withColumn("value", F.trim("value")).filter("value != ''")
    return latest(r, ["shipment_id", "field_name"], order).select("shipment_id", "field_name", "value")


def append_rows(old: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """``new`` rows of shipments with ``row_index``, going on from the last one of ``old`` (shipment_id, row_index)."""
    last = old.groupBy("shipment_id").agg(F.max("row_index").alias("__last"))
    number = F.row_number().over(Window.partitionBy("shipment_id").orderBy(*order))
    return new.withColumn("__n", number).join(last, "shipment_id", "left").withColumn("row_index", F.coalesce("__last", F.lit(0)) + F.col("__n")).drop("__last", "__n")


# Dossiers


def created(files: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(dossiers, documents) of new files (dossier_id, name, path): one pending dossier, and a pending document for each file.

    A document's id follows from its dossier and path, so that a repeated run makes the same rows.
    """
    documents = files.select(F.sha2(F.concat_ws("/", "dossier_id", "path"), 256).substr(1, 32).alias("document_id"), "dossier_id", F.col("name").alias("original_name"), F.col("path").alias("file_path"), F.lit(PENDING).alias("status"), at.alias("created_at"))
    return files.select("dossier_id").distinct().select("dossier_id", F.lit(PENDING).alias("status"), at.alias("created_at")), documents


def save_results(documents: DataFrame, results: DataFrame) -> DataFrame:
    """``documents`` with what ``results`` (document_id, document_type, raw, error) say: JSON, type, done or error; others stay as they are."""
    r = results.select("document_id", F.col("document_type").alias("__type"), F.col("raw").alias("__raw"), F.col("error").alias("__error"), F.lit(True).alias("__there"))
    out = documents.join(r, "document_id", "left")
    there = F.coalesce("__there", F.lit(False))
    return out.withColumns({
        "status": F.when(there, F.when(F.col("__error").isNull(), DONE).otherwise(ERROR)).otherwise(F.col("status")),
        "document_type": F.when(there, F.col("__type")), "raw": F.when(there, F.col("__raw")), "error": F.col("__error"),
    }).drop("__type", "__raw", "__error", "__there")


def status_update(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """key, status, error, updated_at: the last of each key's events (status, error, at); only an error status keeps its text."""
    error = F.when(F.col("status") == ERROR, F.col("error"))
    return latest(events.select(key, "status", error.alias("error"), F.col("at").alias("updated_at"), F.struct(*order).alias("__order")), [key], [F.col("__order")]).drop("__order")


def first_of(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= most)


def cascade_delete(gone: DataFrame, tables: dict[str, DataFrame], key: str = "dossier_id") -> dict[str, DataFrame]:
    """The tables without rows of the dossiers that are gone."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def outcome(documents: DataFrame, key: str = "dossier_id") -> DataFrame:
    """done if every document is done, else error."""
    return documents.groupBy(key).agg(F.when(F.bool_and(F.coalesce(F.col("status") == DONE, F.lit(False))), DONE).otherwise(ERROR).alias("outcome"))


def channel(status: Column, override: Column) -> Column:
    """Customs channel of a dossier; a reviewer's wins."""
    return F.coalesce(override, F.when(status == DONE, "green").when(status == ERROR, "hold").when(status == PROCESSING, "review").otherwise("pending"))


def progress(status: Column) -> Column:
    return F.when(status == DONE, 100).when(status == PROCESSING, 50).otherwise(0)


def newest(dossiers: DataFrame, n: int = 50) -> DataFrame:
    return dossiers.orderBy(F.desc("created_at"), "dossier_id").limit(n)


def listing(dossiers: DataFrame, documents: DataFrame) -> DataFrame:
    """Dossiers with n_documents and their documents (a dossier's own, some dozens) in order of ``seq``."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "name")))
    per = documents.groupBy("dossier_id").agg(F.count("*").alias("n_documents"), rows.alias("documents"))
    return dossiers.join(per, "dossier_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


def oldest_pending(dossiers: DataFrame, owner: str) -> DataFrame:
    """Pending dossiers with their place in their owner's queue."""
    return dossiers.filter(F.col("status") == PENDING).withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy("created_at", "dossier_id")))


def status_report(dossiers: DataFrame, documents: DataFrame) -> DataFrame:
    """dossier_id, status, progress, n_documents, n_done and its documents (seq, document_id, document_type, confidence, status) in order."""
    per = documents.groupBy("dossier_id").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("status") == DONE).alias("n_done"), F.array_sort(F.collect_list(F.struct("seq", "document_id", "document_type", "confidence", "status"))).alias("documents")
    )
    out = dossiers.select("dossier_id", "status").join(per, "dossier_id", "left")
    return out.select("dossier_id", "status", progress(F.col("status")).alias("progress"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_done", F.lit(0)).alias("n_done"), "documents")


def search(rows: DataFrame, text: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """Rows in which any of the columns holds ``text``, whatever the case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(c), F.lit(text.lower()))
    return rows.filter(found if where is None else where & found)


# Trails


def trail(events: DataFrame, key: str) -> DataFrame:
    """Each event with its place in its key's trail and the trail's length; order is time, then hash."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_hash"))
    return events.withColumn("place", place).join(events.groupBy(key).agg(F.count("*").alias("n_events")), key)


def derived_trail(documents: DataFrame, fields: DataFrame, assessed: DataFrame) -> DataFrame:
    """shipment_id, stage, action, subject, outcome: what results tell about each step. Only facts.

    ``documents``: shipment_id, document_id, document_type, status; ``fields``: shipment_id, entity_type, status;
    ``assessed``: shipment_id, blocker_count, export_allowed.
    """
    ok = F.col("status") == DONE
    step = lambda stage, action, subject, result: F.struct(F.lit(stage).alias("stage"), F.lit(action).alias("action"), subject.cast("string").alias("subject"), result.cast("string").alias("outcome"))
    own = F.array(step(1, "classified", F.col("document_id"), F.col("document_type")), step(2, "extracted", F.col("document_id"), F.when(ok, DONE).otherwise(ERROR)))
    per_document = documents.select("shipment_id", F.inline(own))
    conflicts = F.count_if(F.col("status") == "conflict")
    resolved = fields.groupBy("shipment_id").agg(F.count("*").alias("n"), conflicts.alias("c")).select("shipment_id", F.inline(F.array(step(3, "resolved", F.concat(F.col("n"), F.lit(" fields")), F.concat(F.col("c"), F.lit(" conflicts"))))))
    ready = assessed.select("shipment_id", F.inline(F.array(step(4, "assessed", F.concat(F.col("blocker_count"), F.lit(" blockers")), F.when(F.col("export_allowed"), "ready").otherwise("blocked")))))
    return per_document.unionByName(resolved).unionByName(ready)


# Reports on extraction


def telemetry(required: DataFrame, local: DataFrame, recovered: DataFrame) -> DataFrame:
    """document_id, document_type, requested, local, fallback, recovered, failed.

    ``required``: document_id, document_type, entity_type; ``local`` and ``recovered``: document_id, entity_type. What isn't
    found locally goes to the fallback; what the fallback doesn't recover has failed.
    """
    key = ["document_id", "entity_type"]
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    r = required.join(mark(local, "l"), key, "left").join(mark(recovered, "r"), key, "left")
    here = F.coalesce(F.col("l"), F.lit(False))
    later = ~here & F.coalesce(F.col("r"), F.lit(False))
    return r.groupBy("document_id", "document_type").agg(F.count("*").alias("requested"), F.count_if(here).alias("local"), F.count_if(~here).alias("fallback"), F.count_if(later).alias("recovered"), F.count_if(~here & ~later).alias("failed"))


def ocr_quality(tokens: DataFrame, expected: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, n_tokens, confidence, n_expected, n_recovered: ``expected`` and ``found`` hold document_id, entity_type, value.

    A field is recovered if what was found equals what was expected in letters and digits.
    """
    from ..functions.normalize import ocr_text

    per = tokens.groupBy("document_id").agg(F.count("*").alias("n_tokens"), F.round(F.round(F.avg("confidence"), 8), 4).alias("confidence"))
    f = found.select("document_id", "entity_type", ocr_text(F.col("value")).alias("f")).distinct()
    e = expected.select("document_id", "entity_type", ocr_text(F.col("value")).alias("e")).join(f, (["document_id", "entity_type"]), "left")
    hit = e.groupBy("document_id", "entity_type").agg(F.bool_or(F.coalesce(F.col("e") == F.col("f"), F.lit(False))).alias("hit"))
    fields = hit.groupBy("document_id").agg(F.count("*").alias("n_expected"), F.count_if("hit").alias("n_recovered"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return per.join(fields, "document_id", "left").select("document_id", "n_tokens", "confidence", zero("n_expected"), zero("n_recovered"))


#: The rules that are run, with what they look at.
RULES = [
    ("NUMERIC_MATCH", "Numbers agree", "Numbers of one field differ by at most 0.01.", True),
    ("TEXT_MATCH", "Texts agree", "Texts of one field are at least 0.85 similar.", False),
]


def rule_catalogue(a: DataFrame) -> DataFrame:
    """rule, label, description, status, n_fields: the active rules and how many fields of ``a`` (assertions) each applies to."""
    n = a.groupBy("shipment_id", "entity_type", "is_num").agg(F.lit(1)).groupBy("is_num").agg(F.count("*").alias("n"))
    rules = a.sparkSession.createDataFrame(RULES, "rule string, label string, description string, is_num boolean")
    return rules.join(n, "is_num", "left").select("rule", "label", "description", F.lit("Ready").alias("status"), F.coalesce("n", F.lit(0)).alias("n_fields"))
