"""Readers and writers of JSON documents: result bundles, page readings, manifests of expected values, audit and graph files.

Files hold one JSON document each (``multi_line``) or one per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE = "documents map<string,string>"
PAGES = "file_path string, total_pages long, pages array<struct<page_number:long,width:double,height:double,tokens:array<struct<text:string,page:long,bbox:array<double>,confidence:double>>>>"
MANIFEST = (
    "shipment_reference string, documents array<struct<file:string,document_type:string,pages:long,"
    "expected_fields:map<string,struct<label:string,value:string>>,expected_lines:array<string>,expected_line_items:array<map<string,string>>>>"
)


def _json(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_bundles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """name, raw: every document of the bundles, its result as JSON text."""
    return _json(spark, path, BUNDLE, multi_line).select(F.explode("documents").alias("name", "raw"))


def read_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """file_path, page, width, height, page_seq, pos, text, x1, y1, x2, y2, confidence: every token, ``pos`` counted over the file."""
    pages = _json(spark, path, PAGES, multi_line).select("file_path", F.posexplode("pages").alias("page_seq", "p"), F.transform("pages", lambda p: F.size(p["tokens"])).alias("sizes"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("page_seq")), F.lit(0), lambda s, n: s + F.greatest(n, F.lit(0)))
    t = pages.select("file_path", "page_seq", F.col("p.page_number").alias("page"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), before.alias("before"), F.posexplode("p.tokens").alias("k", "t"))
    box = [F.get("t.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return t.select("file_path", "page", "width", "height", "page_seq", (F.col("before") + F.col("k")).cast("long").alias("pos"), F.col("t.text").alias("text"), *box, F.round("t.confidence", 4).alias("confidence"))


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """shipment_reference, file, document_type, pages, fields, lines, line_items: one row per document of the manifests."""
    d = _json(spark, path, MANIFEST, multi_line).select("shipment_reference", F.explode("documents").alias("d"))
    return d.select("shipment_reference", "d.file", "d.document_type", "d.pages", F.col("d.expected_fields").alias("fields"), F.col("d.expected_lines").alias("lines"), F.col("d.expected_line_items").alias("line_items"))


def expected_fields(manifest: DataFrame) -> DataFrame:
    """file, document_type, entity_type, label, value: the manifest's values, one row each."""
    return manifest.select("file", "document_type", F.explode("fields").alias("entity_type", "f")).select("file", "document_type", "entity_type", "f.label", "f.value")


def graph_documents(graphs: DataFrame) -> DataFrame:
    """shipment_id, body: each shipment's graph (nodes, edges) as one JSON text."""
    return graphs.select("shipment_id", F.to_json(F.struct("shipment_id", "nodes", "edges")).alias("body"))


def audit_documents(trail: DataFrame, key: str = "shipment_id") -> DataFrame:
    """key, body: each shipment's trail (place and event columns) as one JSON text, events in order."""
    rest = sorted(c for c in trail.columns if c not in (key, "place"))
    events = F.array_sort(F.collect_list(F.struct("place", *rest)))
    return trail.groupBy(key).agg(events.alias("events")).select(key, F.to_json(F.struct(key, F.size("events").alias("count"), "events")).alias("body"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Write ``body`` of every row, one JSON document per line; compressed, since the keys of JSON repeat throughout."""
    documents.select("body").write.option("compression", "gzip").text(path)
