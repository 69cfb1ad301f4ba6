"""Secret scan with multipart credential linking.

Strong spans (assignments, access identifiers, long hexadecimal runs) stand alone. Weak ones, which look like ordinary
text, are identifiers (``user = x``), secrets (mixed tokens of 20 or more characters) and endpoints (addresses with a
host). An interval join within each text, its scope, reports a weak part only if a complementary part lies within
``reach`` characters: an identifier or endpoint needs a secret near it, a secret needs an identifier or endpoint.

One scan finds all spans and writes them without the texts; everything after it works on offsets. The join is on the
row's number in that table and a bin of ``reach`` characters, so a text with very many parts is split by position, and it
is a semi join: no pairs are made. Only texts with weak parts enter it.

Defined results: null texts count as empty; offsets are code points, ends exclusive; rows are told apart by number, so
repeated ids and rows each get their own spans; null ids are kept; an empty table gives no rows. Only the id and the text
are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table
from .spans import joined, tagged, with_spans

STRONG = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
#: Runs have no upper bound and are possessive: a token is tried once, from its start, in time linear in its length.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "identifier": r"""(?i:\b(?:user(?:name|_id)?|login|client_id|account(?:_id)?|key_id)["']?\x20{0,4}[:=]\x20{0,4}["']?)([A-Za-z0-9._@-]{3,}+)""",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[A-Z0-9+/_=-]*+[a-z])(?=[a-z0-9+/_=-]*+[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])",
    "endpoint": r"\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp|s3)://[A-Za-z0-9._:@-]++",
}
#: Which kinds make a weak kind credible.
NEEDS = {"identifier": ("assign", "hex", "secret"), "secret": ("access", "identifier", "endpoint"), "endpoint": ("assign", "access", "hex", "secret")}
#: Text without which a kind can't occur: a cheap test before its expression runs.
_MUST = {"access": "AKIA", "endpoint": "://"}
_SPAN = "array<struct<start:int,end:int,value:string,part:string>>"


def _with_kinds(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``rows`` with an array of spans for each kind, long enough ones only."""
    text = F.col("__s_text")
    out = with_spans(rows, "__s_text", {f"__all_{k}": (PATTERNS[k], 1 if k == "assign" else 0, F.contains(text, F.lit(_MUST[k])) if k in _MUST else None) for k in kinds})
    least = {"assign": lambda x: F.length(x["part"]) >= 6, "access": lambda x: F.length(x["value"]) >= 20}
    return out.withColumns({k: F.filter(F.col(f"__all_{k}"), least[k]) if k in least else F.col(f"__all_{k}") for k in kinds}).drop(*(f"__all_{k}" for k in kinds))


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak rows of ``parts`` (row, kind, start, end) that have a complementary part within ``reach`` characters."""
    needs = F.create_map(*(x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    weak = parts.filter(F.col("kind").isin(*WEAK)).distinct().withColumn("other", F.explode(F.element_at(needs, F.col("kind"))))
    # Both sides lie in all bins that they touch, partners in one more on each side, which is ``reach`` or more characters.
    weak = weak.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))))
    near = parts.select(
        F.col("row").alias("o_row"), F.col("kind").alias("o_kind"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(F.floor(F.col("start") / reach) - 1, F.floor(F.col("end") / reach) + 1)).alias("o_bin"),
    )
    same = (F.col("row") == F.col("o_row")) & (F.col("bin") == F.col("o_bin")) & (F.col("other") == F.col("o_kind"))
    close = (F.col("o_start") - F.col("end") <= reach) & (F.col("start") - F.col("o_end") <= reach)
    apart = (F.col("o_start") != F.col("start")) | (F.col("o_end") != F.col("end"))
    return weak.join(near, same & close & apart, "left_semi").select("row", "kind", "start", "end").distinct()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 300) -> DataFrame:
    """id, and for each kind an array of (start, end, value, part); weak kinds hold linked spans only."""
    rows = docs.select(F.col(id_col).alias("__s_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__s_text"))
    found = _with_kinds(rows, (*STRONG, *WEAK)).drop("__s_text").withColumn("row", F.monotonically_increasing_id())
    found = cut(found, "secrets-spans")  # numbers its rows for good
    some = found.filter(F.size(F.concat(*WEAK)) > 0)
    parts = some.select("row", F.explode(F.concat(*(tagged(F.col(k), F.lit(k).alias("kind"), "start", "end") for k in (*STRONG, *WEAK)))).alias("x")).select("row", "x.*")
    weak = linked(parts, reach).groupBy(F.col("row").alias("o_row")).agg(F.collect_set(F.concat_ws(":", "kind", "start", "end")).alias("weak"))
    out = found.join(weak, F.col("row") == F.col("o_row"), "left")
    of = lambda k: F.filter(F.col(k), lambda x: F.array_contains(F.col("weak"), F.concat_ws(":", F.lit(k), x["start"], x["end"])))
    return out.select(F.col("__s_id").alias(id_col), *STRONG, *(F.when(F.col("weak").isNotNull(), of(k)).otherwise(F.array().cast(_SPAN)).alias(k) for k in WEAK))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    kinds = [(k, F.col(k)) for k in (*STRONG, *WEAK)]
    return found.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{k}") for k, c in kinds[:3]),
        F.sha2(joined(kinds[:3]).cast("binary"), 256).alias("base_sha256"),
        joined(kinds).alias("spans"),
    )
