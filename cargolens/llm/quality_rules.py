"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text; the ledger keeps the measurements and one integer whose bit k says that rule k
failed. A policy is a versioned mask of rules: applying it, or asking what it would keep without one of its rules,
is bitwise arithmetic on the ledger and never reads a text again. All of it is one narrow pass without a shuffle;
only ``ablations`` aggregates, and it first folds the ledger to its distinct bit patterns (at most 2 to the number of
rules), so no group grows with the data.

Defined results: null and empty texts have no words and fail ``few_words``. Repeated rows are judged alike and each
returned. An empty table gives an empty ledger. In ``ledger`` an input column that clashes with a result column is
replaced; ``keep_good`` returns the input's columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal_table, read_table, sealed, words_of

#: Measurements that the rules read, in the ledger's order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")

_m = F.col


def rules() -> list[tuple[str, Column]]:
    """(name, failed) for each rule; the position is the bit."""
    return [
        ("few_words", _m("n_words") < 50),
        ("repeated_windows", 100 * _m("n_repeat_words") > 50 * _m("n_words")),
        ("many_words", _m("n_words") > 1_000_000),
        ("short_words", _m("word_chars") < 3 * _m("n_words")),
        ("long_words", _m("word_chars") > 12 * _m("n_words")),
        ("symbols", 100 * _m("n_symbols") > 10 * _m("n_words")),
        ("repeated_lines", 100 * _m("n_dup_lines") > 30 * _m("n_lines")),
        ("capitals", 100 * _m("n_upper") > 50 * (_m("n_upper") + _m("n_lower"))),
        ("many_repeated_lines", (_m("n_dup_lines") >= 3) & (100 * _m("n_dup_lines") > 30 * _m("n_lines"))),
    ]


RULE_NAMES = ("few_words", "repeated_windows", "many_words", "short_words", "long_words", "symbols", "repeated_lines", "capitals", "many_repeated_lines")


def mask(*names: str) -> int:
    return sum(1 << RULE_NAMES.index(x) for x in names)


#: version: mask of the rules that reject a text. 2 rejects clean texts of a few lines with one of them repeated, and any
#: text for its length alone; 3 asks for three repeated lines and leaves length alone.
POLICIES = {
    1: mask("few_words", "repeated_windows"),
    2: mask(*RULE_NAMES[:8]),
    3: mask("few_words", "repeated_windows", "short_words", "long_words", "symbols", "capitals", "many_repeated_lines"),
}
CURRENT = 3


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are compared by 64-bit hash. They are sorted with their positions, so equal ones are neighbours: n log n
    for any text, and skipped for texts without a repeated window.
    """
    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, windows).otherwise(F.array().cast("array<bigint>"))


def _covered(ordered: Column) -> Column:
    twice = F.filter(
        ordered,
        lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)),
    )
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def count_of(chars: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))

    w, h, s, lines = (F.col(x) for x in ("__q_words", "__q_windows", "__q_sorted", "__q_lines"))
    out = docs.withColumns({"__q_words": words_of(F.col(text_col)), "__q_lines": F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))})
    out = out.withColumn("__q_windows", _repeat_words(w))
    out = out.withColumn("__q_sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    values = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": count_of(r"#*$%&|<>"),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(s.isNull(), F.lit(0)).otherwise(_covered(s)),
        "n_upper": count_of("A-Z"),
        "n_lower": count_of("a-z"),
    }
    return sealed(out, {k: v.cast("long") for k, v in values.items()}).drop("__q_words", "__q_windows", "__q_sorted", "__q_lines")


def failed_bits() -> Column:
    """The measurements' bits: bit k is set if rule k failed."""
    bits = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, and ``failed_bits``: bit k is set if rule k failed."""
    return measured(docs.select(id_col, text_col), text_col).select(id_col, *MEASURES, failed_bits().alias("failed_bits"))


def passes(policy: int = CURRENT, bits: str = "failed_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def keep_good(docs: DataFrame, text_col: str = "text", policy: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    clash = {c: f"__in_{c}" for c in docs.columns if c in MEASURES and c != text_col}
    out = measured(docs.withColumnsRenamed(clash), text_col).withColumn("__q_bits", failed_bits())
    return out.filter(passes(policy, "__q_bits")).drop(*MEASURES).withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def ablations(of: DataFrame) -> DataFrame:
    """policy, rule, n, n_kept, n_kept_without (kept if that rule were dropped), n_failed: from a ledger, by bit arithmetic."""
    spark = of.sparkSession
    patterns = of.groupBy("failed_bits").agg(F.count("*").alias("n"))
    stated = [(v, name, m, 1 << k) for v, m in POLICIES.items() for k, name in enumerate(RULE_NAMES) if m >> k & 1]
    plan = literal_table(spark, stated, {"policy": "int", "rule": "string", "mask": "long", "bit": "long"})
    b, m, bit = F.col("failed_bits"), F.col("mask"), F.col("bit")
    total = lambda keep: F.sum(F.when(keep, F.col("n")).otherwise(0))
    return (
        patterns.join(F.broadcast(plan), F.lit(True))  # at most 2 ** rules patterns, each against the stated policies
        .groupBy("policy", "rule")
        .agg(F.sum("n").alias("n"), total(b.bitwiseAND(m) == 0).alias("n_kept"), total(b.bitwiseAND(m).bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"), total(b.bitwiseAND(bit) != 0).alias("n_failed"))
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the rules of the current policy, and what it keeps."""
    base, bits = F.col("failed_bits").bitwiseAND(F.lit(POLICIES[1])) != 0, F.col("failed_bits").bitwiseAND(F.lit(POLICIES[CURRENT]))
    return ledger(read_table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, bits.alias("failed_bits"), base.alias("base_failed"), (~base & passes()).alias("kept"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words FROM t),
win AS (
  SELECT rid, i, words[i] || chr(31) || words[i + 1] || chr(31) || words[i + 2] AS k
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
ln AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^ \t\n\v\f\r]') GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[ \t\n\v\f\r]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^a-z]+', '', 'g'))::BIGINT AS n_lower
  FROM t JOIN w USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 8 * (word_chars < 3 * n_words)::BIGINT + 16 * (word_chars > 12 * n_words)::BIGINT + 32 * (100 * n_symbols > 10 * n_words)::BIGINT
    + 128 * (100 * n_upper > 50 * (n_upper + n_lower))::BIGINT + 256 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""
