"""Spans of regular expressions in texts, as native column expressions.

Spark returns the matches of an expression but not where they stand; the pieces between matches give that. Offsets are
code points. They are summed in chunks, so a text with n matches costs about n times the chunk instead of n squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sealed

_CHUNK = 128
SPAN = "array<struct<start:int,end:int,value:string,part:string>>"
NONE = "array<string>"


def with_spans(df: DataFrame, text_col: str, kinds: dict[str, tuple[str, int, Column | None]]) -> DataFrame:
    """``df`` with a column for each kind: its leftmost non-overlapping matches, an array of (start, end, value, part).

    ``kinds``: name to (expression, capture group that ``part`` holds, condition without which a text has no match).
    The text must not be null and the expressions must not match the empty string. Each step is a column of its own,
    and no function of an array's element refers to a whole array, so nothing is evaluated once per match.
    """
    text, add, zero = F.col(text_col), lambda a, b: a + b, F.lit(0)
    c = lambda step, k: F.col(f"__{step}_{k}")

    def staged(step: str, make) -> DataFrame:
        return df.withColumns({f"__{step}_{k}": make(k, *v) for k, v in kinds.items()})

    def guarded(k: str, value: Column) -> Column:
        return F.when(F.size(c("found", k)) > 0, value)

    df = staged("found", lambda k, rx, part, need: F.when(need if need is not None else F.lit(True), F.regexp_extract_all(text, F.lit(rx), F.lit(0))).otherwise(F.array().cast(NONE)))
    df = df.withColumns({
        **{f"__between_{k}": guarded(k, F.split(text, rx, -1)) for k, (rx, _, _) in kinds.items()},
        **{f"__part_{k}": guarded(k, F.regexp_extract_all(text, F.lit(rx), F.lit(part))) for k, (rx, part, _) in kinds.items() if part},
    })
    df = staged("step", lambda k, *_: guarded(k, F.zip_with(c("found", k), F.slice(c("between", k), F.lit(1), F.size(c("found", k))), lambda v, b: F.length(v) + F.length(b))))
    df = staged("chunk", lambda k, *_: guarded(k, F.transform(F.sequence(zero, F.size(c("step", k)) - 1, F.lit(_CHUNK)), lambda b: F.slice(c("step", k), b + 1, F.lit(_CHUNK)))))

    def ends(k: str, *_) -> Column:
        start = F.struct(zero.alias("sum"), F.array().cast("array<int>").alias("before"))
        before = F.aggregate(
            c("chunk", k), start, lambda acc, x: F.struct((acc["sum"] + F.aggregate(x, zero, add)).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before")), lambda acc: acc["before"]
        )
        return guarded(k, F.flatten(F.zip_with(c("chunk", k), before, lambda x, b: F.transform(x, lambda _, i: b + F.aggregate(F.slice(x, F.lit(1), i + 1), zero, add)))))

    df = staged("end", ends)

    def built(k: str, _, part: int, __) -> Column:
        both = F.zip_with(c("found", k), c("part", k) if part else c("found", k), lambda v, p: F.struct(v.alias("v"), p.alias("p")))
        whole = F.zip_with(both, c("end", k), lambda x, e: F.struct((e - F.length(x["v"])).alias("start"), e.alias("end"), x["v"].alias("value"), x["p"].alias("part")))
        return F.coalesce(guarded(k, whole), F.array().cast(SPAN))

    return sealed(df, {k: built(k, *v) for k, v in kinds.items()}).drop(*(f"__{s}_{k}" for s in ("found", "between", "part", "step", "chunk", "end") for k in kinds))


def tagged(found: Column, *fields) -> Column:
    """The spans as structs of ``fields``: names of a span's fields, or columns that are the same for all."""
    return F.transform(found, lambda x: F.struct(*(x[f].alias(f) if isinstance(f, str) else f for f in fields)))


def joined(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans, by start and then by the order of ``kinds``, joined by commas."""
    keyed = [tagged(s, "start", F.lit(k).alias("kind"), "end") for k, (_, s) in enumerate(kinds)]
    names = F.array(*(F.lit(name) for name, _ in kinds))
    ordered = F.sort_array(F.concat(*keyed))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
