"""Linkage of values to page tokens: containment first, a similarity ratio only for what it leaves.

Values and tokens meet through inverted indexes, by document, and never all with all. A text that contains another has
all its letter grams, so the contained one looks for those that have that of its grams which is likely the rarest. Two texts whose ratio reaches a
threshold share so many letters that they have two of them in common among the first ones of each in one fixed order, so
both are indexed by pairs of these; pairs of texts whose lengths or shared letters rule the threshold out are dropped.

The ratio is the one operator here that runs Python. It is taken of each value's most promising token first, then only of
tokens whose shared letters could still beat that. A worker keeps the ratios of pairs it has seen.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..sources.store import kept, shuffled, staged
from .fold import by_key

THRESHOLD, PART_THRESHOLD, ROW_THRESHOLD = 0.60, 0.80, 0.30
_BEST = ["page", "pos", "text", "x1", "y1", "x2", "y2", "confidence"]
#: Pairs whose ratios a worker keeps, and letters of a pair that is worth keeping.
_KEPT, _KEPT_LETTERS = 1_000_000, 80


def rater():
    """A function of two texts: their share in matching blocks, 0 to 1. A worker keeps what it has found."""
    most, short = _KEPT, _KEPT_LETTERS

    def rate(first: str, second: str) -> float:
        import sys
        from difflib import SequenceMatcher

        found: dict = sys.modules.setdefault("_cargolens_ratios", {})  # lives as long as the worker
        r = found.get((first, second))
        if r is None:
            r = SequenceMatcher(None, first, second).ratio()
            if len(first) + len(second) <= short:
                if len(found) >= most:
                    found.clear()
                found[first, second] = r
        return r

    return rate


def ratio(a: Column, b: Column, need: Column | None = None) -> Column:
    """Share of two texts in matching blocks, 0 to 1: one Arrow batch at a time; null where ``need`` is false or a text is null."""
    rate = rater()

    def run(x: pd.Series, y: pd.Series, asked: pd.Series) -> pd.Series:
        rated = (rate(first, second) if want and first is not None and second is not None else None for first, second, want in zip(x, y, asked, strict=True))
        return pd.Series(list(rated), dtype="float64")

    return F.pandas_udf(run, "double")(a, b, F.lit(True) if need is None else F.coalesce(need, F.lit(False)))


def letters(text: Column) -> Column:
    """A bit for each kind of letter in a text."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 63))))


def bound(a: Column, b: Column, letters_a: Column, letters_b: Column) -> Column:
    """The most that the ratio of two texts can be: as many letters match as the shorter has, less one for each kind that the other lacks."""
    x, y = F.length(a) - F.bit_count(letters_a.bitwiseAND(F.bitwise_not(letters_b))), F.length(b) - F.bit_count(letters_b.bitwiseAND(F.bitwise_not(letters_a)))
    return 2 * F.least(x, y) / (F.length(a) + F.length(b))


def may_reach(a: Column, b: Column, threshold: float, letters_a: Column | None = None, letters_b: Column | None = None) -> Column:
    """Whether a ratio of ``threshold`` is possible: it is twice the letters matched over all letters.

    At most the shorter text's letters are matched, less one for each kind of letter that the other text lacks.
    """
    x, y = F.length(a), F.length(b)
    if letters_a is not None and letters_b is not None:
        x, y = x - F.bit_count(letters_a.bitwiseAND(F.bitwise_not(letters_b))), y - F.bit_count(letters_b.bitwiseAND(F.bitwise_not(letters_a)))
    return 2 * F.least(x, y) >= (F.lit(threshold) - 1e-9) * (F.length(a) + F.length(b))


#: Letters of a gram, and pairs of values and tokens of a document up to which each value meets each token.
GRAM, FEW_PAIRS = 5, 4096
#: Letters from rare to common, after all other characters; repeats of a letter come before its first. Any fixed order is right.
_RARE = "zqjxkvbpygfwmucldrhsnioate"


def _rarity(gram: Column) -> Column:
    """A gram's place in a fixed order, rare letters first."""
    letters = F.transform(F.array_remove(F.split(gram, ""), ""), lambda c: F.instr(F.lit(_RARE), c))
    return F.aggregate(letters, F.lit(0), lambda x, y: x + y)


def parted(left: DataFrame, right: DataFrame, keys: list[str], few: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of ``left`` and ``right`` whose key has at most ``few`` pairs in all, then those of the other keys, None if no key has more."""
    few = FEW_PAIRS if few is None else few
    n = left.groupBy(*keys).agg(F.count("*").alias("a")).join(right.groupBy(*keys).agg(F.count("*").alias("b")), keys)
    many = kept(n.filter(F.col("a") * F.col("b") > few).select(*keys), "many-pairs")
    if many.isEmpty():
        return left, right, None, None
    return (*(df.join(many, keys, "left_anti") for df in (left, right)), *(df.join(many, keys, "left_semi") for df in (left, right)))


def contained(needles: DataFrame, hay: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, h, and what else the two tables have: texts ``n`` of ``needles`` (keys, n) in texts ``h`` of ``hay`` (keys, h), both distinct by key.

    Keys with at most FEW_PAIRS pairs search each text, which costs less than its grams; the others take an index.
    """
    needles, hay = needles.filter("n != ''"), hay.filter("h != ''")
    a, b, many_a, many_b = parted(needles, hay, keys)
    found = shuffled(a).join(b, keys).filter(F.contains(F.col("h"), F.col("n")))
    return found if many_a is None else found.unionByName(_whole(_by_gram(many_a, many_b, keys), many_a, many_b, keys))


def _whole(met: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (keys, n, h) with the other columns of their rows, if there are any."""
    for df, c in ((left, "n"), (right, "h")):
        if len(df.columns) > len(keys) + 1:
            met = met.join(df, [*keys, c])
    return met


def _by_gram(needles: DataFrame, hay: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, h: as ``contained``, through an index.

    A needle is looked up by that of its grams of GRAM letters (of all its letters if it has fewer) whose letters are the
    rarest; what has the gram is then searched.
    """
    grams = lambda t, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substring(t, i, k)))
    size = F.least(F.length("n"), F.lit(GRAM))
    own = needles.select(*keys, "n", size.alias("k"), F.array_min(F.transform(grams(F.col("n"), size), lambda g: F.struct(_rarity(g).alias("r"), g.alias("g"))))["g"].alias("gram"))
    asked = own.groupBy(*(F.col(c).alias(f"__{c}") for c in keys)).agg(F.array_sort(F.collect_set("k")).alias("__ks"))  # lengths of grams that a key's needles ask for
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"__{c}"))
    each = F.flatten(F.transform(F.filter("__ks", lambda k: k <= F.length("h")), lambda k: grams(F.col("h"), k)))
    index = hay.join(asked, same).select(*keys, "h", F.explode(each).alias("gram"))
    return own.join(index, [*keys, "gram"]).filter(F.contains(F.col("h"), F.col("n"))).select(*keys, "n", "h")


def _elements(text: Column) -> Column:
    """A text's letters as an array of letter and how many times it came before, in the fixed order."""
    chars = F.array_remove(F.split(text, ""), "")
    place = lambda c: F.format_string("%02d", F.instr(F.lit(_RARE), c))
    times = F.transform(chars, lambda c, i: F.struct(place(c).alias("place"), c.alias("c"), F.size(F.filter(F.slice(chars, 1, i), lambda d: d == c)).alias("k")))
    return F.transform(F.array_sort(F.transform(times, lambda t: F.struct((F.when(t["k"] > 0, 0).otherwise(1)).alias("again"), t["place"].alias("place"), t["c"].alias("c"), t["k"].alias("k")))), lambda t: F.concat_ws(" ", t["c"], t["k"].cast("string")))


def _least_shared(n: Column, threshold: float) -> Column:
    """Letters that a text of n letters must share with one of any length for a ratio of ``threshold``."""
    return F.ceil((threshold / (2 - threshold)) * n - 1e-9)


def _signatures(elements: Column, threshold: float) -> Column:
    """What two texts whose ratio reaches the threshold have one of in common.

    Texts that must share two letters or more share two among the first n - least + 2 of each (n letters): their pairs.
    Texts of so few letters that one is enough are found by single letters, and so are those that one of them may be like.
    """
    n = F.size(elements)
    few = int((2 - threshold) / threshold + 1e-9)  # at most so many letters: one shared letter may be enough
    partner = int(few * (2 - threshold) / threshold + 1e-9)
    first = F.slice(elements, F.lit(1), (n - _least_shared(n, threshold) + 2).cast("int"))
    pairs = F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda b: F.concat_ws("|", a, b))))
    none = F.array().cast("array<string>")
    return F.concat(F.when(n > few, pairs).otherwise(none), F.when(n <= partner, elements).otherwise(none))


def _by_signature(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    sig = lambda df, c: df.filter(F.col(c) != "").select(*keys, c, F.explode(_signatures(_elements(F.col(c)), threshold)).alias("sig"))
    x, y = F.length("n"), F.length("h")
    met = sig(left, "n").join(sig(right, "h"), [*keys, "sig"]).filter(2 * F.least(x, y) >= (threshold - 1e-9) * (x + y)).select(*keys, "n", "h").distinct()
    return met.withColumn("most", 2 * F.size(F.array_intersect(_elements(F.col("n")), _elements(F.col("h")))) / (x + y))


def candidates(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, few: int | None = None) -> DataFrame:
    """keys, n, h, most, and what else the two tables have: pairs of texts (n of ``left``, h of ``right``, distinct by key) whose ratio may reach the threshold, and the most that it can be.

    Keys with at most ``few`` pairs in all take each pair, bounded by kinds of letters; the others, however many texts
    they have, take the signatures that two texts share. Either way loses none.
    """
    a, b, many_a, many_b = parted(left, right, keys, few)
    met = shuffled(a.withColumn("ln", letters(F.col("n")))).join(b.withColumn("lh", letters(F.col("h"))), keys).withColumn("most", bound(F.col("n"), F.col("h"), F.col("ln"), F.col("lh"))).drop("ln", "lh")
    if many_a is not None:
        met = met.unionByName(_whole(_by_signature(many_a, many_b, keys, threshold), many_a, many_b, keys))
    return met.filter(F.col("most") >= threshold - 1e-9)


def _best_ratio(pairs: DataFrame, keys: list[str], first: str) -> DataFrame:
    """keys, n, h, score: of pairs (keys, n, h, most, and ``first``, which breaks ties) all whose ratio is the best of their n."""
    pairs = kept(pairs, "candidates")
    tried = pairs.groupBy(*keys, "n").agg(F.max_by(F.struct("h", first), F.struct("most", -F.col(first))).alias("t")).select(*keys, "n", "t.h", F.col(f"t.{first}").alias(first))
    tried = kept(tried.withColumn("score", ratio(F.col("n"), F.col("h"))), "tried")
    left = pairs.join(tried.select(*keys, "n", F.col("h").alias("t_h"), F.col("score").alias("t_score")), [*keys, "n"]).filter((F.col("most") >= F.col("t_score") - 1e-9) & (F.col("h") != F.col("t_h")))
    return tried.unionByName(left.select(*keys, "n", "h", first).withColumn("score", ratio(F.col("n"), F.col("h"))).select(*tried.columns))


def _texts(tokens: DataFrame) -> DataFrame:
    """document_id, h, pos: the distinct texts of each document; of equal tokens only the first can be a value's best."""
    return tokens.select("document_id", F.lower(F.trim("text")).alias("h"), "pos").filter("h != ''").groupBy("document_id", "h").agg(F.min("pos").alias("pos"))


def _placed(v: DataFrame, found: DataFrame, tokens: DataFrame, best: list[str]) -> DataFrame:
    """document_id, value, ``best``, score of values (document_id, value, n) with their token of ``found`` (document_id, n, pos, score); nulls if there is none."""
    at = tokens.select(F.col("document_id").alias("t_document"), F.col("pos").alias("t_pos"), *best)
    found = v.join(found.withColumnRenamed("pos", "at"), ["document_id", "n"], "left")
    return found.join(at, (F.col("document_id") == F.col("t_document")) & (F.col("at") == F.col("t_pos")), "left").select("document_id", "value", *best, "score")


#: Letters of texts times values of a document from which texts are looked up by their grams.
_LONG = 500_000_000


def finder(texts: list[str], n_values: int):
    """A function of a value: the place of the first of ``texts`` that holds it, None if none does. Long lists of texts and values take an index of grams."""
    from bisect import bisect_right
    from itertools import accumulate

    whole = "\0".join(texts)
    begins = list(accumulate((len(t) + 1 for t in texts), initial=0))
    index: dict[str, list[int]] = {}
    if len(whole) * n_values > _LONG:
        for i, t in enumerate(texts):
            for g in {t[k : k + 3] for k in range(len(t) - 2)}:
                index.setdefault(g, []).append(i)

    def find(value: str) -> int | None:
        if index and len(value) > 2:
            rarest = min((index.get(value[k : k + 3], []) for k in range(len(value) - 2)), key=len)
            return next((i for i in rarest if value in texts[i]), None)
        if "\0" in value:
            return next((i for i, t in enumerate(texts) if value in t), None)
        at = whole.find(value)
        return bisect_right(begins, at) - 1 if at >= 0 else None

    return find


def part_of(value: str, at: dict[str, int]) -> int | None:
    """The least of ``at``, the places of texts, of those of four letters or more within the value."""
    n = len(value)
    if n * n < len(at):
        found = [at[value[i:j]] for i in range(n - 3) for j in range(i + 4, n + 1) if value[i:j] in at]
    else:
        found = [k for t, k in at.items() if len(t) > 3 and t in value]
    return min(found, default=None)


def _asked(tokens: DataFrame, best: list[str], value: Column, asked: Column) -> DataFrame:
    """Rows for ``_held`` of tokens that ask for a ``value`` each, where ``asked``."""
    return tokens.select("document_id", asked.alias("__asked"), value.alias("value"), F.lower(F.trim(value)).alias("__needle"), F.when(F.col("document_id").isNotNull(), F.lower(F.trim("text"))).alias("__hay"), *dict.fromkeys(["pos", *best]))


def _together(values: DataFrame, tokens: DataFrame, best: list[str]) -> DataFrame:
    """Rows for ``_held`` of values (document_id, value) and of the tokens that they are looked up in."""
    asked = values.select("document_id", F.lit(True).alias("__asked"), "value", F.lower(F.trim("value")).alias("__needle"))
    return _asked(tokens, best, F.lit(None).cast("string"), F.lit(False)).unionByName(asked, allowMissingColumns=True)


def _held(rows: DataFrame, best: list[str]) -> DataFrame:
    """document_id, value, ``best``, score: every value asked for, once, with the first of its document's tokens that holds it (1.0), else the first of four letters or more within it (0.85), else nulls.

    Documents are folded in Arrow batches where their rows lie: nothing but the rows is moved, and no pairs are made.
    """
    best = list(dict.fromkeys(["pos", *best]))
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField("document_id", types["document_id"]), StructField("value", StringType()), *(StructField(c, types[c]) for c in best), StructField("score", DoubleType())])

    def fold(t):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        t = t.combine_chunks()
        col = lambda c: t.column(c).combine_chunks()
        doc, n = col("document_id"), t.num_rows
        same = pc.or_(pc.fill_null(pc.equal(doc[1:], doc[:-1]), False), pc.and_(pc.is_null(doc[1:]), pc.is_null(doc[:-1])))
        starts = [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        pos, asked, value, needle, hay = (col(c).to_pylist() for c in ("pos", "__asked", "value", "__needle", "__hay"))
        asker, token, score = [], [], []
        for begin, end in zip(starts, starts[1:], strict=False):
            first: dict = {}  # distinct texts in order, with their first row
            for i in sorted((i for i in range(begin, end) if hay[i] and pos[i] is not None), key=pos.__getitem__):
                first.setdefault(hay[i], i)
            wanted: dict = {}
            for i in range(begin, end):
                if asked[i]:
                    wanted.setdefault(value[i], i)
            texts = list(first)
            find, at, known = finder(texts, len(wanted)), {x: k for k, x in enumerate(texts)}, {}
            for i in wanted.values():
                x = needle[i]
                if x not in known:
                    k, s = find(x) if x else None, 1.0
                    if k is None and x:
                        k, s = part_of(x, at), 0.85
                    known[x] = (None, None) if k is None else (first[texts[k]], s)
                asker.append(i)
                token.append(known[x][0])
                score.append(known[x][1])
        asker, token = pa.array(asker, pa.int64()), pa.array(token, pa.int64())
        out = to_arrow_schema(schema)
        arrays = [doc.take(asker), col("value").take(asker), *(col(c).take(token) for c in best), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, out, strict=True)], schema=out)

    return by_key(rows, ["document_id"], fold, schema)


def link_contained(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """Values (document_id, value) to their best token: one that holds the value 1.0, one of four letters or more within the value 0.85; first in order.

    ``pos`` is a token's number in its document.
    """
    return _held(_together(values, tokens, _BEST), _BEST).filter("score IS NOT NULL").select("document_id", "value", *_BEST, "score")


def link_own(tokens: DataFrame, value: Column, asked: Column, best: list[str]) -> DataFrame:
    """``link_contained`` of values that the tokens themselves ask for, where ``asked``: document_id, value, ``best``, score."""
    return _held(_asked(tokens, best, value, asked), best).filter("score IS NOT NULL").select("document_id", "value", *best, "score")


def _linked(rows: DataFrame, tokens: DataFrame, threshold: float, best: list[str]) -> DataFrame:
    """document_id, value, ``best``, score: every value asked for in ``rows``, once, with its best token; nulls if it has none."""
    keys, columns = ["document_id"], ["document_id", "value", *best, "score"]
    held = kept(_held(rows, best), "held")
    n = F.lower(F.trim("value"))
    rest = held.filter("score IS NULL OR score < 1").withColumn("n", n)
    if rest.filter("n != ''").isEmpty():
        return held.select(*columns)
    needles = kept(rest.filter("n != ''").select("document_id", "n").distinct(), "rest")
    like = candidates(needles, kept(_texts(tokens.join(needles.select("document_id").distinct(), keys, "left_semi")), "texts"), keys, threshold)
    like = like.filter(~((F.length("h") > 3) & F.contains("n", F.col("h"))))  # a part has its score
    rated = rest.filter("score IS NOT NULL").select("document_id", "n", "pos", "score").unionByName(_best_ratio(like, keys, "pos").select("document_id", "n", "pos", "score"))
    found = rated.filter(F.col("score") >= threshold).groupBy("document_id", "n").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("b")).select("document_id", "n", (-F.col("b.back")).alias("pos"), F.col("b.score").alias("score"))
    return held.filter("score = 1").select(*columns).unionByName(_placed(rest.select("document_id", "value", "n"), found, tokens, best).select(*columns))


def link(values: DataFrame, tokens: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each value with its best token, ties to the first in order. ``pos`` is a token's number in its document."""
    return _linked(_together(values, tokens, _BEST), tokens, threshold, _BEST).filter("score IS NOT NULL")


def kinds_of():
    """A function of a text: a bit for each kind of letter in it. A worker keeps what it has found."""
    most = _KEPT

    def kinds(text: str) -> int:
        import sys

        found: dict = sys.modules.setdefault("_cargolens_kinds", {})
        m = found.get(text)
        if m is None:
            m = 0
            for c in set(text):
                m |= 1 << (ord(c) % 63)
            if len(found) >= most:
                found.clear()
            found[text] = m
        return m

    return kinds


def best_of(texts: list[str | None], n_values: int, rate: Callable[[str, str], float], kinds: Callable[[str], int]) -> Callable[[str, float], tuple[int, float]]:
    """A function of a text and a threshold: the place of the best of ``texts`` (all trimmed, lower case) and its score, -1 and 0 if none reaches it.

    One that holds the text 1.0, one of four letters or more within it 0.85, else the ratio; ties to the first. The
    ratio is taken of the most promising texts first, then only of those that could beat what is found.
    """
    first: dict = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(t, i)
    distinct, places = list(first), list(first.values())
    find, at = finder(distinct, n_values), {t: k for k, t in enumerate(distinct)}
    long = [(t, k) for t, k in at.items() if len(t) > 3]
    all_kinds = [(k, len(t), kinds(t)) for t, k in at.items()]

    def best(x: str, threshold: float) -> tuple[int, float]:
        if not x:
            return -1, 0.0
        k = find(x)
        if k is not None:
            return places[k], 1.0
        n, least, score = len(x), threshold, None
        if n * n < len(long):
            k = part_of(x, at)
        else:
            for t, j in long:
                if t in x:
                    k = j
                    break
        if k is not None:
            if threshold > 0.85:
                k = None
            else:
                least = score = 0.85
        own, may, half = kinds(x), [], least / 2 - 1e-9
        for i, m, other in all_kinds:
            need = half * (n + m)
            if n >= need and m >= need and (a := n - (own & ~other).bit_count()) >= need and (b := m - (other & ~own).bit_count()) >= need:
                may.append((-(a if a < b else b) / (n + m), i))
        may.sort()
        for most, i in may:
            if -2 * most < least - 1e-9:
                break
            t = distinct[i]
            if len(t) > 3 and t in x:  # a part has its score
                continue
            r = rate(x, t)
            if r > least or (r == least and (k is None or i < k)):
                k, score, least = i, r, r
        return (-1, 0.0) if k is None else (places[k], score)

    return best


def best_tokens(values: Column, texts: Column, threshold: float = THRESHOLD) -> Column:
    """Array of place and score (struct of at, score; nulls if it has none) of each value's best text.

    ``values`` and ``texts`` are arrays of a document's texts, trimmed and lower case.
    """
    rate, kinds = rater(), kinds_of()

    def run(wanted: pa.Array, of: pa.Array) -> pa.Array:
        import pyarrow as pa

        ends, found = [0], []
        for xs, ts in zip(texts_of(wanted), texts_of(of), strict=True):
            best = best_of(ts, len(xs), rate, kinds)
            found += [best(x, threshold) for x in xs]
            ends.append(len(found))
        at, score = zip(*found, strict=True) if found else ((), ())
        none = pa.array([k < 0 for k in at], pa.bool_())
        each = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(score, pa.float64())], names=["at", "score"], mask=none)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    return F.arrow_udf(run, "array<struct<at:int,score:double>>")(values, texts)


def token_parts(values: Column, texts: Column) -> Column:
    """Array of the places of the texts that each value lies in: the one that is like the whole value, else those of its words of two letters or more."""
    rate, kinds, whole, part = rater(), kinds_of(), THRESHOLD, PART_THRESHOLD

    def run(wanted: pa.Array, of: pa.Array) -> pa.Array:
        import re

        import pyarrow as pa

        ends, parts, found = [0], [0], []
        for xs, ts in zip(texts_of(wanted), texts_of(of), strict=True):
            best = best_of(ts, len(xs), rate, kinds)
            for x in xs:
                at = best(x, whole)[0]
                if at >= 0:
                    found.append(at)
                else:
                    words = {best(w, part)[0] for w in re.split(r"[ \t\n\x0b\f\r]+", x or "") if len(w) > 1}
                    found += sorted(k for k in words if k >= 0)
                parts.append(len(found))
            ends.append(len(parts) - 1)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.ListArray.from_arrays(pa.array(parts, pa.int32()), pa.array(found, pa.int32())))

    return F.arrow_udf(run, "array<array<int>>")(values, texts)


def texts_of(lists: pa.Array) -> list[list]:
    """The texts of each list of an Arrow array; none for null."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).tolist(), lists.value_lengths().fill_null(0).to_pylist()
    out, at = [], 0
    for n in sizes:
        out.append(flat[at : at + n])
        at += n
    return out


def plain_texts(tokens: Column) -> Column:
    """The texts of an array of tokens, trimmed and lower case; null where a token has no place."""
    return F.transform(tokens, lambda t: F.when(t["pos"].isNotNull(), F.lower(F.trim(t["text"]))))


def _searched(docs: DataFrame, values: Column) -> DataFrame:
    """document_id, tokens in order, texts, values: the distinct ones, and needles."""
    docs = staged(docs.select("document_id", F.sort_array(F.transform("tokens", lambda t: F.struct(t["pos"].alias("pos"), t["page"].alias("page"), *(t[c].alias(c) for c in ("text", "x1", "y1", "x2", "y2", "confidence"))))).alias("tokens"), F.array_distinct(values).alias("values")), texts=plain_texts(F.col("tokens")), needles=F.transform("values", lambda v: F.lower(F.trim(v))))
    return docs


def link_within(docs: DataFrame, values: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``link`` of documents that are one row each (document_id, tokens: array of page, pos, text, box, confidence; ``values``: array of texts): nothing is moved."""
    found = _searched(docs, values).withColumn("found", best_tokens(F.col("needles"), F.col("texts"), threshold))
    each = F.transform("values", lambda v, i: F.struct(v.alias("value"), F.get("found", i)["score"].alias("score"), F.get("tokens", F.get("found", i)["at"]).alias("t")))
    return found.select("document_id", F.inline(F.filter(each, lambda x: x["score"].isNotNull()))).select("document_id", "value", *(F.col(f"t.{c}") for c in _BEST), "score")


def link_parts_within(docs: DataFrame, values: Column) -> DataFrame:
    """``link_parts`` of documents that are one row each, as for ``link_within``."""
    found = _searched(docs, values).withColumn("found", token_parts(F.col("needles"), F.col("texts")))
    each = F.transform("values", lambda v, i: F.struct(v.alias("value"), F.transform(F.get("found", i), lambda k: F.get("tokens", k)).alias("at")))
    found = found.select("document_id", F.inline(F.filter(each, lambda x: F.size(x["at"]) > 0)))
    of = lambda c: F.transform("at", lambda t: t[c])
    least, most = ["page", "x1", "y1"], ["x2", "y2"]
    return found.select("document_id", "value", *(F.array_min(of(c)).alias(c) for c in least), *(F.array_max(of(c)).alias(c) for c in most), F.array_min(of("confidence")).alias("confidence"), F.size("at").cast("long").alias("n_tokens"))


def link_parts(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """Values to the box and confidence of the token that is like the whole value, else to the union of the boxes of their words' tokens and the least confidence.

    Words of one letter don't count.
    """
    values = values.select("document_id", "value").distinct()
    whole = kept(link(values, tokens), "whole")  # used for what it places and for what it leaves
    one = whole.select("document_id", "value", "page", "x1", "y1", "x2", "y2", "confidence", F.lit(1).cast("long").alias("n_tokens"))
    left = values.join(whole.select("document_id", "value"), ["document_id", "value"], "left_anti")
    if left.isEmpty():
        return one
    words = left.select("document_id", F.col("value").alias("whole"), F.explode(F.split(F.trim("value"), r"\s+")).alias("value")).filter(F.length("value") >= 2).distinct()
    found = words.join(link(words, tokens, PART_THRESHOLD), ["document_id", "value"])
    parts = found.groupBy("document_id", F.col("whole").alias("value")).agg(
        F.min("page").alias("page"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.min("confidence").alias("confidence"), F.countDistinct("pos").alias("n_tokens")
    )
    return one.unionByName(parts)


def value_pages(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """document_id, value, page: the page of the value's best token, 1 if it has none."""
    return _pages(_together(values, tokens, ["page"]), tokens)


def own_pages(tokens: DataFrame) -> DataFrame:
    """``value_pages`` of the tokens' own texts."""
    return _pages(_asked(tokens, ["page"], F.col("text"), F.lit(True)), tokens)


def _pages(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    return _linked(rows, tokens, THRESHOLD, ["page"]).select("document_id", "value", F.coalesce("page", F.lit(1)).alias("page"))


def row_boxes(items: DataFrame, tokens: DataFrame, width: int = 595, few: int = 1_000_000) -> DataFrame:
    """Goods rows (document_id, page, description) to their page's best token, ties to the first: its pos, score and box over the full width.

    The score is the larger of the share of the description's words over four letters that the token contains, and the
    ratio of its first 40 letters to the token. Only the first of a page's equal tokens can be the best.

    Pages are folded in Arrow batches, those with more than ``few`` pairs by joins.
    """
    keys = ["document_id", "page"]
    a, b, many_a, many_b = parted(items, tokens, keys, few)
    out = _rows_held(_page_rows(b).unionByName(a.select(*keys, "description"), allowMissingColumns=True))
    if many_a is not None:
        out = out.unionByName(_row_boxes_large(many_a, many_b).select(*out.columns))
    return _boxed(out, width)


def own_row_boxes(tokens: DataFrame, description: Column, width: int = 595) -> DataFrame:
    """``row_boxes`` of the descriptions that the tokens themselves ask for, where they aren't null. A page is folded as one."""
    return _boxed(_rows_held(_page_rows(tokens, description)), width)


def _boxed(out: DataFrame, width: int) -> DataFrame:
    return out.select("document_id", "page", "description", "pos", "score", F.lit(0).alias("x1"), "y1", F.lit(width).alias("x2"), (F.col("y2") + 5).alias("y2"))


def _page_rows(tokens: DataFrame, description: Column | None = None) -> DataFrame:
    described = F.lit(None).cast("string") if description is None else description
    return tokens.select("document_id", "page", described.alias("description"), F.lower(F.trim("text")).alias("__hay"), "pos", "y1", "y2")


def _rows_held(rows: DataFrame) -> DataFrame:
    """document_id, page, description, pos, score, y1, y2: the best token of its page of every description, where one reaches ROW_THRESHOLD."""
    keys, columns, least, rate = ["document_id", "page"], ["pos", "y1", "y2"], ROW_THRESHOLD, rater()
    rows = rows.filter("document_id IS NOT NULL AND page IS NOT NULL").withColumn("__whole", F.lower(F.trim("description")))
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([*(StructField(c, types[c]) for c in [*keys, "description", *columns]), StructField("score", DoubleType())])

    def fold(t):
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        t = t.combine_chunks()
        col = lambda c: t.column(c).combine_chunks()
        other = np.logical_or.reduce([pc.not_equal(col(k)[1:], col(k)[:-1]).to_numpy(zero_copy_only=False) for k in keys])
        starts = [0, *(np.flatnonzero(other) + 1).tolist(), t.num_rows]
        pos, description, whole, hay = (col(c).to_pylist() for c in ("pos", "description", "__whole", "__hay"))
        item, token, scores = [], [], []
        for begin, end in zip(starts, starts[1:], strict=False):
            wanted = {description[i]: i for i in range(begin, end) if whole[i]}
            first: dict = {}
            for i in sorted((i for i in range(begin, end) if hay[i] and pos[i] is not None), key=pos.__getitem__) if wanted else ():
                first.setdefault(hay[i], i)
            for i in wanted.values():
                text, n = whole[i][:40], [w for w in re.split(r"\s+", whole[i], flags=re.ASCII) if len(w) > 4]
                best, at = 0.0, None
                for h, k in first.items():
                    share = sum(w in h for w in n) / len(n) if n else 0.0
                    if share > best:
                        best, at = share, k
                for h, k in first.items():  # the ratio only where it may be higher, or as high and earlier
                    most = 2.0 * min(len(text), len(h)) / (len(text) + len(h))
                    if most > best or (most == best and at is not None and k != at and pos[k] < pos[at]):
                        r = rate(text, h)
                        if r > best or (r == best and at is not None and pos[k] < pos[at]):
                            best, at = r, k
                if at is not None and best >= least:
                    item.append(i)
                    token.append(at)
                    scores.append(best)
        item, token, out = pa.array(item, pa.int64()), pa.array(token, pa.int64()), to_arrow_schema(schema)
        arrays = [*(col(c).take(item) for c in [*keys, "description"]), *(col(c).take(token) for c in columns), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, out, strict=True)], schema=out)

    return by_key(rows, keys, fold, schema)


def _row_boxes_large(items: DataFrame, tokens: DataFrame) -> DataFrame:
    """``_rows_held`` of pages with very many pairs."""
    keys = ["document_id", "page"]
    d = kept(items.select(*keys, "description", F.lower(F.trim("description")).alias("whole")).filter("whole != ''").distinct().withColumn("n", F.substring("whole", 1, 40)), "descriptions")
    t = tokens.select(*keys, "y1", "y2", "pos", F.lower(F.trim("text")).alias("h")).filter("h != ''").groupBy(*keys, "h").agg(F.min_by(F.struct("pos", "y1", "y2"), "pos").alias("first"))
    t = kept(t.select(*keys, "h", "first.*"), "tokens")
    long = d.select(*keys, "whole", F.explode(F.filter(F.split("whole", r"\s+"), lambda w: F.length(w) > 4)).alias("n"))
    held = contained(long.select(*keys, "n").distinct(), t.select(*keys, "h"), keys)
    n_long = long.groupBy(*keys, "whole").agg(F.count("*").alias("n_long"))
    hits = long.join(held, [*keys, "n"]).groupBy(*keys, "whole", "h").agg(F.count("*").alias("hits")).join(n_long, [*keys, "whole"])
    hits = d.join(hits, [*keys, "whole"]).join(t, [*keys, "h"]).select(*keys, "description", "pos", "y1", "y2", (F.col("hits") / F.col("n_long")).alias("score"))
    like = candidates(d.select(*keys, "n").distinct(), t.select(*keys, "h", "pos"), keys, ROW_THRESHOLD)
    like = d.join(_best_ratio(like, keys, "pos").select(*keys, "n", "h", "score"), [*keys, "n"]).join(t, [*keys, "h"]).select(*keys, "description", "pos", "y1", "y2", "score")
    best = hits.unionByName(like).filter(F.col("score") >= ROW_THRESHOLD).groupBy(*keys, "description").agg(F.max_by(F.struct("pos", "score", "y1", "y2"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select(*keys, "description", "b.*")
