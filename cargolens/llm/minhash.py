"""MinHash near-duplicates with sequential Bayesian verification.

1. One scan turns texts into shingle sets and keeps, per row, the set's size, its 128-bit identity and a signature.
2. Rows with equal sets are one class; only class representatives (smallest id) go on, so copies cost one row each.
3. Signatures are cut into bands. Rows that share a band are candidates. A bucket doesn't emit its pairs: its members
   are compared with one pivot, the one whose buckets are largest, which is the copy with the fewest changes. A bucket
   whose members are in one component then is done. If its pairs across components are few for its size, all of them
   are compared. Else its members are dealt anew by their rarest shingles: two sets can only reach the threshold if
   they share one among the first few, so that texts changed too much for a link stop meeting. Buckets that are
   still dense go on by rounds of randomly chosen pivots. A pivot leaves its bucket after its round, so every pair that
   could change the components is compared in the end: there is no cap.
4. A candidate pair is read batch by batch: after each, if the posterior probability that its similarity reaches
   the threshold (uniform prior) is under ``miss``, it is pruned. Survivors are verified on the full sets, which a
   second scan makes for them only, of digests of the shingles' words instead of the hashes used before.
5. Components of the verified links give the result.

Defined results: texts without words, and null texts, have no shingles and link with nothing; texts with fewer words
than a shingle have one shingle, their whole word sequence. Rows with a null id are returned, with a null component,
kept, and never linked. Rows that repeat an id are one document, linked through any of its texts. An empty table gives
an empty result. Only the id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import compact, cut, read_table, ship, small
from .components import components
from .shingles import exact_shingles, mix, shingle_sets, slices

#: 28 bands of 5: a pair at similarity 0.85 shares none with probability 7e-8, one at 0.8 with 1.5e-5.
BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
#: Hashes compared before each decision, and the posterior probability under which a pair is given up.
BATCH, MISS = 20, 1e-6
#: Pairs across components that a round compares in a bucket, as a multiple of the bucket's rows: by band, by shingle.
ROUND_PAIRS = (8, 64)
#: Ids held in a broadcast when the second scan looks for the survivors' texts (8 bytes each).
SCAN_IDS = 1_000_000
#: Bytes of sets that are joined in one partition; more are dealt out.
SETS_BYTES = 1 << 25

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1 << 62, dtype=np.uint64, size=HASHES) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1 << 63, dtype=np.uint64, size=HASHES)


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES minima, kept to their upper 32 bits; made in pieces, so memory doesn't grow with the text."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(low, (found[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _signed(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, part in slices(pdf["text"].tolist()):
                n, h1, h2, sig = [], [], [], []
                for s in shingle_sets(part, size):
                    n.append(len(s))
                    whole = hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()  # of the whole set, in order
                    h1.append(int.from_bytes(whole[:8], "little", signed=True) if len(s) else 0)
                    h2.append(int.from_bytes(whole[8:], "little", signed=True) if len(s) else 0)
                    sig.append(signature(s).tobytes() if len(s) else b"")
                yield pd.DataFrame({"id": pdf["id"].iloc[first : first + len(part)].to_numpy(), "n": n, "h1": h1, "h2": h2, "sig": sig})

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, part in slices(pdf["text"].tolist()):
                yield pd.DataFrame({"id": pdf["id"].iloc[first : first + len(part)].to_numpy(), "items": [exact_shingles(t, size).tobytes() for t in part]})

    return run


def _tokens(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, part in slices(pdf["text"].tolist()):
                yield pd.DataFrame({"id": pdf["id"].iloc[first : first + len(part)].to_numpy(), "tokens": [s.view(np.int64) for s in shingle_sets(part, size)]})

    return run


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
            for k in range(ROWS):
                key = mix(key * np.uint64(0xA0761D6478BD642F) + sig[:, :, k])
            yield pd.DataFrame({"key": key.ravel().view(np.int64), "id": np.repeat(pdf["id"].to_numpy(), BANDS)})


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each batch end n, the fewest matches at which Pr(similarity >= threshold | matches of n) >= miss.

    With a uniform prior that probability is the chance of at most m successes in n + 1 trials at the threshold.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _plausible(threshold: float, miss: float):
    least = least_matches(threshold, miss)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            alive = np.arange(len(pdf))
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(len(pdf), HASHES) for c in ("sig_u", "sig_v"))
                matches = np.zeros(len(pdf), np.int64)
                for k, need in enumerate(least):
                    cols = slice(k * BATCH, (k + 1) * BATCH)
                    matches[alive] += (a[alive, cols] == b[alive, cols]).sum(axis=1)
                    alive = alive[matches[alive] >= need]
            yield pdf[["u", "v"]].iloc[alive]

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["items_u"], pdf["items_v"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf[["u", "v"]][np.array(keep, bool)]

    return run


def _size_class(n: int) -> int:
    return int(math.log(n) / math.log(1.03))


def _rarest(percent: int):
    """Rows (key, id, side) for each id's first shingles in order of rarity: as many as a partner of a size class may require.

    A pair needs an overlap of at least percent * (a + b) / (100 + percent) of its sizes a and b; then it shares one of
    the first a - overlap + 1 of one and b - overlap + 1 of the other. A key is of a pair of classes; the side says
    whether an id is of the smaller (1) or larger (-1) one; within one class it is 0. Partners' sides add up to 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, tokens in zip(pdf["id"], pdf["tokens"], strict=True):
                tokens = np.asarray(tokens, np.int64).view(np.uint64)
                a, keys = len(tokens), []
                mine = _size_class(a)
                low = {}
                for b in range(-(-percent * a // 100), 100 * a // percent + 1):
                    low.setdefault(_size_class(b), b)
                for other, b in low.items():
                    overlap = -(-percent * (a + b) // (100 + percent))
                    pair = np.uint64(min(mine, other) * 100_003 + max(mine, other))
                    key = mix(tokens[: max(0, a - overlap + 1)] ^ mix(np.array([pair]))).view(np.int64)
                    keys.append(pd.DataFrame({"key": key, "id": [i] * len(key), "side": (other > mine) - (other < mine)}))
                yield pd.concat(keys)

    return run


def _by_rarity(ids: DataFrame, rows: DataFrame, id_type: str, percent: int, size: int) -> DataFrame:
    """Buckets (key, id, side) of the ids by their rarest shingles, those with two or more members."""
    sets = rows.join(small(ids, SCAN_IDS), "id", "left_semi").mapInPandas(_tokens(size), f"id {id_type}, tokens array<long>")
    each = cut(sets.select("id", F.explode("tokens").alias("token")), "minhash-tokens")
    often = cut(each.groupBy("token").agg(F.count("*").alias("n")), "minhash-often")
    ordered = each.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("x"))  # a text's own shingles
    dealt = cut(ordered.select("id", F.transform("x", lambda t: t["token"]).alias("tokens")).mapInPandas(_rarest(percent), f"key long, id {id_type}, side int").distinct(), "minhash-rarest")
    return cut(dealt.join(cut(dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "minhash-shared"), "key", "left_semi"), "minhash-buckets")


def _ends(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """``pairs`` (u, v) with ``column`` of both ends; rows of an id that is repeated give a pair each."""
    left, right = (of.select(F.col("id").alias(x), F.col(column).alias(f"{column}_{x}")) for x in "uv")
    return pairs.join(left, "u").join(right, "v")


def _verified(pairs: DataFrame, rows: DataFrame, reps: DataFrame, id_type: str, percent: int, miss: float, size: int) -> DataFrame:
    """Those of the distinct ``pairs`` (u, v) whose full sets are similar."""
    link = f"u {id_type}, v {id_type}"
    alive = compact(cut(_ends(pairs, reps, "sig").mapInPandas(_plausible(percent / 100, miss), link), "minhash-plausible"))
    ids = cut(alive.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "minhash-ids")
    sets = cut(rows.join(small(ids, SCAN_IDS), "id", "left_semi").mapInPandas(_sets(size), f"id {id_type}, items binary").filter(F.length("items") > 0), "minhash-sets")
    if (sets.agg(F.sum(F.length("items"))).first()[0] or 0) <= SETS_BYTES:
        sets = sets.coalesce(1)
    return compact(cut(_ends(alive, sets, "items").mapInPandas(_confirmed(percent), link).distinct(), "minhash-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5, miss: float = MISS) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links of at least ``percent``), kept: one row per input row."""
    spark, id_type = docs.sparkSession, dict(docs.dtypes)[id_col]
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = cut(rows.mapInPandas(_signed(size), f"id {id_type}, n long, h1 long, h2 long, sig binary"), "minhash-signed")
    usable = signed.filter((F.col("n") > 0) & F.col("id").isNotNull())
    same = ["n", "h1", "h2"]
    classes = cut(usable.groupBy(*same).agg(F.min(F.struct("id", "sig")).alias("x"), F.count("*").alias("members")).select(*same, "x.id", "x.sig", "members"), "minhash-classes")
    reps = classes.select("id", "sig")
    keys = cut(reps.mapInPandas(_banded, f"key long, id {id_type}").distinct(), "minhash-bands")
    # A table of one row per key is written before it is joined: then both sides of the join are plain shuffles, and
    # Spark can split the partition of a key that very many rows have.
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "minhash-shared")
    bucketed = cut(keys.join(shared, "key"), "minhash-buckets")

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs.select(F.greatest("id", "pivot").alias("u"), F.least("id", "pivot").alias("v")).distinct(), rows, reps, id_type, percent, miss, size)

    weight = bucketed.groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = cut(bucketed.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", F.xxhash64("id"))).alias("pivot")), "minhash-hubs")
    left = cut(bucketed.join(hubs, "key").filter("id != pivot").select("key", "id", "pivot", F.lit(0).alias("side")), "minhash-left")
    links = verified(left)
    found, done, banded = components(links), 0, True
    while True:
        done += 1
        # Pivots have met all others; what is left are buckets whose other members aren't in one component yet.
        label = F.coalesce(F.col("component"), F.col("id")).alias("label")
        labelled = left.select("key", "id", "side").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "side", label)
        counts = labelled.groupBy("key", "label").agg(*(F.count_if(F.col("side") == k).alias(c) for c, k in (("same", 0), ("low", 1), ("high", -1))), F.min("id").alias("first"))
        s_, l_, h_ = F.col("same"), F.col("low"), F.col("high")
        cross = (F.sum(s_) * F.sum(s_) - F.sum(s_ * s_)) / 2 + F.sum(l_) * F.sum(h_) - F.sum(l_ * h_)
        open_ = cut(counts.groupBy("key").agg(F.sum(s_ + l_ + h_).alias("n"), cross.alias("cross"), F.min("first").alias("first")).filter("cross > 0"), "minhash-counts")
        left = compact(cut(labelled.join(open_, "key").select("key", "id", "side", "label", "n", "cross", "first"), "minhash-open"))
        if left.isEmpty():
            break
        most = ROUND_PAIRS[not banded]
        few = F.col("cross") <= most * F.col("n")
        heavy = left.filter(~few)
        if banded:
            pivots = left.filter(few)
        else:
            draw = F.pmod(F.xxhash64("key", "id", F.lit(done)), F.lit(1 << 20)) / F.lit(1 << 20)
            pivots = left.filter(few | (draw < F.lit(most) * F.col("n") / F.col("cross")) | (F.col("id") == F.col("first")))
        pivots = pivots.select("key", F.col("id").alias("pivot"), F.col("label").alias("pivot_label"), F.col("side").alias("pivot_side"))
        more = verified(left.join(pivots, "key").filter("label != pivot_label AND side + pivot_side = 0"))
        if not more.isEmpty():
            links = compact(cut(links.union(more), "minhash-links"))
            found = components(links)
        if banded:
            banded = False
            left = _by_rarity(cut(heavy.select("id").distinct(), "minhash-ids"), rows, id_type, percent, size)
        else:
            left = compact(cut(heavy.join(pivots.select("key", F.col("pivot").alias("id")), ["key", "id"], "left_anti").select("key", "id", "side"), "minhash-left"))

    rep = usable.select("id", "n", "h1", "h2").join(classes.filter("members > 1").select(*same, F.col("id").alias("rep")), same)
    # An id's classes are one document: a row that repeats an id links the two.
    copies = rep.select(F.col("id").alias("u"), F.col("rep").alias("v")).filter("u != v")
    found = components(links.union(cut(copies, "minhash-copies")))
    out = signed.select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce(F.col("component"), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest id, with the columns of ``docs``."""
    gone = near_duplicates(docs, id_col, text_col, percent, size).filter("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(small(cut(gone, "minhash-gone"), SCAN_IDS), F.col(id_col) == F.col("__gone"), "left_anti")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


#: All links by comparing every two documents that share a shingle, then the smallest id that each document reaches.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN z x ON x.doc_id = u JOIN z y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM reach r JOIN edges e ON e.u = r.v),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN least ON u = doc_id LEFT JOIN z USING (doc_id)
"""
