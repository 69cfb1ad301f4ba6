"""Language-model scores from a weighted backoff automaton.

Counts cover every training text. An n-gram model of the whole corpus is too large to broadcast, so the model goes to
the texts: rows form blocks, bounded in characters, and each block asks for the n-grams that occur in it. Requests are dealt by n-gram hash
into buckets, which add up the training counts of all blocks and answer each block; an n-gram that is in every
text costs one entry per block, so frequent words can't load a bucket. A block then holds the part of the model that
its texts can touch, builds its automaton and scores its texts.

The automaton: each context (up to ``order`` - 1 words) with a training count is a state. An n-gram seen in training
is an arc from its context's state to that of its longest suffix that is a context, weighted with its smoothed
log-probability; a failure arc leads to the state of the context without its first word, weighted with what smoothing
leaves to shorter contexts. Texts of a block are traversed together, left to right, each carrying its state.

Smoothing: P(w | h) = (c(h w) + strength * P(w | h')) / (c(h) + strength), h' being h without its first word; at the
end P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). Probabilities of a context's words and the unknown word sum to 1.

Defined results: a null or empty text is its end token alone. Null ids train and count as the empty text's checksum.
Repeated rows each train and are each scored. Without training texts all counts are 0. An empty table gives no rows.
Only id and text are read, so other columns can't clash. Blocks are row ranges of the input's partitions, so the input
must be a table or other source that is read in the same order each time; a block that changed between the passes
stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, cut, read_table, ship
from .shingles import mix, word_hashes

ORDER, STRENGTH = 2, 30.0
#: Characters of a text and, as a power of two, the rows of a block of texts up to that size. Longer texts are blocks.
BLOCKS = ((1 << 15, 9), (1 << 20, 4))
#: Rows of the input for each bucket.
BUCKET_ROWS = 2000
#: Words of a text that are traversed in step with other parts of the same length.
STRETCH = 256
START, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each led by START and followed by END, and the index of each START."""
    found, n = word_hashes([b"" if t is None else t.encode("utf-8", "replace") for t in texts])
    starts = np.cumsum(n + 2) - (n + 2)
    out = np.empty(int(n.sum()) + 2 * len(n), np.uint64)
    inside = np.ones(len(out), bool)
    inside[starts] = inside[starts + n + 1] = False
    out[inside], out[starts], out[starts + n + 1] = found, START, END
    return out, starts


def grams(words: np.ndarray, starts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 to ``order``: the positions at which a k-gram of one text ends, and the k-gram's hash."""
    at = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
    out, h = [], mix(words)
    for k in range(1, order + 1):
        if k > 1:
            h = mix(np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * np.uint64(0xA0761D6478BD642F) + words + np.uint64(k))
        where = np.flatnonzero(at >= k - 1)
        out.append((where, h[where]))
    return out


def _checksum(words: np.ndarray) -> int:
    return int(words.sum(dtype=np.uint64).astype(np.int64))


def _buckets(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that ascending hashes lie in, and where each one's begin. Its cost is the hashes', not the buckets'."""
    # The upper 32 bits times the number of buckets, over 2^32: ranges of hashes of equal width.
    of = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return of[first], first


def _requests(order: int, buckets: int):
    def one(block: int, pdf: pd.DataFrame) -> pd.DataFrame:
        words, starts = tokens(pdf["text"].tolist())
        trains = np.repeat(pdf["train"].to_numpy(bool), np.diff(np.append(starts, len(words))))
        rows, checksum = [], _checksum(words)
        for level, (where, hashes) in enumerate(grams(words, starts, order), 1):
            found, inverse = np.unique(hashes, return_inverse=True)
            counts = np.bincount(inverse, trains[where], len(found)).astype("<u4")
            of, first = _buckets(found, buckets)
            for b, x, c in zip(of.tolist(), np.split(found, first[1:]), np.split(counts, first[1:]), strict=True):
                rows.append((level * buckets + b, block, checksum, x.tobytes(), c.tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "block", "checksum", "grams", "counts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, list[pd.DataFrame]]] = {}  # the open block of each size of texts
        for pdf in batches:
            for block, part in pdf.groupby("block", sort=False):
                kind = block % (len(BLOCKS) + 1)
                if kind in held and held[kind][0] != block:
                    yield one(held[kind][0], pd.concat(held.pop(kind)[1]))
                held.setdefault(kind, (block, []))[1].append(part)
        for block, parts in held.values():
            yield one(block, pd.concat(parts))

    return run


def _answers(buckets: int):
    start = int(mix(np.array([START]))[0])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        asked = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
        found, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]), len(found)).astype("<i8")
        words = np.where(found == np.uint64(start), 0, totals) if pdf["bucket"].iloc[0] < 2 * buckets else np.zeros(0, np.int64)
        back = np.split(totals[inverse], np.cumsum([len(x) for x in asked])[:-1])
        out = pdf[["block", "bucket", "checksum"]].assign(totals=[x.astype("<u4").tobytes() if x.max() < 1 << 32 else x.tobytes() for x in back], n=0, v=0)
        out.iloc[0, out.columns.get_loc("n")], out.iloc[0, out.columns.get_loc("v")] = int(words.sum()), int((words > 0).sum())
        return out

    return run


class Automaton:
    """States, arcs and failure arcs of a block; ``levels`` is what ``grams`` gave, ``totals`` the training counts of its distinct hashes."""

    def __init__(self, size: int, levels: list, totals: list[np.ndarray], norm: float, strength: float):
        order = len(levels)
        self.word = np.full(size, -1, np.int64)
        self.state_at = np.zeros(size, np.int64)  # state of the longest context that ends at a position
        context = np.zeros(size, np.int64)  # state of the k-gram that ends at a position, 0 (the root) if it is none
        fail, back, prob, arcs = [np.zeros(1, np.int64)], [np.zeros(1)], None, []
        count_of = [np.zeros(1)]
        first_state = 1
        shorter = np.zeros(size)  # probability of the word at a position given the shorter context
        self.base = np.zeros(size)
        self.known = np.zeros(size, bool)
        for k, ((where, hashes), total) in enumerate(zip(levels, totals, strict=True), 1):
            found, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            at = where[first]  # a position where each k-gram ends
            if k == 1:
                self.word[where] = inverse
                self.known[where] = total[inverse] > 0
                prob = (total + 0.1) / norm
                self.base[where] = np.log10(prob)[inverse]
                arc = [np.zeros(len(found), np.int64), np.arange(len(found)), np.log10(prob)]
            else:
                source = context[at - 1]
                held = np.concatenate(count_of)[source]
                usable = (total > 0) & (source > 0)
                prob = np.where(source > 0, (total + strength * shorter[at]) / (held + strength), shorter[at])
                arc = [source[usable], self.word[at[usable]], np.log10(prob[usable])]
            shorter_now = prob
            if k < order:
                # The shorter context's state is this one's failure state; weights follow from the counts.
                new = total > 0
                ids = np.where(new, first_state + np.cumsum(new) - 1, 0)
                fail.append((context[at] if k > 1 else np.zeros(len(at), np.int64))[new])
                count_of.append(total[new].astype(float))
                back.append(np.log10(strength / (total[new] + strength)))
                arc.append(ids if k == 1 else ids[usable])
                longer = np.zeros(size, np.int64)
                longer[where] = ids[inverse]
                self.state_at = np.where(longer > 0, longer, self.state_at)
                context = longer
                first_state += int(new.sum())
            else:
                arc.append(context[at] if k == 1 else context[at[usable]])
            arcs.append(arc)
            # The next level needs this level's probability of the word that ends there.
            shorter = np.zeros(size)
            shorter[where] = shorter_now[inverse]
        self.fail, self.back = np.concatenate(fail), np.concatenate(back)
        source, word, weight, target = (np.concatenate(x) for x in zip(*arcs, strict=True))
        self.width = int(self.word.max(initial=0)) + 1
        keys = source * self.width + word
        by = np.argsort(keys, kind="stable")
        self.keys, self.weight, self.target = keys[by], weight[by], target[by]

    def traverse(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probability of each text: one pass over its words after START.

        A text's stretches go in step with those of all texts. The state at a stretch's beginning is that of the longest
        context that ends there, which is the one that the stretch before it leaves behind.
        """
        parts = -(-lengths // STRETCH)
        text = np.repeat(np.arange(len(starts)), parts)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
        size = np.minimum(lengths[text] - offset, STRETCH)
        order = np.argsort(-size, kind="stable")
        at, left = (starts[text] + offset)[order], size[order]
        score, state, alive = np.zeros(len(at)), self.state_at[at], len(at)
        for step in range(1, int(left.max(initial=0)) + 1):
            alive = int(np.searchsorted(-left[:alive], -step, "right"))
            word, now, rest = self.word[at[:alive] + step], state[:alive].copy(), np.arange(alive)
            while len(rest):
                key = now[rest] * self.width + word[rest]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[arc] == key
                took, lost = rest[hit], rest[~hit]
                score[took] += self.weight[arc[hit]]
                now[took] = self.target[arc[hit]]
                score[lost] += self.back[now[lost]]
                now[lost] = self.fail[now[lost]]
                rest = lost
            state[:alive] = now
        if not np.array_equal(state, self.state_at[at + left]):
            raise AssertionError("a stretch ended in another state than the next one begins with")
        return np.bincount(text[order], score, len(starts))


def _scored(order: int, buckets: int, norm: float, strength: float):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("place", kind="stable")
        words, starts = tokens(docs["text"].tolist())
        if set(answers["checksum"]) != {_checksum(words)}:
            raise RuntimeError("the input's rows came in another order than before; write it to a table first")
        levels, totals = grams(words, starts, order), []
        answers = answers.sort_values("bucket")
        for level, (_, hashes) in enumerate(levels, 1):
            mine = answers[(answers["bucket"] >= level * buckets) & (answers["bucket"] < (level + 1) * buckets)]
            asked = np.unique(hashes)
            of, first = _buckets(asked, buckets)
            if (mine["bucket"].to_numpy() - level * buckets).tolist() != of.tolist():
                raise RuntimeError("a bucket didn't answer")
            sizes = np.diff(np.append(first, len(asked))).tolist()
            totals.append(np.concatenate([np.frombuffer(x, "<u4" if len(x) == 4 * n else "<i8").astype(np.float64) for n, x in zip(sizes, mine["totals"], strict=True)]))
        lengths = np.diff(np.append(starts, len(words))) - 1
        model = Automaton(len(words), levels, totals, norm, strength)
        model.base[starts] = 0
        model.known[starts] = False
        return pd.DataFrame(
            {
                "id": docs["id"].to_numpy(),
                "held_out": ~docs["train"].to_numpy(bool),
                "n_tokens": lengths,
                "n_known": np.add.reduceat(model.known.astype(np.int64), starts),
                "base_score": np.add.reduceat(model.base, starts),
                "score": model.traverse(starts, lengths),
            }
        )

    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; ``train`` says which rows the counts come from."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    kinds, block = len(BLOCKS) + 1, F.col("place") * (len(BLOCKS) + 1)
    for k, (chars, bits) in reversed(list(enumerate(BLOCKS, 1))):
        block = F.when(F.length(F.coalesce("text", F.lit(""))) <= chars, F.shiftright("place", bits) * kinds + k).otherwise(block)
    rows = rows.withColumn("block", block)
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    asked = rows.select("block", "train", "text").mapInPandas(_requests(order, buckets), "bucket long, block long, checksum long, grams binary, counts binary")
    answers = cut(asked.groupBy("bucket").applyInPandas(_answers(buckets), "block long, bucket long, checksum long, totals binary, n long, v long"), "lm-answers")
    total = answers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    norm = total["n"] + 0.1 * (total["v"] + 1)
    out = rows.groupBy("block").cogroup(answers.select("block", "bucket", "checksum", "totals").groupBy("block"))
    scored = out.applyInPandas(_scored(order, buckets, norm, strength), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 10) != 0)
