"""Text quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's evidence is its own shape (capitals, symbols, repeated words, ...) and that of the
lines before and after it; transitions tie neighbouring labels. Forward and backward passes give each line's marginal
probability of being good, and a text's score is their mean weighted with line lengths.

Only whole texts have labels, so a training text's lines all carry its label, and each text counts alike. The model is
fitted on at most ``sample`` labelled texts, drawn by hash of their ids; it is a few dozen numbers. Scoring is one scan
without a shuffle. Features are sums over whole batches of bytes, without a loop over characters, words or lines.

Texts of more than ``LONG_LINES`` lines are read in stretches, of which only each line's evidence and length remain (12
bytes a line). Their passes run over all blocks of ``LONG_LINES`` lines in step: a block is a product of 2 x 2 matrices,
so what enters each block follows from the products of those before it. Texts of 20 MB of line ends take some 300 MB.

Defined results: null and empty texts are one empty line, whose score follows from the fitted constant. Repeated rows
are each scored. Ids that repeat in the labels count once, as label 1 if at least half say so; null labels don't count.
Without labels of a kind every score is 0.5. An empty table gives no rows. Only id and text are read of the documents,
so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_bucket, cut, read_table, ship
from .shingles import slices, word_hashes

SAMPLE, STEPS, RATE, PENALTY = 4000, 120, 1.0, 1e-5
#: Lines of the sample's texts together.
SAMPLE_LINES = 400_000
#: Byte classes that a line's features count.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&<>", "bar": b"|", "shout": b"!", "stop": b".,;:?", "blank": b" \t", "other": bytes(range(128, 256))}
#: Lines of a text beyond which it is scored in blocks of so many; lines of texts whose features are held at once; bytes of a stretch.
LONG_LINES, GROUP_LINES, STRETCH = 2048, 1 << 16, 1 << 16
N_OWN, COPY = 15, 12
N_FEATURES = 1 + 3 * N_OWN + 2


def _own(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each line's own features but COPY, its length in bytes, its number of words, and a sum of its words' hashes."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(float)
    count = {}
    for name, chars in CLASSES.items():
        table = np.zeros(256, np.uint8)
        table[list(chars)] = 1
        count[name] = np.add.reduceat(table[raw], starts, dtype=np.int64).astype(float)
    hashes, _ = word_hashes([joined[:-1]])
    space = np.isin(raw, [32, 9, 10, 11, 12, 13])
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    line = np.searchsorted(ends, begins)
    words = np.bincount(line, minlength=len(ends)).astype(float)
    again = np.zeros(len(begins))
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, len(ends))
    sums = np.zeros(len(ends), np.uint64)
    np.add.at(sums, line, hashes * (np.arange(len(hashes)) - np.searchsorted(line, line) + 1).astype(np.uint64))
    letters = count["upper"] + count["lower"] + 1
    last = np.where(size > 0, raw[np.maximum(ends - 1, 0)], 0)
    one = np.maximum(size, 1)
    own = np.stack(
        [
            count["upper"] / letters, count["symbol"] / one, count["bar"] / (words + 1), count["shout"] / (words + 1), count["digit"] / one,
            count["other"] / one, count["stop"] / (words + 1), count["blank"] / one, repeats / np.maximum(words, 1), np.log1p(words) / 6,
            np.minimum(size / np.maximum(words, 1), 30) / 10, np.isin(last, list(b".?")).astype(float), np.zeros(len(ends)), (words < 3).astype(float), (count["symbol"] > words).astype(float),
        ],
        axis=1,
    )
    return own, size, words, sums


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text."""
    own, size, words, sums = _own(texts)
    text_of = np.repeat(np.arange(len(texts)), [t.count(b"\n") + 1 for t in texts])
    # A line is a copy if an earlier line of its text has the same words; lines are compared by sums of word hashes.
    by = np.lexsort((np.arange(len(own)), sums, text_of))
    own[by[1:], COPY] = (sums[by[1:]] == sums[by[:-1]]) & (text_of[by[1:]] == text_of[by[:-1]]) & (words[by[1:]] > 0)
    first = np.concatenate([[True], text_of[1:] != text_of[:-1]])
    final = np.concatenate([first[1:], [True]])
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[final] = 0, 0
    x = np.concatenate([np.ones((len(own), 1)), own, before, after, first[:, None], final[:, None]], axis=1)
    return x, size, np.bincount(text_of, minlength=len(texts))


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(evidence: np.ndarray, lines: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line P(good); for each text log Z and its expected transitions (2 x 2).

    ``evidence``: log-odds of good for each line; ``move[a, b]``: weight of label b after label a. Texts go in step.
    """
    order = np.argsort(-lines, kind="stable")
    starts = (np.cumsum(lines) - lines)[order]
    left = lines[order]
    longest = int(left.max(initial=0))
    alive = np.searchsorted(-left, -np.arange(longest), side="left")  # texts with more lines than a step's number
    emit = np.stack([np.zeros(len(evidence)), evidence], axis=1)
    fore, aft = np.zeros((len(evidence), 2)), np.zeros((len(evidence), 2))
    fore[starts] = emit[starts]
    for t in range(1, longest):
        at = starts[: alive[t]] + t
        p = fore[at - 1]
        fore[at] = emit[at] + np.stack([_log_add(p[:, 0] + move[0, b], p[:, 1] + move[1, b]) for b in (0, 1)], axis=1)
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        n = aft[at + 1] + emit[at + 1]
        aft[at] = np.stack([_log_add(move[a, 0] + n[:, 0], move[a, 1] + n[:, 1]) for a in (0, 1)], axis=1)
    both = fore + aft
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    z = np.zeros(len(lines))
    z[order] = _log_add(fore[starts + left - 1, 0], fore[starts + left - 1, 1])
    moved = np.zeros((len(lines), 2, 2))
    inner = np.ones(len(evidence), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    text_of = np.repeat(np.arange(len(lines)), lines)[at]
    for a in (0, 1):
        for b in (0, 1):
            moved[:, a, b] = np.bincount(text_of, np.exp(np.minimum(fore[at - 1, a] + move[a, b] + emit[at, b] + aft[at, b] - z[text_of], 0)), len(lines))
    return good, z, moved


def _stretches(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end before a line end, of at most STRETCH bytes or one line."""
    at = 0
    while True:
        end = text.rfind(b"\n", at, at + STRETCH)
        end = text.find(b"\n", at) if end < 0 else end
        yield text[at : end if end >= 0 else None]
        if end < 0:
            return
        at = end + 1


def long_evidence(text: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line of a text its log-odds of good by its features, and its length in bytes."""
    n, done = text.count(b"\n") + 1, 0
    own_w, before_w, after_w = weights[1 : 1 + 3 * N_OWN].reshape(3, N_OWN)
    evidence, size, at, sums = np.zeros(n + 2), np.empty(n, np.int32), [], []  # one place more on each side
    for piece in _stretches(text):
        own, lengths, words, hashed = _own([piece])
        m = len(own)
        size[done : done + m] = lengths
        for shift, w in ((1, own_w), (2, before_w), (0, after_w)):  # a line is evidence for itself, the next and the last one
            evidence[done + shift : done + shift + m] += own @ w
        has = np.flatnonzero(words > 0)
        at.append(has + done)
        sums.append(hashed[has])
        done += m
    at, sums = np.concatenate(at), np.concatenate(sums)
    again = np.ones(len(at), bool)
    again[np.unique(sums, return_index=True)[1]] = False
    for shift, w in ((1, own_w), (2, before_w), (0, after_w)):
        evidence[at[again] + shift] += w[COPY]
    evidence = evidence[1:-1]
    evidence += weights[0]
    evidence[0] += weights[-2]
    evidence[-1] += weights[-1]
    return evidence, size


def _products(evidence: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row of lines (a block) and labels a before it and b at its end, the log of the sum over all labels between."""
    out = np.repeat(start[None], len(evidence), axis=0)
    out[:, :, 1] += evidence[:, :1]
    for t in range(1, evidence.shape[1]):
        out = np.stack([_log_add(out[:, :, 0] + move[0, b], out[:, :, 1] + move[1, b]) for b in (0, 1)], axis=2)
        out[:, :, 1] += evidence[:, t : t + 1]
        if t % 256 == 0:
            out -= out.max(axis=(1, 2), keepdims=True)
    return out - out.max(axis=(1, 2), keepdims=True)


def long_marginals(evidence: np.ndarray, move: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """P(good) of one text's lines, in pieces, from first to last."""
    ahead = lambda d: _log_add(move[0, 1], move[1, 1] + d) - _log_add(move[0, 0], move[1, 0] + d)
    back = lambda d: _log_add(move[1, 0], move[1, 1] + d) - _log_add(move[0, 0], move[0, 1] + d)
    whole, at_once = len(evidence) // block, max(1, (1 << 20) // block)
    groups = [evidence[k * block : min(k + at_once, whole) * block].reshape(-1, block) for k in range(0, whole, at_once)]
    if len(evidence) % block:
        groups.append(evidence[whole * block :].reshape(1, -1))
    if not groups:
        return
    products = np.concatenate([_products(g, move, move) for g in groups])
    n = len(products)
    fore, aft = np.zeros(n), np.zeros(n)  # log-odds of good at the line before a block, and by all after its last line
    v = _products(groups[0][:1], move, np.zeros((2, 2)))[0, 0]  # the first line has none before it
    for k in range(1, n):
        fore[k] = v[1] - v[0]
        v = np.logaddexp(v[0] + products[k, 0], v[1] + products[k, 1])
        v = v - v.max()
    u = np.zeros(2)
    for k in range(n - 2, -1, -1):
        u = np.logaddexp(products[k + 1, :, 0] + u[0], products[k + 1, :, 1] + u[1])
        u = u - u.max()
        aft[k] = u[1] - u[0]
    k = 0
    for g in groups:
        odds, wide = np.empty(g.shape), g.shape[1]
        d = ahead(fore[k : k + len(g)])
        if k == 0:
            d[0] = 0
        for t in range(wide):
            d = g[:, t] + (ahead(d) if t else d)
            odds[:, t] = d
        d = aft[k : k + len(g)]
        for t in range(wide - 1, -1, -1):
            odds[:, t] += d
            d = back(d + g[:, t])
        yield 1 / (1 + np.exp(np.clip(-odds.ravel(), -700, 700)))
        k += len(g)


def long_score(text: bytes, weights: np.ndarray, move: np.ndarray) -> tuple[int, float]:
    """Number of lines and score of one text."""
    evidence, size = long_evidence(text, weights)
    good, total, at = 0.0, 0, 0
    for part in long_marginals(evidence, move, LONG_LINES):
        own = size[at : at + len(part)].astype(float) + 1
        good, total, at = good + float(part @ own), total + int(own.sum()), at + len(part)
    return len(size), good / total


def _batches(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of at most GROUP_LINES lines; a text of more than LONG_LINES is a run of its own."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        lines = t.count(b"\n") + 1
        if k > first and (held + lines > GROUP_LINES or lines > LONG_LINES or held > LONG_LINES and k == first + 1):
            yield first, texts[first:k]
            first, held = k, 0
        held += lines
    if first < len(texts):
        yield first, texts[first:]


def fit(x: np.ndarray, lines: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and transitions, by gradient steps on the mean conditional log-likelihood."""
    theta = np.zeros(N_FEATURES + 4)
    if len(label) == 0 or label.min() == label.max():
        return theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
    text_of = np.repeat(np.arange(len(lines)), lines)
    each = (1 / lines / len(lines))[text_of]  # a text's lines share its weight
    stays = np.zeros((len(lines), 2, 2))
    stays[np.arange(len(lines)), label, label] = lines - 1
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        good, _, moved = marginals(x @ theta[:N_FEATURES], lines, theta[N_FEATURES:].reshape(2, 2))
        g = np.concatenate([x.T @ ((label[text_of] - good) * each), ((stays - moved) / lines[:, None, None]).mean(axis=0).ravel()]) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for first, part in slices(pdf["text"].tolist()):
            x, _, lines = line_features(part)
            ends = np.cumsum(lines)
            yield pd.DataFrame({"label": pdf["label"].iloc[first : first + len(part)].to_numpy(), "lines": lines, "x": [x[e - n : e].astype("<f4").tobytes() for n, e in zip(lines, ends, strict=True)]})


def _scorer(weights: np.ndarray, move: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, part in slices(pdf["text"].tolist()):
                lines, score = np.empty(len(part), np.int64), np.empty(len(part))
                for at, texts in _batches(part):
                    if len(texts) == 1 and texts[0].count(b"\n") >= LONG_LINES:
                        lines[at], score[at] = long_score(texts[0], weights, move)
                        continue
                    x, size, own = line_features(texts)
                    good, _, _ = marginals(x @ weights, own, move)
                    starts = np.cumsum(own) - own
                    lines[at : at + len(texts)] = own
                    score[at : at + len(texts)] = np.add.reduceat(good * (size + 1), starts) / np.add.reduceat(size + 1, starts)
                yield pd.DataFrame({"id": pdf["id"].iloc[first : first + len(part)].to_numpy(), "lines": lines, "score": np.clip(score, 0, 1)})

    return run


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``sample`` labelled texts, of at most ``lines`` lines together, for which ``use`` (of the id) holds.

    They are drawn by hash; a text of more than a twentieth of ``lines`` is passed over. Their features, 192 bytes a line, are all that comes to the driver.
    """
    ship(docs.sparkSession)
    votes = labels.filter(use & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    drawn = votes.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("l_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "l_id")
    texts = cut(texts.groupBy("l_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), "crf-sample")  # of a repeated id the least text
    own = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes = texts.select("l_id", own.alias("own")).filter(F.col("own") <= max(1, lines // 20))  # a longer one is passed over, and only it
    kept = sizes.select("l_id", F.sum("own").over(Window.orderBy(F.xxhash64("l_id"), "l_id")).alias("lines_so_far")).filter(F.col("lines_so_far") <= lines)  # at most ``sample`` rows
    texts = texts.join(F.broadcast(kept.select("l_id")), "l_id", "left_semi")
    got = texts.select("label", "text").mapInPandas(_featured, "label int, lines int, x binary").toPandas()
    got = got.sort_values(["lines", "label", "x"], kind="stable")  # the same sums in the same order, however tasks end
    x = np.frombuffer(b"".join(got["x"]), "<f4").reshape(-1, N_FEATURES).astype(float)
    return fit(x, got["lines"].to_numpy(np.int64), got["label"].to_numpy(np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lines, score (0 to 1) of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_scorer(*model), f"id {dict(docs.dtypes)[id_col]}, lines long, score double").withColumnRenamed("id", id_col)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "lines")
