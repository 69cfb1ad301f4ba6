"""Token counts by merging whole arrays: every pre-token of a batch takes its lowest-ranked pair in one step.

Pre-tokens are held as one ragged array of symbol ids. A round looks up the rank of every adjacent pair, finds each
sequence's lowest, and applies it at all its places at once; sequences without a pair left are finished, and their
surviving symbols are counted. A pair's places are merged together only if no pair with the merged symbol ranks lower
(else its first place alone), so the rounds give what a queue of single merges gives. Where places overlap, the left one
wins. A very long pre-token keeps the places of each rank instead of rescanning its symbols.

Texts are cut at the tokenizer's special strings, which count one each. Where the tokenizer parts words at white space
(``WordIds.check``), distinct words are found per slice of a batch and each is merged once per worker; else a text's
pre-tokens are. What a worker keeps is bounded, and texts are handled in slices, so memory doesn't grow with a text.

Defined results: a null or empty text has 0 bytes and 0 tokens. Every row gives one row, repeated and null ids too. An
empty table gives no rows. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship
from .packing import SLICE_BYTES, WORDS_AT_ONCE, WordIds, tokenizer_path
from .shingles import LOWER, groups, per_text

LIMIT = 2048
#: Symbols of a pre-token beyond which it is merged on its own, pre-tokens that are merged at once, and symbols of them.
LONG, TOKENS_AT_ONCE, SYMBOLS_AT_ONCE = 4096, 20_000, 1_000_000
#: Distinct pre-tokens, and characters of them, whose counts a worker keeps.
KEPT_TOKENS, KEPT_CHARS = 600_000, 1 << 24
_NONE = np.iinfo(np.int64).max


class Merges:
    """The ranked pairs of a byte-level BPE model, and how many symbols they leave of pre-tokens."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("token counts need a plain BPE model")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = 1 + max(vocab.values())
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        order = np.argsort(ids[:, 0] * self.width + ids[:, 1], kind="stable")
        self.keys, self.ranks, self.made = (ids[:, 0] * self.width + ids[:, 1])[order], order, ids[:, 2]
        least = np.full(self.width, _NONE)  # lowest rank of a pair with the symbol
        for side in (0, 1):
            np.minimum.at(least, ids[:, side], np.arange(len(ids)))
        self.together = least[self.made] > np.arange(len(ids))
        alphabet = [c for c in vocab if len(c) == 1 and c + suffix in vocab]
        self.inner, self.last = (np.full(1 + max(map(ord, alphabet)), -1, np.int64) for _ in range(2))
        for c in alphabet:
            self.inner[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + suffix]
        if len(alphabet) < 256:
            raise ValueError("token counts need a vocabulary of all bytes")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE if it isn't merged."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, tokens: list[str]) -> np.ndarray:
        """How many symbols are left of each non-empty pre-token of byte characters."""
        out, sizes = np.zeros(len(tokens), np.int64), np.fromiter(map(len, tokens), np.int64, len(tokens))
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self._of_long(self._symbols(tokens[k], sizes[k : k + 1]))
        short = np.flatnonzero(sizes <= LONG)
        ends, k = np.cumsum(sizes[short]), 0
        while k < len(short):
            before = ends[k - 1] if k else 0
            j = min(k + TOKENS_AT_ONCE, max(k + 1, int(np.searchsorted(ends, before + SYMBOLS_AT_ONCE, "right"))))
            part = short[k:j]
            out[part] = self._of_many(self._symbols("".join(tokens[i] for i in part.tolist()), sizes[part]), sizes[part])
            k = j
        return out

    def _symbols(self, chars: str, sizes: np.ndarray) -> np.ndarray:
        points = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
        out, ends = self.inner[points], np.cumsum(sizes) - 1
        out[ends] = self.last[points[ends]]
        return out

    def _of_many(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        left = np.zeros(len(sizes), np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(symbols), _NONE)  # of a symbol and the next of its sequence
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(starts, append=len(symbols))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == _NONE
            left[owner[starts[done]]] = sizes[done]
            lows = np.repeat(lowest, sizes)
            at = np.flatnonzero((rank == lows) & (lows != _NONE))
            if not len(at):
                break
            alone = ~self.together[rank[at]]
            if alone.any():  # the first place of its sequence only
                at = at[~alone | np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            at = at[_leftmost(at, at + 1)]
            symbols[at] = self.made[rank[at]]
            keep = np.repeat(~done, sizes)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            at, symbols, owner, rank = place[at], symbols[keep], owner[keep], rank[keep]
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[changed] = _NONE
            changed = changed[changed < len(symbols) - 1]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self.rank(symbols[changed], symbols[changed + 1])
        return left

    def _of_long(self, symbols: np.ndarray) -> int:
        """The same for one sequence, by the places of each rank."""
        n = left = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        rank = np.append(self.rank(symbols[:-1], symbols[1:]), _NONE)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else []:
                k = int(rank[part[0]])
                if k not in places:
                    heapq.heappush(waiting, k)
                places.setdefault(k, []).append(part)

        note(np.arange(n))
        while waiting:
            k = heapq.heappop(waiting)
            at = np.unique(np.concatenate(places.pop(k)))
            at = at[rank[at] == k]
            if not len(at):
                continue
            if not self.together[k] and len(at) > 1:
                places[k] = [at[1:]]
                heapq.heappush(waiting, k)
                at = at[:1]
            at = at[_leftmost(at, after[at])]
            gone = after[at]
            symbols[at], rank[gone], left = self.made[k], _NONE, left - len(at)
            after[at] = after[gone]
            before[after[gone]] = at  # ``before`` has a place for the end
            changed = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            rank[changed] = _NONE
            changed = changed[after[changed] < n]
            rank[changed] = self.rank(symbols[changed], symbols[after[changed]])
            note(changed)
        return left


def _leftmost(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the ascending places to take so that none begins where the one before it ends, from the left."""
    touches = np.concatenate([[False], following[:-1] == at[1:]])
    k = np.arange(len(at))
    return (k - np.maximum.accumulate(np.where(touches, 0, k))) % 2 == 0


class TokenCounts(WordIds):
    """Numbers of tokens of texts, by way of those of their distinct words or pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        stated = json.loads(Path(path).read_text(encoding="utf-8"))
        added = stated["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("token counts need special strings that are found as they stand")
        names = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.merges, self.tokenizer = Merges(stated["model"]), Tokenizer.from_file(path)
        try:
            self.check()
            self.by_word = True
        except ValueError:
            self.by_word = False
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.known: dict[str, int] = {}  # tokens of a pre-token
        self.chars = 0

    def _pre_tokens(self, text: str) -> list[str]:
        t = self.tokenizer
        return [x for x, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text) if t.normalizer else text)]

    def _merged(self, tokens: list[str], owner: np.ndarray, n: int) -> np.ndarray:
        """Tokens by owner, 0 to n - 1, of pre-tokens with an owner each."""
        if len(self.known) > KEPT_TOKENS or self.chars > KEPT_CHARS:
            self.known, self.chars = {}, 0
        new = list({t: None for t in tokens if t not in self.known})
        self.known.update(zip(new, self.merges.counts(new).tolist(), strict=True))
        self.chars += sum(map(len, new))
        return np.bincount(owner, [self.known[t] for t in tokens], n).astype(np.int64)

    def _add(self, hashes: list[int], words: list[bytes]) -> None:
        for at in range(0, len(words), WORDS_AT_ONCE):
            texts = [x.decode("utf-8", "replace") for x in words[at : at + WORDS_AT_ONCE]]
            plain = [i for i, t in enumerate(texts) if t.isascii() and t.isprintable()]  # these are pre-tokenized in one go
            joined = " ".join(texts[i] for i in plain)
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(joined)
            ends = np.cumsum(np.fromiter((len(texts[i]) + 1 for i in plain), np.int64, len(plain)))
            begins = np.fromiter((x[0] for _, x in found), np.int64, len(found))
            tokens, owner = [t for t, _ in found], np.array(plain, np.int64)[np.searchsorted(ends, begins, "right")].tolist()
            for i in sorted(set(range(len(texts))) - set(plain)):
                own = self._pre_tokens(texts[i])
                tokens += own
                owner += [i] * len(own)
            self._grown("sizes", self._merged(tokens, np.array(owner, np.int64), len(texts)), len(self.words) + at)
        self.index.update(zip(hashes, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.words += words
        self.bytes += sum(map(len, words))

    def _of_slice(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text without special strings."""
        if self.by_word:
            lowered = [t.translate(LOWER) for t in texts]
            joined = b"\n".join(lowered) + b"\n"
            starts, ends = self._spans(joined)
            at = self._numbers(joined, starts, ends)
            if at is not None:
                return np.diff(np.concatenate([[0], np.cumsum(self.sizes[at])])[np.cumsum(per_text(lowered, starts))], prepend=0)
        parts = [self._pre_tokens(t.decode("utf-8", "replace")) for t in texts]
        return self._merged([x for p in parts for x in p], np.repeat(np.arange(len(texts)), [len(p) for p in parts]), len(texts))

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        out, owner, parts = np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            own = self.special.split(t) if self.special else [t]
            out[i] = len(own) - 1
            owner += [i] * len(own)
            parts += own
        for first, some in groups(parts, SLICE_BYTES) if self.by_word else _whole(parts, SLICE_BYTES):
            np.add.at(out, owner[first : first + len(some)], self._of_slice(some))  # a long text comes in parts, cut at white space
        return out


def _whole(parts: list[bytes], limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(index of a part, it and those after it), of about ``limit`` bytes together."""
    first, size = 0, 0
    for k, part in enumerate(parts, 1):
        size += len(part)
        if size >= limit or k == len(parts):
            yield first, parts[first:k]
            first, size = k, 0


_held: dict[str, TokenCounts] = {}


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _held:
            _held[path] = TokenCounts(path)
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(_held[path].count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes (in UTF-8) and n_tokens (without begin, end or added special tokens)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_counted(tokenizer_path), f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
