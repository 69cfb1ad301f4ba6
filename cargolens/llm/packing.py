"""Packing by minimum bin slack: token ids of texts into windows of at most ``capacity`` ids with little padding.

One scan turns texts into ids and cuts those longer than a window into whole windows and a rest; it keeps only piece
lengths and checksums. Pieces are then dealt by hash into shards of about ``shard_pieces`` narrow rows, and each shard
is packed alone: the longest piece left opens a window, and a subset-sum over a bitset of reachable fills picks
the multiset of remaining lengths that comes closest to its capacity; how many of each length is found by going back
through the bitsets. A window's pattern is used as often as its lengths last. Only a shard's last windows have slack.

Shards bound a task's rows whatever the table's size, and a hot source or group of copies has no say in them.

With an order column, such as the positions of a mix, shards are ranges of that order instead, each of about
``shard_pieces`` pieces, lengths are used up in that order, and sequences are numbered by the mean place of their
pieces: read by ``sequence_id``, texts come in the column's order except within a shard, where packing deals them.

Defined results: a null or empty text is its end id alone. Repeated rows are packed each. An empty table gives no
pieces. Only the id and the text are read, so other columns can't clash. A null id is packed like any other.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read_table, ship
from .shingles import LOWER, equal_spans, groups, per_text, span_hashes, word_spans

CAPACITY, END_ID, SHARD_PIECES = 4096, 2, 2000
#: Distinct words, and bytes of them, whose ids a worker keeps; beyond either, it starts again.
KEPT_WORDS, KEPT_BYTES = 600_000, 1 << 25
#: Bytes of texts whose words are looked up at once, and new words that are encoded at once.
SLICE_BYTES, WORDS_AT_ONCE = 1 << 22, 4000
#: Ids after which a worker hands on what it has.
MOST_IDS = 4_000_000


#: ASCII signs that end words; the apostrophe isn't one, since it can begin a token with the letters after it.
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_IS_SIGN, _IS_PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_IS_SIGN[list(_SIGNS)] = True
_IS_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


class WordIds:
    """Ids of texts by way of the ids of their distinct words.

    White space never lies within a token of this tokenizer and case doesn't matter to it, so a text's ids are those of
    its lowered words in a row. Nor does a token hold both a letter or digit and the sign after it: a word's end of
    ASCII signs is looked up apart from the rest. A text with the beginning of a special token keeps its case.
    Words are found by hash and told apart by their bytes. ``check`` refuses tokenizers for which this doesn't hold.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.check()
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}  # number of a word by its hash
        self.words: list[bytes] = []
        self.bytes = self.used = 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)  # where each word's ids stand in flat
        self.flat = np.zeros(1 << 16, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def check(self) -> None:
        words = ["Étude", "DON'T", "x1!", "(b)", "c...", "ñandú,", "3.5%", "e-mail:", "«ok».", "a_b;", "¿qué?!"]
        apart = [i for w in words for i in self._ids(w.encode().translate(LOWER).decode())]
        signs = [i for x in ("x1", "!", "c", "...", "ñandú", ",") for i in self._ids(x)]
        if self._ids(" ".join(words)) != apart or self._ids("\n\t".join(words)) != apart or self._ids("x1! c... ñandú,") != signs:
            raise ValueError("packing needs a tokenizer that ignores case and white space and parts words from the signs after them")

    def _grown(self, name: str, values: np.ndarray, used: int) -> None:
        """Put ``values`` behind the ``used`` first ones of an array."""
        held = getattr(self, name)
        while used + len(values) > len(held):
            held = np.concatenate([held, np.zeros_like(held)])
        held[used : used + len(values)] = values
        setattr(self, name, held)

    def _add(self, hashes: list[int], words: list[bytes]) -> None:
        for at in range(0, len(words), WORDS_AT_ONCE):
            texts = [x.decode("utf-8", "replace") for x in words[at : at + WORDS_AT_ONCE]]
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            begins = np.fromiter((x[0] for x in found.offsets), np.int64, len(ids))
            sizes, known = np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(texts)), len(self.words) + at
            self._grown("starts", self.used + np.cumsum(sizes) - sizes, known)
            self._grown("sizes", sizes, known)
            self._grown("flat", ids, self.used)
            self.used += len(ids)
        self.index.update(zip(hashes, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.words += words
        self.bytes += sum(map(len, words))

    def _spans(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Words, and apart from them the signs that end them."""
        starts, ends = word_spans(joined)
        raw = np.frombuffer(joined, np.uint8)
        core = np.maximum.accumulate(np.where(_IS_SIGN[raw], 0, np.arange(1, len(raw) + 1, dtype=np.int32)))[ends - 1] if len(ends) else ends
        core = core[(core > starts) & (core < ends) & _IS_PLAIN[raw[core - 1]]]
        return (np.sort(np.concatenate([x, core]), kind="stable") for x in (starts, ends))

    def _numbers(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """The number of each word; None if two words have one hash."""
        if len(self.index) > KEPT_WORDS or self.bytes > KEPT_BYTES:
            self.clear()
        code, distinct = pd.factorize(span_hashes(joined, starts, ends))
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        if not equal_spans(joined, starts, ends - starts, starts[first][code]):
            return None
        hashes = distinct.tolist()
        words = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        at = list(map(self.index.get, hashes))
        if any(self.words[k] != w for k, w in zip(at, words, strict=True) if k is not None):
            return None
        if None in at:
            new = [i for i, k in enumerate(at) if k is None]
            self._add([hashes[i] for i in new], [words[i] for i in new])
            at = list(map(self.index.__getitem__, hashes))
        return np.array(at, np.int64)[code]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        lowered = [b"" if b"<|" in t else t.translate(LOWER) for t in texts]
        joined = b"\n".join(lowered) + b"\n"
        starts, ends = self._spans(joined)
        at = self._numbers(joined, starts, ends)
        if at is None:
            return [self._whole(t) for t in texts]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(total)]
        limits = np.concatenate([[0], ends])[np.cumsum(per_text(lowered, starts))[:-1]]
        return [self._whole(t) if b"<|" in t else x for t, x in zip(texts, np.split(ids, limits), strict=True)]

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self._ids(text.decode("utf-8", "replace")), np.uint32)

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids) of each text; a long text is cut at white space for it."""
        held: list[np.ndarray] = []
        for first, parts in groups(texts, SLICE_BYTES):
            if held and first != at:
                yield at, np.concatenate(held)
                held = []
            found = self.encode(parts)
            if len(parts) > 1:
                yield from enumerate(found, first)
            else:
                at = first
                held += found
        if held:
            yield at, np.concatenate(held)


_held: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def frame(pdf: pd.DataFrame, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["row", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        row = out.pop("row").to_numpy(np.int64)
        out.insert(0, "id", pdf["id"].to_numpy()[row])
        if "place" in pdf:
            out["place"] = pdf["place"].to_numpy()[row]
        return out if with_ids else out.drop(columns="ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _held:
            _held[path] = WordIds(path)
        words = _held[path]
        for pdf in batches:
            texts = [b"" if t is None else t.encode("utf-8", "replace") for t in pdf["text"]]
            rows, size = [], 0
            for i, ids in words.encode_all(texts):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((i, start, len(piece), zlib.crc32(piece), len(ids), piece.tobytes() if with_ids else b""))
                size += len(ids)
                if size > MOST_IDS:
                    yield frame(pdf, rows)
                    rows, size = [], 0
            yield frame(pdf, rows)

    return run


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to ``room`` from below."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... of a length at once: any number up to the count is a sum of some
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left, k = left - k, 2 * k
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            taken[length] = taken.get(length, 0) + k
    return taken


def windows(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions of ``lengths`` by window, each window's sum at most ``capacity``."""
    counts: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    for i, x in enumerate(lengths.tolist()):
        counts[x] = counts.get(x, 0) + 1
        held.setdefault(x, []).append(i)
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        taken = fill({k: v for k, v in counts.items() if v}, capacity - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        for _ in range(min(counts[k] // v for k, v in taken.items())):
            out.append([held[k].pop() for k, v in sorted(taken.items(), reverse=True) for _ in range(v)])
            for k, v in taken.items():
                counts[k] -= v
        counts = {k: v for k, v in counts.items() if v}
    return out


def _packed(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if "rank" in pdf:  # the last of a length is used first
            pdf = pdf.sort_values(["length", "rank"], ascending=[True, False]).reset_index(drop=True)
        else:
            pdf = pdf.sort_values(["length", "id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        found = windows(pdf["length"].to_numpy(), capacity)
        if "rank" in pdf:
            rank = pdf.pop("rank").to_numpy()
            found.sort(key=lambda window: (rank[window].mean(), rank[window].min()))
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, window in enumerate(found):
            sizes = pdf["length"].to_numpy()[window]
            sequence[window] = (int(key[0]) << 32) + k
            offset[window] = np.cumsum(sizes) - sizes
        return pdf.drop(columns="shard").assign(sequence_id=sequence, offset=offset)

    return run


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """``pieces`` with ``rank`` instead of ``place``: 0 to ``total`` - 1 by place, numbered within ranges of places that are offset by those before."""
    low, high = pieces.agg(F.min("place"), F.max("place")).first()
    low, high = (0, 0) if low is None else (low, high)
    ranges = max(1, math.ceil(total / max(1000, math.isqrt(total))))
    place = F.coalesce(F.col("place"), F.lit(high + 1))  # null places come last
    pieces = pieces.withColumn("place", place).withColumn("range", F.floor((F.col("place") - low).cast("double") * ranges / (high - low + 2)))
    before = F.coalesce(F.sum("size").over(Window.orderBy("o_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.groupBy(F.col("range").alias("o_range")).agg(F.count("*").alias("size")).select("o_range", before.alias("before"))  # ``ranges`` rows
    within = F.row_number().over(Window.partitionBy("range").orderBy("place", "id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("within", within).join(offsets, F.col("range") == F.col("o_range"))
    return ranked.withColumn("rank", F.col("before") + F.col("within")).drop("place", "range", "o_range", "before", "within")


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, with_ids: bool = False,
    order_col: str | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids (little-endian, 4 bytes each).

    ``order_col``: whole numbers, about dense, whose order the sequences keep by shard.
    """
    kind = dict(docs.dtypes)[id_col]
    ship(docs.sparkSession)
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(order_col).cast("long").alias("place")] if order_col else []))
    pieces = cut(rows.mapInPandas(_pieces(tokenizer_path, capacity, end_id, with_ids), schema + ", place long" * bool(order_col)), "packing-pieces")
    total = pieces.count()
    shards = max(1, -(-total // shard_pieces))
    if order_col:
        dealt = _ranked(pieces, total).withColumn("shard", F.floor(F.col("rank") / shard_pieces))
    else:
        dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(shards)))
    out = dealt.groupBy("shard").applyInPandas(_packed(capacity), f"{schema}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
