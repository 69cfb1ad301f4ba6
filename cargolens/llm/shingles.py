"""Words and word shingles of texts as 64-bit numbers, computed with whole-batch array operations.

Texts of a batch are laid end to end as bytes. A word's hash joins two residues of its bytes as a polynomial, modulo
two primes, with its length; each residue is the difference of two running sums, so there is no loop over words, and a
long text costs what its length costs. That hash only finds equal words: what goes out is each distinct word's BLAKE2
digest, once their bytes were compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

#: Bytes that are hashed at once, bytes of a word that is hashed on its own, and bytes of texts that are laid end to end.
SLICE_BYTES, LONG_WORD, GROUP_BYTES = 1 << 18, 256, 1 << 20
#: Prime moduli under 2^31, so that a byte times a power, summed over a slice, stays under 2^64, and the base of each.
_FIELDS = ((2_147_483_647, 1_220_703_125), (2_147_483_629, 1_664_525_013))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(base: int, prime: int) -> np.ndarray:
    """base to the powers of 0 to a slice's length, modulo prime."""
    out = np.ones(1, np.uint64)
    while len(out) <= SLICE_BYTES:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def word_spans(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    space = np.concatenate([[True], _IS_SPACE[np.frombuffer(joined, np.uint8)], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def span_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each of the ascending spans; equal bytes have equal hashes wherever they stand."""
    raw, sizes, out, i = np.frombuffer(joined, np.uint8), ends - starts, np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + SLICE_BYTES, "right")))
        if ends[j - 1] - low <= SLICE_BYTES:
            wide, parts = raw[low : ends[j - 1]].astype(np.uint64) + np.uint64(1), []
            sums = np.zeros(len(wide) + 1, np.uint64)
            for prime, base in _FIELDS:
                p = np.uint64(prime)
                np.cumsum(wide * _powers(base, prime)[: len(wide)], out=sums[1:])
                parts.append((sums[ends[i:j] - low] - sums[starts[i:j] - low]) % p * _powers(pow(base, -1, prime), prime)[starts[i:j] - low] % p)
            out[i:j] = mix(((parts[0] << np.uint64(31)) | parts[1]) ^ mix(sizes[i:j].astype(np.uint64)))
        i = j
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = _digest(joined[starts[k] : ends[k]])
    return out


def equal_spans(joined: bytes, starts: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> bool:
    """Whether the bytes of each span of at most LONG_WORD bytes equal those that begin at its other start."""
    eight = np.ndarray(len(joined), "<u8", joined + bytes(8), strides=(1,))  # the eight bytes from each position on
    at = np.flatnonzero((starts != others) & (sizes <= LONG_WORD))
    starts, sizes, others = starts[at], sizes[at], others[at]
    while len(sizes):
        unused = np.uint64(8) * (np.uint64(8) - np.minimum(sizes, 8).astype(np.uint64))
        if (((eight[starts] ^ eight[others]) << unused) != 0).any():
            return False
        longer = np.flatnonzero(sizes > 8)
        starts, sizes, others = starts[longer] + 8, sizes[longer] - 8, others[longer] + 8
    return True


def _cut(text: bytes, limit: int) -> Iterator[bytes]:
    """``text`` cut at white space into parts of about ``limit`` bytes; a longer word isn't cut."""
    at = 0
    while len(text) - at > limit:
        end = max(text.rfind(c, at, at + limit) for c in _SPACES) + 1
        if end <= at:
            end = min((x for x in (text.find(c, at + limit) for c in _SPACES) if x >= 0), default=len(text) - 1) + 1
        yield text[at:end]
        at = end
    yield text[at:]


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of a text, it and those after it), at most ``limit`` bytes; longer texts come alone, in parts cut at white space."""
    k = 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and (k == first or size + len(texts[k]) + 1 <= limit):
            size += len(texts[k]) + 1
            k += 1
        if size <= limit:
            yield first, texts[first:k]
        else:
            for part in _cut(texts[first], limit):
                yield first, [part]


def per_text(parts: list[bytes], starts: np.ndarray) -> np.ndarray:
    """How many of the ascending positions in the parts, joined by one byte each, lie in each part."""
    return np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in parts])), prepend=0)


def word_digests(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The BLAKE2 digest of each of the ascending spans, taken once of each distinct one.

    Spans are told apart by ``span_hashes`` first; where two with one hash differ, each is taken on its own.
    """
    code, distinct = pd.factorize(span_hashes(joined, starts, ends))
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    if not equal_spans(joined, starts, ends - starts, starts[first][code]):
        first, code = np.arange(len(starts)), np.arange(len(starts))
    found = [_digest(joined[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return np.array(found, np.uint64)[code]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words with A-Z lowered, and the number of words of each text."""
    out, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for first, parts in groups(texts):
        joined = b"\n".join(parts).translate(LOWER)
        starts, ends = word_spans(joined)
        out.append(word_digests(joined, starts, ends))
        counts[first : first + len(parts)] += per_text(parts, starts)
    return np.concatenate(out), counts


def exact_shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct BLAKE2 digests of a text's shingles: equal ones are equal word by word."""
    words = text.translate(LOWER).split()
    n = len(words)
    found = {b"\n".join(words[i : i + size]) for i in range(n - size + 1)} if n >= size else {b"\n".join(words)} if n else set()
    return np.unique(np.fromiter(map(_digest, found), np.uint64, len(found)))


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words."""
    hashes, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        rolled = mix(rolled * np.uint64(0xA0761D6478BD642F) + hashes[k : k + len(rolled)])
    at = 0
    for n in counts.tolist():
        if n >= size:
            yield np.unique(rolled[at : at + n - size + 1])
        elif n:
            one = np.array([n], np.uint64)  # arrays wrap around without a warning
            for i in range(at, at + n):
                one = mix(one * np.uint64(0xE7037ED1A0B428DB) + hashes[i : i + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)
        at += n


def slices(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts in UTF-8), each slice of about ``limit`` bytes; null texts are empty."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(b"" if t is None else t.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= limit:
            yield first, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, held
