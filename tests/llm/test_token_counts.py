"""Token counts against the library's encoder and, for rankings that it doesn't ship, against a queue of single merges."""

import heapq
import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cargolens.llm import token_counts
from cargolens.llm.token_counts import Merges, TokenCounts, count_tokens

SF = "/root/testdata/sf0.001"
PIECES = ["the", "Hello", "don't", "DON'T", "x1!", "(b)", "c...", "ñandú,", "É", "É", "́", "3.5%", "«ok».", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<|startoftext|>", "aaaa", "abababab", "'s", "'ll", "ΟΔΟΣ", "İ", "ß", "\U0001f600", "中文字", "１２", "²", "_", "....", "\n", "\t", "\x00"]


def odd_texts(seed, n=400):
    r = random.Random(seed)
    mixed = ["".join(r.choice(PIECES) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(0, 30))) for _ in range(n)]
    letters = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 200))) for _ in range(n // 4)]
    return mixed + letters + ["a" * k for k in range(70)]


def by_library(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_as_the_library(name):
    r = random.Random(1)
    texts = [*odd_texts(2), "ab" * 4000, "a" * 9999, "!" * 6000, "é" * 4000, "".join(r.choice("etaoinshrdlu") for _ in range(9000))]
    counts = TokenCounts(public_tokenizers.path(name))
    assert counts.count([t.encode() for t in texts]).tolist() == by_library(name, texts)
    assert counts.count([t.encode() for t in texts]).tolist() == by_library(name, texts)  # from what it keeps
    assert counts.count([]).tolist() == []


def test_bounds_of_what_is_kept(monkeypatch):
    for bound, value in (("LONG", 8), ("TOKENS_AT_ONCE", 3), ("SYMBOLS_AT_ONCE", 20), ("KEPT_TOKENS", 5), ("SLICE_BYTES", 64), ("WORDS_AT_ONCE", 7)):
        monkeypatch.setattr(token_counts, bound, value)
    texts = odd_texts(3, 150)
    assert TokenCounts(public_tokenizers.path("word_bpe_49k.json")).count([t.encode() for t in texts]).tolist() == by_library("word_bpe_49k.json", texts)


def test_words_of_one_hash(monkeypatch):
    from cargolens.llm import packing

    monkeypatch.setattr(packing, "span_hashes", lambda joined, starts, ends: np.zeros(len(starts), np.uint64))
    texts = odd_texts(4, 100)
    assert TokenCounts(public_tokenizers.path("word_bpe_49k.json")).count([t.encode() for t in texts]).tolist() == by_library("word_bpe_49k.json", texts)


def queue_count(symbols, pairs):
    """Symbols left by single merges, lowest rank first and leftmost of it."""
    s, alive = list(symbols), [True] * len(symbols)
    after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
    heap = [(*pairs[a, b], i, a, b) for i, (a, b) in enumerate(zip(s, s[1:])) if (a, b) in pairs]
    heap = [(rank, i, a, b, made) for rank, made, i, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(s) or s[i] != a or s[j] != b:
            continue
        s[i], alive[j], after[i] = made, False, after[j]
        if after[j] < len(s):
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < len(s) and (s[left], s[after[left]]) in pairs:
                rank, new = pairs[s[left], s[after[left]]]
                heapq.heappush(heap, (rank, left, s[left], s[after[left]], new))
    return sum(alive)


@pytest.mark.parametrize("seed", range(6))
def test_rounds_against_single_merges(seed, monkeypatch):
    """Rankings of any order, so that a merged symbol may have a pair that ranks lower than its own."""
    r = random.Random(seed)
    letters = [chr(192 + i) for i in range(256)]
    vocab = {c: i for i, c in enumerate(letters)}
    names = letters[:3]
    merges = []
    while len(merges) < 60:
        a, b = r.choice(names), r.choice(names)
        if [a, b] not in merges and len(a + b) < 12:
            merges.append([a, b])
            names.append(a + b)
            vocab.setdefault(a + b, len(vocab))
    r.shuffle(merges)
    model = Merges({"type": "BPE", "vocab": vocab, "merges": merges})
    assert not model.together.all()
    pairs = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)}
    tokens = ["".join(r.choice(letters[:3]) for _ in range(r.randrange(1, 60))) for _ in range(200)]
    want = [queue_count([vocab[c] for c in t], pairs) for t in tokens]
    assert model.counts(tokens).tolist() == want
    monkeypatch.setattr(token_counts, "LONG", 1)
    assert model.counts(tokens).tolist() == want


def test_rows(spark):
    texts = [*odd_texts(5, 40), None, "", "word " * 200_000, "x" * 300_000]
    rows = [(i if i % 7 else None, t, i, "b") for i, t in enumerate(texts)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, n_bytes string")
    got = count_tokens(d, public_tokenizers.path("word_bpe_49k.json")).collect()
    want = [(i, len((t or "").encode()), n) for (i, t, *_), n in zip(rows, by_library("word_bpe_49k.json", [x[1] for x in rows]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), n, n > 2048) for r, n in zip(rows, by_library("word_bpe_49k.json", [r["text"] for r in rows]))}
    got = token_counts.op11_token_counts(spark, SF).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == want
