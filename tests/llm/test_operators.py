import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.llm import exact_dedup, line_crf, lm, minhash, mixing, packing, pii, quality_rules, secrets, shingles, warc
from cargolens.llm.components import components
from cargolens.llm.common import crc_bucket, cut

ROWS = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (4, "a b", "x"), (None, "a b", "z"), (5, "lone", "x"), (4, "a b", "x")]
#: Columns whose names clash with results.
EXTRA = "doc_id long, text string, source string"


def docs(spark, rows=ROWS):
    d = spark.createDataFrame(rows, EXTRA)
    clash = ["keep_id", "kept", "n", "n_words", "slot", "position", "score", "id", "label", "block", "length", "key", "spans", "email", "weak", "component"]
    return d.withColumns({c: F.lit("own") for c in clash})


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_exact_duplicates(spark):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_duplicates(docs(spark)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1, sha("a b")]["keep_id"], got[1, sha("a b")]["group_size"], got[1, sha("a b")]["kept"]) == (4, 4, False)
    assert got[4, sha("a b")]["kept"] and not got[None, sha("a b")]["kept"] and got[2, sha("")]["keep_id"] == 3 and got[5, sha("lone")]["group_size"] == 1
    for limit in (0, 100_000):  # with and without broadcasts
        kept = exact_dedup.drop_exact_duplicates(docs(spark), broadcast_rows=limit)
        assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 4, 5] and kept.columns == docs(spark).columns
    assert exact_dedup.exact_duplicates(docs(spark).limit(0)).count() == 0


def test_quality_ledger(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "x"), (2, None, "x"), (3, "a b c " * 40, "x"), (4, long.upper(), "x"), (5, "\n".join(["same line of words here now"] * 20), "x"), (6, long + " x y z x y z", "x")]
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs(spark, rows)).collect()}
    assert got[1]["failed_bits"] == 0 and got[2]["failed_bits"] == quality_rules.mask("few_words")
    assert got[3]["n_repeat_words"] == 120 and got[4]["failed_bits"] == quality_rules.mask("capitals") and got[5]["n_dup_lines"] == 19 and got[6]["n_repeat_words"] == 6
    kept = quality_rules.keep_good(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 6] and kept.columns == docs(spark).columns
    ab = {(r["policy"], r["rule"]): r for r in quality_rules.ablations(quality_rules.ledger(docs(spark, rows))).collect()}
    assert ab[2, "capitals"]["n_kept"] == 2 and ab[2, "capitals"]["n_kept_without"] == 3
    assert quality_rules.ledger(docs(spark).limit(0)).count() == 0


def test_quality_keeps_clean_texts(spark):
    line = lambda k: " ".join(f"word{k}x{i}" for i in range(40)) + "."
    once, often = "\n".join(["Said once more.", line(1), line(2), "Said once more."]), "\n".join([line(1), line(2), *["Read more here now."] * 4])
    three = "\n".join(["Said once more.", line(1) + " " + line(2), "Said once more."])
    assert [r["doc_id"] for r in quality_rules.keep_good(docs(spark, [(1, once, "x"), (2, often, "x"), (3, three, "x")])).orderBy("doc_id").collect()] == [1, 3]
    assert not quality_rules.POLICIES[quality_rules.CURRENT] & quality_rules.mask("many_words")


@pytest.mark.parametrize("seed", range(3))
def test_repeat_words_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(0, 40))), "x") for i in range(40)]
    for x in quality_rules.ledger(docs(spark, rows)).collect():
        w = rows[x["doc_id"]][1].split()
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert x["n_repeat_words"] == len({p for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})


def test_pii(spark):
    t = "Écrire à bob.x@mail.example.com, card 4111 1111 1111 1111, +1 (555) 555-0100 ip 300.1.1.1 10.0.0.1 IBAN DE89 3704 0044 0532 0130 00. SSN: 123-45-6789"
    many = " ".join(f"10.0.{i % 250}.{i // 250}" for i in range(2000))
    got = {r["doc_id"]: r for r in pii.find_pii(docs(spark, [(1, t, "x"), (2, None, "x"), (3, many, "x"), (4, "code 123-45-6789 and DE88 3704 0044 0532 0130 00", "x")])).collect()}
    one = {k: [t[x["start"] : x["end"]] for x in got[1][k]] for k in (*pii.BASE, *pii.EXTRA)}
    assert one["email"] == ["bob.x@mail.example.com"] and one["card"] == ["4111 1111 1111 1111"] and one["phone"] == ["+1 (555) 555-0100"] and one["ip"] == ["10.0.0.1"]
    assert one["iban"] == ["DE89 3704 0044 0532 0130 00"] and one["national_id"] == ["123-45-6789"]
    assert not any(got[2][k] for k in pii.BASE) and not got[4]["national_id"] and not got[4]["iban"]
    assert [(x["start"], x["end"]) for x in got[3]["ip"]] == [m.span() for m in re.finditer(r"[0-9.]+", many)]


def test_secrets_link_parts(spark):
    weak = "x9Kd83jQmZ0pLw7RtY2v"
    near, far = f"user = alice key {weak} on https://db.example.com/x", f"key {weak} " + "z " * 400 + "user = alice"
    rows = [(1, near, "x"), (2, far, "x"), (3, None, "x"), (4, 'token = "abcdef12"', "x"), (4, near, "x"), (None, near, "x")]
    got = [(r["doc_id"], [x["value"] for x in r["secret"]], len(r["identifier"]), len(r["endpoint"]), len(r["assign"])) for r in secrets.find_secrets(docs(spark, rows)).collect()]
    assert (1, [weak], 1, 1, 0) in got and (2, [], 0, 0, 0) in got and (3, [], 0, 0, 0) in got and (4, [], 0, 0, 1) in got and (4, [weak], 1, 1, 0) in got and (None, [weak], 1, 1, 0) in got


def test_secrets_of_any_length(spark):
    r = random.Random(2)
    rows, want = [], {}
    for n, size in enumerate([20, 64, 65, 128, 129, 300, 5000]):
        name = "n" * (size - 1) + "9"
        late = "x" * (size - 2) + "Y7"  # upper case and digit at the end only
        mixed = "".join(r.choice("abcXYZ019+/_-") for _ in range(size - 3)) + "aA0=="
        rows += [(2 * n, f"user = {name} {late}", "x"), (2 * n + 1, f"{mixed} https://db.example.com", "x")]
        want |= {2 * n: ([name], [late]), 2 * n + 1: ([], [mixed])}
    got = {x["doc_id"]: x for x in secrets.find_secrets(docs(spark, rows)).collect()}
    for n, (names, tokens) in want.items():
        assert [x["value"].removeprefix("user = ") for x in got[n]["identifier"]] == names and [x["value"] for x in got[n]["secret"]] == tokens
        assert len(got[n]["endpoint"]) == n % 2


def test_secrets_link_across_bins(spark):
    r = random.Random(1)
    rows = [(n, k, a + d, b + d) for n, (d, parts) in enumerate([(d, p) for d in range(0, 301, 10) for p in ([("identifier", 290, 310), ("hex", 600, 624)], [("endpoint", 0, 350), ("hex", 610, 640)], [("hex", 0, 24), ("identifier", 324, 340)])]) for k, a, b in parts]
    for n in range(1000, 1150):
        for _ in range(6):
            a = r.randrange(0, 2500)
            rows.append((n, r.choice((*secrets.STRONG, *secrets.WEAK)), a, a + r.randrange(3, 700)))
    parts = spark.createDataFrame(rows, "row long, kind string, start int, end int")
    got = sorted((x["row"], x["kind"], x["start"], x["end"]) for x in secrets.linked(parts, 300).collect())
    near = lambda x, y: x[0] == y[0] and y[1] in secrets.NEEDS[x[1]] and x[2:] != y[2:] and y[2] - x[3] <= 300 and x[2] - y[3] <= 300
    want = sorted({x for x in rows if x[1] in secrets.WEAK and any(near(x, y) for y in rows)})
    assert got == want and {n for n, *_ in want} >= set(range(93))


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1</p>" * 100
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", None), (6, "http://f", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"address": F.lit(1), "payload": F.lit(2), "size": F.lit(3)})
    warc.write_archive(pages, str(tmp_path / "a"))
    got = {r["id"]: r for r in warc.read_archive(spark, str(tmp_path / "a")).collect()}
    assert {i: r["record_type"] for i, r in got.items()} == {1: "revisit", 2: "revisit", 3: "response", 4: "response", 5: "response", 6: "response"}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i]["payload"] == (raw if got[i]["record_type"] == "response" else None) and got[i]["payload_digest"] == hashlib.sha1(raw).hexdigest() and got[i]["verified"] and got[i]["payload_bytes"] == len(raw)
    assert got[1]["refers_to"] == 6 and got[3]["refers_to"] is None and bytes(got[3]["record"]).endswith(b"small\r\n\r\n")
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 3
    warc.write_files(warc.read_archive(spark, str(tmp_path / "a")), str(tmp_path / "f"))
    back = Counter((r["record_type"], bytes(r["payload"])) for r in warc.read_files(spark, str(tmp_path / "f")).collect())
    assert back == {("revisit", b""): 2, ("response", b"small"): 2, ("response", b""): 1, ("response", big.encode()): 1}


def test_mixing_keeps_within_a_block(spark):
    rows = [(i, "t", s) for i, s in enumerate(["a"] * 300 + ["b"] * 120 + [None] * 50 + ["c"] * 7)]
    weights = {"a": 5.0, "b": 3.0, "c": 0.5, None: 1.0}
    got = mixing.schedule(docs(spark, rows), weights, block=4).collect()
    share = {s: Fraction(w) / Fraction(sum(weights.values())) for s, w in weights.items()}
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    slots = {}
    for r in got:
        assert slots.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
        assert math.floor(r["block"] / share[r["source"]]) <= r["slot"] < math.ceil((r["block"] + 1) / share[r["source"]])
    assert [r["slot"] for r in sorted(got, key=lambda r: r["position"])] == sorted(r["slot"] for r in got)
    out = mixing.in_mixed_order(docs(spark, rows), weights)
    assert out.count() == len(rows) and out.columns == docs(spark).columns
    assert mixing.schedule(docs(spark).limit(0)).count() == 0 and mixing.in_mixed_order(docs(spark)).count() == len(ROWS)


@pytest.mark.parametrize("n, top, rows", [(100, 0.9, 1800), (20, 0.1395, 1500), (500, 0.33, 1000)])
def test_mixing_keeps_the_stated_weights(spark, n, top, rows):
    weights = {"s0": top} | {f"s{k}": (1 - top) / (n - 1) for k in range(1, n)}
    size = {s: math.ceil(w * rows / top) + 1 for s, w in weights.items()}
    table = [(i, "t", s) for i, s in enumerate(s for s, k in size.items() for _ in range(k))]
    got = sorted(mixing.schedule(docs(spark, table), weights, block=1).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(table)))
    had, total = Counter(), math.fsum(weights.values())
    for t, r in enumerate(got[:rows], 1):  # no source is used up yet
        had[r["source"]] += 1
        assert r["slot"] == t - 1 and all(abs(had[s] - t * w / total) < 1 + 1e-6 for s, w in weights.items())


def test_mixing_of_many_sources(spark):
    table = [(i, "t", f"s{i % 1500}") for i in range(4000)]
    got = mixing.schedule(docs(spark, table)).collect()
    assert sorted(r["position"] for r in got) == list(range(len(table)))
    with pytest.raises(ValueError):
        mixing.schedule(docs(spark, [(1, "t", "x")]), {"x": 0.0})


def test_mixing_query_keeps_its_weights(spark, tmp_path):
    """Prefix shares of the query stay within one block of the roots of 100 sources' rows, and equal its SQL."""
    from ..compare import differences

    rows = [(i, "t", f"s{k}") for i, k in enumerate(k for k in range(100) for _ in range(4000 if k == 0 else 16 + k))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op7_mixing(spark, str(tmp_path))
    slots = {(r["slot"], r["source"]) for r in got.collect()}
    sizes = Counter(s for *_, s in rows)
    total, had, open_sources = sum(map(math.sqrt, sizes.values())), Counter(), set(sizes)
    for slot, source in sorted(slots):
        had[source] += 1
        if had[source] * 16 >= sizes[source]:
            break  # a source is used up
        assert all(abs(had[s] - (slot + 1) * math.sqrt(sizes[s]) / total) < 1 + 1e-6 for s in open_sources)
    assert sum(had.values()) > 20
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(got, db, mixing.OP7_SQL) == []


def test_mixing_of_a_large_order(spark, monkeypatch):
    """An order that isn't broadcast gives the same rows in the same order."""
    table = spark.createDataFrame([(i, "t", "abc"[i % 7 % 3]) for i in range(700)], EXTRA)
    near = [r["doc_id"] for r in mixing.in_mixed_order(table).collect()]
    monkeypatch.setattr(mixing, "ORDER_ROWS", 0)
    assert [r["doc_id"] for r in mixing.in_mixed_order(table).collect()] == near


def test_mixing_bounds_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 20)
    table = docs(spark, [(i, "t", "ab"[i % 4 == 0]) for i in range(1001)])
    got = sorted(mixing.schedule(table, {"a": 3.0, "b": 1.0}).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(1001)) and len({(r["source"], r["block"]) for r in got}) <= 20 + 2
    had = Counter()
    for t, r in enumerate(got[:900], 1):
        had[r["source"]] += 1
        assert abs(had["a"] - 0.75 * t) < 51  # rows of a block
    assert len({(r["source"], r["block"]) for r in mixing.schedule(table, block=7).collect()}) == -(-750 // 7) + -(-251 // 7)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    odd = ["<|startoftext|> A <|STARTOFTEXT|>x", "don't, won't.", "Ñandú! ÑANDÚ!!", "b́. İstanbul. ΣΑΣ, ς.", "a\x1cb c", "3.14, x-y_z~", "", "ﬁ, Ⅳ.", "many words " * 3000]
    rows = [(i, t, "x") for i, t in enumerate(odd)] + [(None, None, "x"), (3, odd[3], "x")]
    got = packing.pack(docs(spark, rows), path, with_ids=True).collect()
    tok = Tokenizer.from_file(path)
    for i, t in enumerate(odd):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        pieces = {r["start"]: r for r in got if r["doc_id"] == i}
        raw = b"".join(bytes(pieces[s]["ids"]) for s in sorted(pieces))
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == ids and all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) for p in pieces.values())
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 1 and packing.pack(docs(spark).limit(0), path).count() == 0


def collision(letters=1024):
    """Two words that a polynomial modulo a power of two can't tell apart."""
    a = "a"
    while len(a) < letters:
        a += a.translate({97: 98, 98: 97})
    return a, a.translate({97: 98, 98: 97})


def test_words_that_weak_hashes_confuse(spark):
    from tokenizers import Tokenizer

    a, b = collision()
    short = collision(128)  # hashed with all other words, not one by one
    assert all(len(set(shingles.word_hashes([x.encode() for x in pair])[0].tolist())) == 2 for pair in ((a, b), short))
    rows = [(1, a, "x"), (2, b, "x"), (3, short[0], "x"), (4, short[1], "x")]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    for r in packing.pack(docs(spark, rows), packing.tokenizer_path(), with_ids=True).collect():
        raw = bytes(r["ids"])
        assert r["doc_tokens"] > 4096 or list(struct.unpack(f"<{len(raw) // 4}I", raw)) == tok.encode(rows[r["doc_id"] - 1][1], add_special_tokens=False).ids + [2]
    assert all(r["kept"] for r in minhash.near_duplicates(docs(spark, rows)).collect())
    table = cut(docs(spark, rows), "test")
    assert {r["doc_id"]: r["n_known"] for r in lm.score(table, F.col("doc_id").isin(1, 3)).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}


@pytest.mark.parametrize("place", ["one group", "two groups"])
def test_packing_when_word_hashes_collide(monkeypatch, place):
    monkeypatch.setattr(packing, "span_hashes", lambda joined, starts, ends: (ends - starts).astype("uint64"))
    words_, texts = packing.WordIds(packing.tokenizer_path()), [b"one two six.", b"ten two!", b"four five"]
    got = [x for _, x in words_.encode_all(texts)] if place == "one group" else [next(words_.encode_all([t]))[1] for t in texts]
    assert [x.tolist() for x in got] == [words_._ids(t.decode()) for t in texts]


def test_words_of_long_texts():
    r = random.Random(5)
    texts = [b"", b" \t", b"A\x1cb c\td\x0be\x0cf\rg", b"x" * 70_000 + b" y " + b"x" * 70_000, b"w" * 2_500_000 + b" q", b" ".join(b"w%d" % r.randrange(999) for _ in range(400_000))]
    texts += [b" ".join(bytes(r.choice(b"abcAB\xc3\xa9") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(0, 400))) for _ in range(100)]
    hashes, counts = shingles.word_hashes(texts)
    want = [t.translate(shingles.LOWER).split() for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    of = dict(zip(flat, hashes.tolist()))
    assert [of[w] for w in flat] == hashes.tolist() and len(set(of.values())) == len(of)
    assert len(shingles.exact_shingles(texts[-1], 5)) == len({tuple(want[-1][i : i + 5]) for i in range(len(want[-1]) - 4)})


@pytest.mark.parametrize("seed", range(5))
def test_fill_is_closest(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 60): r.randrange(1, 4) for _ in range(6)}
    room = r.randrange(20, 150)
    sums = {0}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
    taken = packing.fill(counts, room)
    assert sum(k * v for k, v in taken.items()) == max(sums) and all(v <= counts[k] for k, v in taken.items())


def brute_components(rows, percent):
    sets = {}
    for i, t, _ in rows:
        w = words(t)
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_minhash_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(900 + k, t, "x") for k, t in enumerate(["", None, "A b", "a  B", "one"])] + [(None, "a b", "x")]
    n = 0
    for _ in range(4):  # hubs with copies of zero to six changed words: most pairs of copies aren't linked
        base = [r.choice(vocab) for _ in range(150)]
        for _ in range(60):
            w = list(base)
            for _ in range(r.randrange(0, 7)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((n, " ".join(w), "x"))
            n += 1
    rows += rows[6:9]
    got = minhash.near_duplicates(docs(spark, rows), percent=85).collect()
    want = brute_components(rows, 85)
    assert {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None} == want and len(got) == len(rows)
    kept = minhash.drop_near_duplicates(docs(spark, rows), percent=85)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, c in want.items() if i == c} | {None} and kept.columns == docs(spark).columns


def test_minhash_empty(spark):
    assert minhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def reference_scores(rows, train, order, strength):
    toks = [["<s>", *words(t), "</s>"] for _, t, _ in rows]
    n = [Counter() for _ in range(order + 1)]
    for w, use in zip(toks, train, strict=True):
        if use:
            for k in range(1, order + 1):
                n[k].update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    c = {k[0]: v for k, v in n[1].items() if k[0] != "<s>"}
    norm = sum(c.values()) + 0.1 * (len(c) + 1)
    out = []
    for w in toks:
        s = 0.0
        for j in range(1, len(w)):
            p = (c.get(w[j], 0) + 0.1) / norm
            for k in range(2, min(order, j + 1) + 1):
                h = tuple(w[j - k + 1 : j])
                if n[k - 1][h]:
                    p = (n[k][(*h, w[j])] + strength * p) / (n[k - 1][h] + strength)
            s += math.log10(p)
        out.append(s)
    return out, sum(c.values())


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_against_brute_force(spark, order):
    r = random.Random(order)
    rows = [(i, " ".join(r.choice(["The", "cat", "sat", "on", "a", "mat"]) for _ in range(r.randrange(0, 30))), "x") for i in range(60)] + [(60, None, "x"), (61, "unseen words", "x"), (None, "cat", "x")]
    table = cut(docs(spark, rows).repartition(3), "test")
    got = sorted(lm.score(table, crc_bucket(F.col("doc_id"), 10) != 0, order=order, strength=5.0).collect(), key=lambda x: (x["doc_id"] is None, x["doc_id"]))
    train = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0 for i, _, _ in rows]
    want, total = reference_scores(rows, train, order, 5.0)
    assert [x["doc_id"] for x in got] == [i for i, _, _ in rows] and all(x["train_tokens"] == total for x in got)
    assert all(abs(x["score"] - w) < 1e-6 for x, w in zip(got, want, strict=True)) and [x["held_out"] for x in got] == [not t for t in train]


def test_lm_of_long_texts_and_many_buckets(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: r.choice(["The", "cat", "sat", "on", "a", "mat"])
    rows = [(i, " ".join(word() for _ in range(n)), "x") for i, n in enumerate([0, 3, 255, 256, 257, 512, 5000, 20_000, 1, 300_000])] * 2
    monkeypatch.setattr(lm, "BUCKET_ROWS", 1)
    got = lm.score(cut(docs(spark, rows), "test"), F.lit(True)).collect()
    want, total = reference_scores(rows, [True] * len(rows), 2, lm.STRENGTH)
    assert len(got) == len(rows) and {(x["doc_id"], x["n_tokens"], round(x["score"], 3)) for x in got} == {(i, len(t.split()) + 1, round(s, 3)) for (i, t, _), s in zip(rows, want)}
    assert lm.score(cut(docs(spark).limit(0), "test"), F.lit(True)).count() == 0


def test_line_crf(spark):
    r = random.Random(1)
    line = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(99)) for _ in range(12)) + "."
    rows = [(i, "\n".join(line() if i % 2 else line().upper() + " !!" for _ in range(5)), "x") for i in range(80)] + [(80, None, "x"), (81, "", "x"), (None, line(), "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(5, None), (7, 1)], "doc_id long, quality int")
    model = line_crf.train(docs(spark, rows), labels, F.col("doc_id") < 60)
    got = {x["doc_id"]: x["score"] for x in line_crf.score(docs(spark, rows), model).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in range(60, 80)) and len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[80] == got[81]
    nothing = line_crf.train(docs(spark, rows), labels.limit(0), F.lit(True))
    assert {x["score"] for x in line_crf.score(docs(spark, rows), nothing).collect()} == {0.5}
    assert line_crf.score(docs(spark).limit(0), model).count() == 0


def test_crf_marginals_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    e, move = rng.normal(size=7), rng.normal(size=(2, 2))
    got, z, moved = line_crf.marginals(e, np.array([4, 3]), move)
    for start, n in ((0, 4), (4, 3)):
        total, good, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e[start + i] * y[i] for i in range(n)) + sum(move[a, b] for a, b in itertools.pairwise(y)))
            total += w
            good += w * np.array(y)
            for a, b in itertools.pairwise(y):
                steps[a, b] += w
        assert np.allclose(got[start : start + n], good / total) and np.allclose(moved[start // 4], steps / total) and math.isclose(z[start // 4], math.log(total))


def test_json_safe_results(spark):
    assert json.dumps([r.asDict() for r in exact_dedup.exact_duplicates(docs(spark)).collect()])


#: Two words that a polynomial hash of two residues with fixed bases takes for one.
ALIKE = ("nmonmmmmommoommmmmpomnmmnmmmm", "mnmmpmmmnmmmnnmnnmmmnonmnmmm")


def alike_pairs():
    five = "one two three four five "
    return [(1, ALIKE[0]), (2, ALIKE[1]), (3, five + ALIKE[0]), (4, five + ALIKE[1]), (5, ALIKE[0].upper())]


@pytest.mark.parametrize("constant", [False, True])
def test_words_told_apart_by_bytes(spark, monkeypatch, constant):
    from cargolens.llm import minhash, shingles

    if constant:  # every word has one hash: only bytes tell them apart
        monkeypatch.setattr(shingles, "span_hashes", lambda joined, starts, ends: np.zeros(len(starts), np.uint64))
    texts = [t.encode() for _, t in alike_pairs()]
    found, n = shingles.word_hashes(texts)
    assert n.tolist() == [1, 1, 6, 6, 1] and found[0] == found[7] == found[-1] != found[1] == found[13]
    sets = [set(s.tolist()) for s in shingles.shingle_sets(texts, 5)]
    assert sets[0] != sets[1] and sets[0] == sets[4] and len(sets[2] & sets[3]) == 1
    if not constant:
        d = spark.createDataFrame(alike_pairs(), "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(d, percent=85).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_exact_duplicates_hash_survivors_only(spark):
    """Each way (by the number of shared lengths, prefixes and groups) keeps the same rows; without a shared prefix no text is hashed."""
    r = random.Random(5)
    rows = [(i, r.choice(["same beginning " * 6 + "x" * r.randrange(3), None, "", f"text {r.randrange(300)}", "word " * r.randrange(9)]), "x") for i in range(900)]
    last = {}
    for i, t, _ in rows:
        last[t or ""] = i
    for limit in (0, 1, 5, 100_000):
        kept = exact_dedup.drop_exact_duplicates(docs(spark, rows), broadcast_rows=limit)
        assert sorted(x["doc_id"] for x in kept.collect()) == sorted(last.values())
        got = {x["doc_id"]: (x["keep_id"], x["text_sha256"]) for x in exact_dedup.exact_duplicates(docs(spark, rows), broadcast_rows=limit).collect()}
        assert got == {i: (last[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
    hashed = exact_dedup._judged(docs(spark, [(1, "ab", "x"), (2, "cd", "x"), (3, "abc", "x"), (4, "ab", "x")]), "doc_id", "text", 64, 100_000, False)
    assert {x["doc_id"] for x in hashed.collect() if x["__dedup_hash"].startswith("~")} == {2, 3}


def test_warc_lost_payloads_and_names(spark, tmp_path):
    rows = [(i, f"http://{i}", f"<p>{i % 10}</p>" * 200) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    others = spark.createDataFrame([(1, "http://other", "own")], "page_id long, url string, html string")
    before = len(spark.catalog.listTables())
    for parent, table in (("x", pages), ("y", others)):  # two archives whose paths end alike
        warc.write_archive(table, str(tmp_path / parent / "a"))
    assert [bytes(r["payload"]) for r in warc.read_archive(spark, str(tmp_path / "y/a")).collect()] == [b"own"]
    assert len(spark.catalog.listTables()) == before
    whole = warc.read_archive(spark, str(tmp_path / "x/a")).collect()
    assert len(whole) == 20 and all(r["verified"] for r in whole)
    lost = sorted((tmp_path / "x/a/payloads").glob("*.parquet"))[0]
    gone = {r["address"] for r in spark.read.parquet(str(lost)).select("address").collect()}
    lost.rename(tmp_path / "elsewhere")
    back = {r["id"]: r for r in warc.read_archive(spark, str(tmp_path / "x/a")).collect()}
    missing = {i for i, _, html in rows if hashlib.sha256(html.encode()).hexdigest() in gone}
    assert missing and len(back) == 20 and {i for i, r in back.items() if not r["verified"]} == missing
    for i in missing:
        assert back[i]["payload_digest"] is None and back[i]["payload_bytes"] is None and back[i]["url"] == f"http://{i}" and (back[i]["record"] is None) == (back[i]["record_type"] == "response")


@pytest.mark.parametrize("bound", [0, 2])
def test_warc_of_many_addresses(spark, tmp_path, monkeypatch, bound):
    """Addresses beyond the broadcast's bound, and hot ones, give the same records."""
    rows = [(i, f"http://{i}", "small" if i % 3 else f"<p>{i % 4}</p>" * 200) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "plain"))
    want = sorted(map(str, warc.read_archive(spark, str(tmp_path / "plain")).drop("record").collect()))
    from cargolens.llm import common

    for module in (warc, common):
        monkeypatch.setattr(module, "HOT_ROWS", 3)
    monkeypatch.setattr(warc, "ADDRESSES", bound)
    warc.write_archive(pages, str(tmp_path / "forced"))
    assert sorted(map(str, warc.read_archive(spark, str(tmp_path / "forced")).drop("record").collect())) == want
