"""Personal data, secrets, the classifier and its folds, and the pipeline against plain loops over the same texts."""

import hashlib
import itertools
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cargolens.llm import line_crf, pii, queries, quality_rules, secrets

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
EXTRA = "doc_id long, text string, source string"


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_pii(text):
    """(kind, start, end) of the base kinds."""
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((0, "email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, "ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, "card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, "phone", m))
    return out


def plain_secrets(text):
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), t):
        if len(m.group(2)) >= 6:
            out.append((0, "assign", m))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m.group()) >= 20:
            out.append((1, "access", m))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m.group()) >= 24:
            out.append((2, "hex", m))
    return out


def stated(found):
    order = sorted((m.start(), k, name, m.end()) for k, name, m in found)
    return Counter(name for _, _, name, _ in order), hashlib.sha256(",".join(f"{name}:{a}:{b}" for a, _, name, b in order).encode()).hexdigest()


PIECES = ["bob@x.com", "a.b@c-d.e.f", "@x.com", "a@b", "10.0.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "000000000000", "+1 (555) 555-0100", "+49 30 901820", "+1 2", "é", "\U0001f600", "\n", " ", "  ", "12", "-", "."]
SECRETS = ["password = hunter22", "PassWord:'abc'", "token=\"abcdef.123\"", "api_key : x+/=y_z-", "apikey=12345", "secretsecret=abcdefg", "AKIA" + "Q" * 16, "AKIAQ", "AKIA" + "Z9" * 30, "0123456789abcdef01234567", "0123456789abcdef0123456", "ABCDEF0123456789abcdef01", "deadbeef" * 5, "é", "\U0001f600", " ", "\n", ":", "="]


def mixed(pieces, seed, n):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice(pieces) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(0, 25))), "x") for i in range(n)]
    long = "".join(r.choice(pieces) + " " for _ in range(8000))
    return [*rows, (n, None, "x"), (n + 1, "", "x"), (n + 2, long, "x"), (0, rows[0][1], "x"), (None, rows[1][1], "x")]


def compared(spark, query, rows, plain, kinds, tmp_path):
    spark.createDataFrame(rows, EXTRA).withColumns({c: F.lit("own") for c in ("spans", "email", "assign", "row", "start")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["base_sha256"], *(r[f"n_{k}"] for k in kinds)) for r in query(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t, _ in rows:
        n, digest = stated(plain(t))
        want[i, digest, *(n[k] for k in kinds)] += 1
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_pii_against_plain_expressions(spark, seed, tmp_path):
    compared(spark, pii.op5_pii, mixed(PIECES, seed, 150), plain_pii, pii.BASE, tmp_path)


@pytest.mark.parametrize("seed", range(2))
def test_secrets_against_plain_expressions(spark, seed, tmp_path):
    compared(spark, secrets.op8_secrets, mixed(SECRETS, seed, 150), plain_secrets, secrets.STRONG, tmp_path)


@needs_tables
@pytest.mark.parametrize("name, plain, kinds", [("op5_pii", plain_pii, pii.BASE), ("op8_secrets", plain_secrets, secrets.STRONG)])
def test_scans_of_documents(spark, name, plain, kinds):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.queries()[name](spark, SF).collect():
        n, digest = stated(plain(texts[r["doc_id"]]))
        assert (digest, [n[k] for k in kinds]) == (r["base_sha256"], [r[f"n_{k}"] for k in kinds])


def test_context_of_many_spans(spark):
    """Words near a span count wherever it stands in a long text of very many spans."""
    many = "".join(f"{i} é 555-01{i % 100:02d} \n" for i in range(30_000))
    text = many + "SSN: 123-45-6789 " + many
    r = pii.find_pii(spark.createDataFrame([(1, text, "x")], EXTRA)).first()
    assert [(text[x["start"] : x["end"]], x["score"] > 0.5) for x in r["national_id"]] == [("123-45-6789", True)]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], EXTRA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


@needs_tables
def test_classifier_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in line_crf.op1_quality_classifier(spark, sf).collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) > 20 and sum(a == b for a, b in got) >= 0.95 * len(got)


def test_long_texts_of_rules_and_classifier(spark):
    line = "This is one of very many lines of a long but clean text, number "
    long = "\n".join(f"{line}{i}." for i in range(40_000))
    rows = [(1, long, "x"), (2, "word " * 300_000, "x"), (3, None, "x")]
    d = spark.createDataFrame(rows, EXTRA)
    got = {r["doc_id"]: r for r in quality_rules.ledger(d).collect()}
    assert got[1]["n_words"] == 40_000 * 15 and got[1]["n_dup_lines"] == 0 and got[2]["n_repeat_words"] == 300_000 and got[3]["n_words"] == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = line_crf.train(d, labels, F.lit(True), lines=10)  # no text fits: nothing is learned
    assert {r["score"] for r in line_crf.score(d, model).collect()} == {0.5}


def test_a_long_labelled_text_leaves_the_others(spark):
    """A labelled text beyond the sample's bound is passed over alone, whatever its place by hash."""
    rows = [(i, ("All lines of it are fine.\n" if i % 2 else "## $$ %% BUY\n") * (5 + i), "x") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1) for i in range(100, 104)], "doc_id long, quality int")
    short = line_crf.train(spark.createDataFrame(rows, EXTRA), labels, F.lit(True), lines=2000)
    long = [(i, "very\n" * 2001, "x") for i in range(100, 104)]
    model = line_crf.train(spark.createDataFrame([*rows, *long], EXTRA), labels, F.lit(True), lines=2000)
    assert all((a == b).all() for a, b in zip(short, model)) and abs(model[0]).max() > 0.1


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_pipeline(rows, good):
    """Ids that rules, exact and near deduplication leave, by comparing every two texts."""
    left = [(i, t) for i, t, _ in rows if i in good]
    last = {}
    for i, t in left:
        last[t or ""] = max(i, last.get(t or "", i))
    left = [(i, t) for i, t in left if last[t or ""] == i]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in ((i, words(t)) for i, t in left)}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {i for i in sets if root(i) == i}


@needs_tables
def test_pipeline_against_plain_loops(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    r = random.Random(3)
    for i in range(40):  # more copies, near and exact
        t = r.choice(rows)[1] or ""
        w = t.split(" ")
        if i % 2 and len(w) > 120:
            w[r.randrange(len(w))] = "changed"
        rows.append((100_000 + i, " ".join(w), "late"))
    spark.createDataFrame(rows, EXTRA).write.parquet(str(tmp_path / "documents.parquet"))
    bits = quality_rules.ledger(spark.createDataFrame(rows, EXTRA)).filter(quality_rules.passes()).select("doc_id").collect()
    want = plain_pipeline(rows, {x["doc_id"] for x in bits})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} == want and len(want) < len(rows)
    tok, texts = Tokenizer.from_file(corpus_pipeline.tokenizer_path()), {i: t for i, t, _ in rows}
    for i in random.Random(4).sample(sorted(want), 40):
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        pieces = sorted((x for x in got if x["doc_id"] == i), key=lambda x: x["start"])
        assert sum(x["length"] for x in pieces) == len(ids)
        assert all(x["ids_crc32"] == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids[x["start"] : x["start"] + x["length"]])) for x in pieces)


def plain_lines(text):
    """Features of a text's lines, counted one by one."""
    owns, seen = [], set()
    for line in text.encode().split(b"\n"):
        kinds = {k: sum(c in chars for c in line) for k, chars in line_crf.CLASSES.items()}
        w = re.findall(rb"[^\x20\x09-\x0d]+", line)
        n, one, letters = len(w), max(len(line), 1), kinds["upper"] + kinds["lower"] + 1
        owns.append(
            [kinds["upper"] / letters, kinds["symbol"] / one, kinds["bar"] / (n + 1), kinds["shout"] / (n + 1), kinds["digit"] / one, kinds["other"] / one, kinds["stop"] / (n + 1), kinds["blank"] / one]
            + [sum(a == b for a, b in zip(w, w[1:])) / max(n, 1), math.log1p(n) / 6, min(len(line) / max(n, 1), 30) / 10, line[-1:] in (b".", b"?"), bool(w) and tuple(w) in seen, n < 3, kinds["symbol"] > n]
        )
        seen.add(tuple(w))
    none = [0] * line_crf.N_OWN
    return [[1, *own, *(owns[k - 1] if k else none), *(owns[k + 1] if k + 1 < len(owns) else none), k == 0, k + 1 == len(owns)] for k, own in enumerate(owns)]


def plain_score(text, weights, move):
    """The score by going through every labelling of the lines."""
    e = np.array(plain_lines(text), float) @ weights
    size = [len(x) + 1 for x in text.encode().split(b"\n")]
    good, total = 0.0, 0.0
    for labels in itertools.product((0, 1), repeat=len(e)):
        p = math.exp(sum(v for v, y in zip(e, labels) if y) + sum(move[a, b] for a, b in zip(labels, labels[1:])))
        total += p
        good += p * sum(s for s, y in zip(size, labels) if y) / sum(size)
    return good / total


PIECES = ["", "  ", "A b c.", "#$ BUY!! | now", "some words, here here here", "é x 12?", "same line", "A b  c.", "same line", "\t tab\x0b."]


@pytest.mark.parametrize("long_lines, stretch", [(2048, 1 << 16), (2, 7), (3, 40), (1, 1)])
def test_classifier_scores_by_all_labellings(spark, monkeypatch, long_lines, stretch):
    """Scores equal sums over all labellings, whether texts are scored at once or in blocks and stretches."""
    r, g = random.Random(3), np.random.default_rng(3)
    weights, move = g.normal(size=line_crf.N_FEATURES), g.normal(size=(2, 2))
    texts = ["", "\n", "one", *("\n".join(r.choice(PIECES) for _ in range(r.randrange(1, 10))) for _ in range(60))]
    monkeypatch.setattr(line_crf, "LONG_LINES", long_lines)
    monkeypatch.setattr(line_crf, "STRETCH", stretch)
    got = pd.concat(line_crf._scorer(weights, move)(iter([pd.DataFrame({"id": range(len(texts)), "text": texts})])))
    assert got["lines"].tolist() == [t.count("\n") + 1 for t in texts]
    assert got["score"].tolist() == pytest.approx([plain_score(t, weights, move) for t in texts], abs=1e-9)


def test_classifier_of_very_many_lines():
    """A text of line ends, in blocks, in bounded memory, scores as the passes over all its lines."""
    g = np.random.default_rng(4)
    weights, move = g.normal(size=line_crf.N_FEATURES), g.normal(size=(2, 2))
    for text in (b"\n" * 9_000, b"a b.\n#!\n" * 5_000):
        x, size, lines = line_crf.line_features([text])
        good, _, _ = line_crf.marginals(x @ weights, lines, move)
        assert line_crf.long_score(text, weights, move) == (lines[0], pytest.approx(good @ (size + 1) / (size + 1).sum(), abs=1e-9))
    tracemalloc.start()
    assert line_crf.long_score(b"\n" * 3_000_000, weights, move)[0] == 3_000_001
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
