"""The prefix trie against plain loops over all prefixes."""

import hashlib
import os
import random
import zlib

import pytest

from cargolens.llm import prefix_trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, key string, place string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def plain_trie(convs):
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids, total, leaves = {p: 0 for p in members}, {p: 0 for p in members}, {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            total[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = {}
    for c, seq in convs.items():
        ends.setdefault(tuple(seq), []).append(c)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], total[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()
    )


def result(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect())


def odd_rows(seed, convs, longest, texts=3):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(350), convs):
        for t in range(r.randrange(1, longest)):
            out.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None, ""]), r.choice(["é" * 3, "b", None, "dd"][:texts])))
    return [*out, (None, 1, "user", "no conversation")]


@pytest.mark.parametrize("seed, longest, texts, block", [(1, 9, 2, 64), (2, 12, 4, 1), (3, 20, 1, 3), (4, 3, 1, 64)])
def test_against_plain_loops(spark, seed, longest, texts, block, monkeypatch):
    if block < 64:
        from cargolens.llm import common

        monkeypatch.setattr(prefix_trie, "CHUNK", 7)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = odd_rows(seed, 150, longest, texts)
    data = spark.createDataFrame([(*x, "a", "b", 1) for x in rows], SCHEMA).repartition(5)
    assert result(prefix_trie.trie(*prefix_trie.rebuilt(data), block_turns=block)) == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("rows_at_once", [0, 100])
def test_large_tables_way(spark, rows_at_once, monkeypatch):
    """Nothing, or little, is broadcast: the joins that large tables take give the same rows."""
    from cargolens.llm import common

    rows = odd_rows(6, 200, 7, 1)
    data = spark.createDataFrame([(*x, "a", "b", 1) for x in rows], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(common, "HOT_ROWS", 5)
        m.setattr(common.small, "__defaults__", (rows_at_once,))
        m.setattr(common.spread_join, "__defaults__", (rows_at_once,))
        got = result(prefix_trie.trie(*prefix_trie.rebuilt(data)))
    assert got == plain_trie(plain_rebuilt(rows))


def test_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"same {t}") for c in range(1000, 1600) for t in range(4)]
    rows += [(7, t, "user", f"{t % 5}") for t in range(700)] + [(8, t, "user", f"{t % 5}") for t in range(690)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert result(prefix_trie.trie(*prefix_trie.rebuilt(data))) == plain_trie(plain_rebuilt(rows))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(prefix_trie.op13_prefix_trie(spark, SF)) == plain_trie(plain_rebuilt(rows))
