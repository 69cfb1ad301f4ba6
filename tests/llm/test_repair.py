"""Conversation repair against plain loops, and these against every sequence of edits."""

import hashlib
import os
import random
import re
import zlib
from itertools import product

import pytest

from cargolens.llm import repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, kept string, place int"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
FOLLOW = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", **{(s, ""): s for s in ("", "s", "u", "a")}}


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(code, 1))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return {c: sorted(v, key=key) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_edits(rows, found):
    """(cost, audit) by a table of plain strings."""
    ways = {"": (0, "")}
    for (_, role, _), fault in [*zip(rows, found), ((0, "", ""), None)]:
        for _ in range(3):
            for (a, i), b in FOLLOW.items():
                if i in ("u", "a") and a in ways:
                    ways[b] = min(ways.get(b, (1 << 60, "")), (ways[a][0] + 2, ways[a][1] + "I"))
        if fault is None:
            break
        after = {}
        for state, (cost, audit) in ways.items():
            options = [(state, 3, "D")]
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                options += [(FOLLOW[state, i], (2 if e == "R" else 0) + late, e) for i, e in ((role[:1], "K"), ("u", "R"), ("a", "R")) if (state, i) in FOLLOW]
            for to, more, e in options:
                after[to] = min(after.get(to, (1 << 60, "")), (cost + more, audit + e))
        ways = after
    return min(ways[s] for s in ("", "a") if s in ways)


def every_edit(rows, found):
    """(cost, audit) of the best of all sequences with at most two inserts in a row."""
    best = (1 << 60, "")
    inserts = [x for n in range(3) for x in product("ua", repeat=n)]
    for ops in product("KUAD", repeat=len(rows)):
        if any(o != "D" and f in ("blank", "duplicate") for o, f in zip(ops, found)):
            continue
        for ins in product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = list(ins[0]), "I" * len(ins[0]), 2 * len(ins[0])
            for o, f, (_, role, _), more in zip(ops, found, rows, ins[1:]):
                if o != "D":
                    roles.append(role[:1] if o == "K" else o.lower())
                    cost += (0 if o == "K" else 2) + (f == "truncated")
                cost += 3 * (o == "D") + 2 * len(more)
                audit += {"U": "R", "A": "R"}.get(o, o) + "I" * len(more)
                roles += more
            if (cost, audit) < best and re.fullmatch("(s?(ua)+)?", "".join(roles)):
                best = (cost, audit)
    return best


def plain_result(rows, edits=plain_edits):
    found, turns = faults(rows), {t for t, _, _ in rows if t is not None}
    cost, audit = edits(rows, found)
    out, state, left = [], "", iter(rows)
    for e in audit:
        role, text = ("", "") if e == "I" else next(left)[1:]
        if e in "RI":
            role = "assistant" if state == "u" else "user"
        if e != "D":
            state = role[:1] or state
            out.append(f"{role}:{text}")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return [gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()]


def odd_rows(seed, convs, longest):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ünd"], ["Yes.", "No", "Well!", "", " \n", None, "Why? ", "a.b", "é!\t", "No."]
    out = []
    for c in range(convs):
        for t in range(r.randrange(1, longest)):
            out.append((c if c % 9 else None, r.choice([t, t, t, t + 3, None, -t]), r.choice(roles[: r.choice([2, 3, 9])]), r.choice(texts)))
    return out


def compared(spark, rows, **args):
    data = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(5)
    got = {r["conv_id"]: [r[c] for c in COLUMNS] for r in repair.repair(repair.damaged(data), **args).collect()}
    assert got == {c: plain_result(v) for c, v in plain_damage(rows).items()}


def test_plain_table_against_every_edit():
    for rows in plain_damage(odd_rows(1, 150, 4)).values():
        if len(rows) <= 3:
            assert plain_edits(rows, faults(rows)) == every_edit(rows, faults(rows))


@pytest.mark.parametrize("seed, block", [(2, None), (3, 1), (4, 3)])
def test_against_plain_loops(spark, seed, block):
    compared(spark, odd_rows(seed, 120, 14), block_rows=block)


@pytest.mark.parametrize("block", [None, 50])
def test_long_conversation(spark, block):
    """One conversation with most rows, over many partitions and blocks."""
    r = random.Random(7)
    rows = odd_rows(5, 20, 6) + [(77, t, r.choice(["user", "assistant", "system"]), r.choice(["A.", "B", "", f"{t}!", f"{t}", f"{t}?"])) for t in range(2500)]
    compared(spark, rows, block_rows=block)


def test_prefixes_whose_hashes_collide(monkeypatch):
    r = random.Random(3)
    blocks = [[(r.choice("suax"), r.random() < 0.2, r.random() < 0.4) for _ in range(r.randrange(0, 40))] for _ in range(60)]
    want = [repair.block_ways(b, [0, 1, 2, 3]) for b in blocks]
    monkeypatch.setattr(repair.Audits, "_roll", staticmethod(lambda h, letter: 1))
    assert [repair.block_ways(b, [0, 1, 2, 3]) for b in blocks] == want


def test_order_of_edit_strings():
    r, audits, nodes = random.Random(4), repair.Audits(), {}
    for _ in range(300):
        text, node = "".join(r.choice("DK") for _ in range(r.randrange(0, 12))), 0
        for c in text:
            node = audits.extend(node, c)
        assert nodes.setdefault(text, node) == node and audits.text(node) == text
    assert all(audits.less(x, y) == (a < b) for a, x in nodes.items() for b, y in nodes.items())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: [r[c] for c in COLUMNS] for r in repair.op12_conversation_repair(spark, SF).collect()}
    want = plain_damage(rows)
    assert got == {c: plain_result(v) for c, v in want.items()} and any(not v for v in want.values()) is any(x[6] == "" for x in got.values())
