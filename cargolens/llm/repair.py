"""Structure repair of conversations: the cheapest edits that make roles alternate, with the least audit of all such.

Rows are numbered by turn and dealt in blocks of consecutive rows. A block's dynamic program goes through its rows with
four states of the repaired roles (none yet, system, user, assistant) from every state in which it may begin, and keeps
for each pair of states the cheapest edits and, of equally cheap ones, the ASCII-least. Edit strings are linked nodes that
share their prefixes: a node has its parent, its letter, ancestors at powers of two and a rolling hash by which an equal
prefix is found again. A found node counts only if its parent and letter are the same, so colliding hashes can't merge
two prefixes and equal prefixes are one node. Two strings are compared by lifting both to where they part.

Blocks compose: a conversation's result is that of its blocks in order, so a long conversation is many blocks in many
tasks. Its repaired text is hashed as its rows stream by, holding the edits (one letter each) and one row.

Faults and edits: a blank row has no character but white space; a duplicate has the role and text of an earlier row; a
truncated one doesn't end in ``.``, ``!`` or ``?``; the first that holds counts. Keep costs 0, Rerole 2, Delete 3, Insert 2, and
truncated rows that stay 1; blank and duplicate rows must go. Roles count by their first letter; an empty role
has none and may stay anywhere.

Defined results: a null role or text is one space (the row is then blank, or its role is no known one); a null turn comes
first; a null conv_id is a conversation of its own. Rows of one turn come by role, then by a digest of role and text. A
conversation without rows has zeros, no audit and the hash of the empty text. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, ship, small
from .turns import SQL_CRC, numbered, sql_crc32

#: Rows of a block.
BLOCK_ROWS = 1024
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_WHITE = " \t\n\v\f\r"
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, by state before; roles that may not follow are absent.
_AFTER = {"": {k: k for k in range(4)}, "s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT = 2, 3, 2


class Audits:
    """Edit strings as linked nodes; node 0 is the empty string, and equal strings are one node."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]
        self.found: dict[int, list[int]] = {}

    def extend(self, node: int, letter: str) -> int:
        h = self._roll(self.hash[node], letter)
        same = self.found.setdefault(h, [])
        for k in same:
            if self.up[k][0] == node and self.letter[k] == letter:
                return k
        k, ups = len(self.letter), [node]
        while len(self.up[ups[-1]]) >= len(ups):  # the ancestor 2^i up is the one 2^(i-1) up of the one 2^(i-1) up
            ups.append(self.up[ups[-1]][len(ups) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(h)
        self.up.append(tuple(ups))
        same.append(k)
        return k

    @staticmethod
    def _roll(h: int, letter: str) -> int:
        return (h * _BASE + ord(letter)) % _PRIME

    def _lift(self, node: int, steps: int) -> int:
        while steps:
            k = steps.bit_length() - 1
            node, steps = self.up[node][k], steps - (1 << k)
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lift(a, self.depth[a] - depth), self._lift(b, self.depth[b] - depth)
        if x == y:  # one begins with the other
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.up[x][k] != self.up[y][k]:
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]  # their parents are the longest common prefix

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _offer(ways: dict, state: int, cost: int, node: int, letter: str, audits: Audits) -> None:
    have = ways.get(state)
    if have is None or cost < have[0]:
        ways[state] = (cost, audits.extend(node, letter))
    elif cost == have[0] and audits.less(new := audits.extend(node, letter), have[1]):
        ways[state] = (cost, new)


def block_ways(rows: list[tuple[str, bool, bool]], starts: list[int]) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of the best edits of rows (initial, must go, truncated), inserts after the last row left out."""
    audits, out = Audits(), []
    for start in starts:
        ways = {start: (0, 0)}
        for initial, must_go, truncated in rows:
            for a, b in ((NOTHING, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
                if a in ways:
                    _offer(ways, b, ways[a][0] + INSERT, ways[a][1], "I", audits)
            after: dict[int, tuple[int, int]] = {}
            for state, (cost, node) in ways.items():
                _offer(after, state, cost + DELETE, node, "D", audits)
                if not must_go:
                    kept = _AFTER.get(initial, {}).get(state)
                    if kept is not None:
                        _offer(after, kept, cost + truncated, node, "K", audits)
                    _offer(after, ASSISTANT if state == USER else USER, cost + REROLE + truncated, node, "R", audits)
            ways = after
        out += [(start, state, cost, audits.text(node)) for state, (cost, node) in sorted(ways.items())]
    return out


_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_COUNTS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns"]
_BLOCK = "ways array<struct<start:int,end:int,cost:bigint,audit:string>>, n_rows long, blank long, duplicate long, truncated long, illegal long, n_turns long, low long, high long, first string, last string"


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != at:
                yield at, held
                held = []
            at = row[:keys]
            held.append(row)
    if held:
        yield at, held


def _summaries(id_type: pa.DataType):
    """One row per block of rows: its counts and its best edits by states before and after."""
    schema = pa.schema([("conv_id", id_type), ("block", pa.int64()), ("ways", _WAYS), *((c, pa.int64()) for c in [*_COUNTS, "low", "high"]), ("first", pa.string()), ("last", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv_id, block), rows in _runs(batches, 2):
            rows = [r for r in rows if r[3]]  # dropped rows only tell that the conversation is there
            turns = [r[4] for r in rows if r[4] is not None]
            initials = [r[5] for r in rows]
            faults = [r[6] for r in rows]
            ways = block_ways([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)], [NOTHING] if block == 0 else [NOTHING, SYSTEM, USER, ASSISTANT])
            out.append({
                "conv_id": conv_id, "block": block, "ways": [dict(zip(("start", "end", "cost", "audit"), w, strict=True)) for w in ways], "n_rows": len(rows),
                **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
                "n_turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "first": initials[0] if rows else None, "last": initials[-1] if rows else None,
            })
            if len(out) == 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


class _Conversation:
    """Blocks of a conversation in order, then its rows in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.ways, self.counts = conv_id, {NOTHING: (0, "")}, dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.last = self.audit = None

    def block(self, b: dict) -> None:
        ways: dict[int, tuple[int, str]] = {}
        for w in b["ways"]:
            if w["start"] in self.ways:
                cost, audit = self.ways[w["start"]]
                ways[w["end"]] = min(ways.get(w["end"], (1 << 62, "")), (cost + w["cost"], audit + w["audit"]))
        self.ways = ways
        for c in _COUNTS:
            self.counts[c] += b[c]
        if self.last is not None and b["first"] is not None:
            self.counts["illegal"] += self.last + b["first"] not in _LEGAL
        if self.high is not None and b["low"] == self.high:
            self.counts["n_turns"] -= 1
        self.low = b["low"] if self.low is None else self.low
        self.high = self.high if b["high"] is None else b["high"]
        self.last = self.last if b["last"] is None else b["last"]

    def edits(self) -> None:
        ends = [(cost + len(more) * INSERT, audit + more) for state, more in ((NOTHING, ""), (SYSTEM, "II"), (USER, "I"), (ASSISTANT, "")) if state in self.ways for cost, audit in [self.ways[state]]]
        self.cost, self.audit = min(ends)
        self.at, self.state, self.hash, self.written = 0, NOTHING, hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.written else "") + role + ":" + text).encode())
        self.written = True

    def _put(self) -> str:
        """The role that comes next where none is given."""
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._write(self._put(), "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _AFTER[role[:1]][self.state]
            self._write(role, text)
        elif edit == "R":
            self._write(self._put(), text)

    def result(self) -> dict:
        if self.audit is None:
            self.edits()
        self._inserts()
        c, gaps = self.counts, 0 if self.low is None else self.high - self.low + 1 - self.counts["n_turns"]
        return {"conv_id": self.conv_id, "gaps": gaps, **{k: c[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


def _results(id_type: pa.DataType):
    """One row per conversation, from its blocks and its rows, sorted in this order."""
    schema = pa.schema([("conv_id", id_type), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, now = [], 0, None
        for batch in batches:
            for conv_id, is_row, _, block, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.result())
                        size += 200 + len(now.audit)
                    now = _Conversation(conv_id)
                if not is_row:
                    now.block(block)
                else:
                    if now.audit is None:
                        now.edits()
                    now.row(role, text)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if now is not None:
            out.append(now.result())
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, kept: rows damaged by crc32(``conv_id:turn``) % 20. Dropped rows stay, without text, as kept = false."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", code.alias("code"))
    copies = F.explode(F.array_repeat(F.col("code") != 0, F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), copies.alias("kept"))


def repair(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, and kept, false for rows that only state that the conversation is there)."""
    ship(rows.sparkSession)
    block_rows = block_rows or BLOCK_ROWS
    conv = dict(rows.dtypes)["conv_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[conv]
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = numbered(rows.select("conv_id", "turn", "role", "text", "kept", mark.alias("mark")), "conv_id", ["turn", "role", "mark"], "repair-rows")
    # which row of equal ones comes first, of those that repeat
    firsts = placed.filter("kept").groupBy(F.col("conv_id").alias("f_conv"), F.col("mark").alias("f_mark")).agg(F.min("place").alias("f_place"), F.count("*").alias("n")).filter("n > 1").drop("n")
    ended = F.rtrim(F.col("text"), F.lit(_WHITE))
    fault = F.when(ended == "", "blank").when(F.col("place") > F.col("f_place"), "duplicate").when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    told = placed.join(small(cut(firsts, "repair-repeats")), F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("mark") == F.col("f_mark")), "left")
    narrow = told.select("conv_id", F.floor(F.col("place") / block_rows).alias("block"), "place", "kept", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    blocks = narrow.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place").mapInArrow(_summaries(id_type), f"conv_id {conv}, block long, {_BLOCK}")
    packed = F.struct(*(c for c in blocks.columns if c not in ("conv_id", "block")))
    none = blocks.select(packed.alias("b")).schema["b"].dataType
    stream = blocks.select("conv_id", F.lit(False).alias("is_row"), F.col("block").alias("place"), packed.alias("b"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    stream = stream.unionByName(placed.filter("kept").select("conv_id", F.lit(True).alias("is_row"), "place", F.lit(None).cast(none).alias("b"), "role", "text"))
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "place").mapInArrow(_results(id_type), f"conv_id {conv}, {RESULT}")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read_table(spark, sf_dir, "conversations")))


def _least(*ways: str) -> str:
    """The least of SQL structs of cost, audit and repaired text; null if all are."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _with(way: str, cost: str, letter: str, line: str) -> str:
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 'r': {way}.r || {line}}} END"


def _sql() -> str:
    put = {k: f"'{role}:' || chr(10)" for k, role in (("u", "user"), ("a", "assistant"))}
    line = {"u": "'user:' || text || chr(10)", "a": "'assistant:' || text || chr(10)", "k": "role || ':' || text || chr(10)"}
    stays = "(f = 'truncated')::INT"

    def after(state: int, source: dict) -> str:
        own = source[state]
        before = {SYSTEM: [NOTHING], USER: [NOTHING, SYSTEM, ASSISTANT], ASSISTANT: [USER]}.get(state, [])
        kept = [f"CASE WHEN i = '{' sua'[state]}' AND f NOT IN ('blank', 'duplicate') THEN {_with(source[b], stays, 'K', line['k'])} END" for b in before]
        kept.append(f"CASE WHEN i = '' AND f NOT IN ('blank', 'duplicate') THEN {_with(own, stays, 'K', line['k'])} END")
        moved = [f"CASE WHEN f NOT IN ('blank', 'duplicate') THEN {_with(source[b], f'{REROLE} + {stays}', 'R', line[' sua'[state]])} END" for b in before if state != SYSTEM]
        return _least(_with(own, str(DELETE), "D", "''"), *kept, *moved)

    names = {k: f"q{k}" for k in range(4)}
    closed = f"SELECT *, {_least('m2', _with('m3', str(INSERT), 'I', put['u']))} AS w2 FROM (SELECT *, {_least('q3', _with('m2', str(INSERT), 'I', put['a']))} AS m3 FROM (SELECT *, {_least('q2', _with('q0', str(INSERT), 'I', put['u']), _with('q1', str(INSERT), 'I', put['u']))} AS m2 FROM SOURCE))"
    source = {**names, USER: "w2", ASSISTANT: "m3"}
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR))"
    return f"""WITH RECURSIVE {SQL_CRC},
  shown AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
  coded AS (SELECT shown.*, {sql_crc32("k")} % 20 AS code FROM shown, crc_table),
  copies AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
  marked AS (SELECT *, sha256(length(role) || ':' || role || text) AS mark, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended FROM copies),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, mark, copy) AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, mark, copy) AS seen, left(role, 1) AS i FROM marked),
  judged AS (SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f,
    lag(i) OVER (PARTITION BY conv_id ORDER BY place) || i AS pair FROM placed),
  counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
  walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS place, CAST({{'c': 0, 'a': '', 'r': ''}} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)) AS q0, {none} AS q1, {none} AS q2, {none} AS q3 FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT conv_id, place, {', '.join(after(k, source) for k in range(4))} FROM ({closed.replace("SOURCE", "(SELECT walk.conv_id, j.place, q0, q1, q2, q3, j.role, j.text, j.i, j.f FROM walk JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM walk.conv_id AND j.place = walk.place + 1)")})),
  ended AS (SELECT conv_id, {_least('q0', 'm3')} AS best FROM ({closed.replace("SOURCE", "(SELECT walk.* FROM walk LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM walk.conv_id WHERE place = coalesce(n, 0))")}))
  SELECT ended.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(left(best.r, greatest(length(best.r) - 1, 0))) AS repaired_sha256
  FROM ended LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ended.conv_id"""


OP12_SQL = _sql()
