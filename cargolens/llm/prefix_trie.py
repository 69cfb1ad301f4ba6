"""Prefix trie of conversations by collapsing whole sequences of turns first.

A conversation's prefixes have keys that are chained digests of its turns (of a digest per role and text), so equal
prefixes have equal keys. Chains run in blocks of consecutive turns and over the last keys of blocks: no task holds a whole
conversation. Identical conversations are grouped by the key of all their turns into one weighted sequence, kept as its
smallest conversation; lists of ends are made in chunks and hashed as a stream. Only the sequences' prefixes are laid
out and summed by key, with partial sums first: common prefixes and copies cost a row per task. Leaves are the sequences
that an anti-join with all parents' keys leaves.

A node belongs to the sequence with its smallest member. A sequence's own nodes are the lower end of its path, so a
subtree's sum is that of the own nodes of all sequences through its top, less what the top's own sequence has above it.

Defined results: rows without a conv_id belong to no conversation. A null role or text is empty; null turns come first;
rows of one turn come by a digest of role and text. Repeated rows are turns like others. An empty table has no nodes.
Only conv_id, turn, role and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read_table, ship, small, spread_join
from .turns import SQL_CRC, numbered, sql_crc32

#: Conversations that share their first turns, and the bound of how many turns they share.
FAMILY, HEADS = 100, 6
#: Turns of a block of a chain, and conversations of a chunk of a list of ends.
BLOCK_TURNS, CHUNK = 64, 1000
#: The key of the root: no turns.
ROOT = ""


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id of every conversation, and its rebuilt turns: conv_id, place, mark (digest of role and text), chars (of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", mark.alias("mark"), F.length(text).cast("long").alias("chars"))
    turns = numbered(rows, "conv_id", ["turn", "mark"], "trie-turns")
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": c - c % FAMILY, "h": F.crc32(c.cast("string").cast("binary")) % HEADS})
    bases = sizes.filter(c == F.col("base")).select(c.alias("b_conv"), F.col("n").alias("b_n"))
    shared = F.least("h", F.coalesce("b_n", F.lit(0)))
    convs = cut(sizes.join(bases, F.col("base") == F.col("b_conv"), "left").select("conv_id", "base", "h", shared.alias("shared")), "trie-convs")
    heads = turns.filter((c == c - c % FAMILY) & (F.col("place") < HEADS)).select(c.alias("h_conv"), "place", "mark", "chars")  # at most HEADS rows of a base
    taken = convs.join(heads, (F.col("base") == F.col("h_conv")) & (F.col("place") < F.col("h"))).select("conv_id", "place", "mark", "chars")
    own = turns.join(small(convs.drop("base")), "conv_id").filter(F.col("place") >= F.col("h"))
    return convs.select("conv_id"), taken.unionByName(own.select("conv_id", (F.col("place") - F.col("h") + F.col("shared")).alias("place"), "mark", "chars"))


def _chained(items: Column, start: Column) -> Column:
    """``start`` and after it a key for each of the items: the digest of the key before it and the item."""
    return F.aggregate(items, F.array(start), lambda keys, x: F.concat(keys, F.array(F.sha2(F.concat(F.element_at(keys, -1), x), 256))))


def _chunks_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's chunks of ids in a row; batches are sorted by key and chunk."""
    now, digest, out = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], ["key", "ends_sha256"])
            out = []
    if digest is not None:
        out.append((now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], ["key", "ends_sha256"])


def sequences(convs: DataFrame, turns: DataFrame, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, key of all its turns, chain: key before each block and after the last) of each conversation, and the blocks.

    Blocks: conv_id, block, items (array of place, mark, chars in order) and inner (the chain of the block alone).
    """
    blocks = turns.groupBy("conv_id", F.floor(F.col("place") / block_turns).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "mark", "chars"))).alias("items"))
    blocks = cut(blocks.withColumn("inner", _chained(F.col("items.mark"), F.lit(ROOT))), "trie-blocks")
    ends = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", F.element_at("inner", -1).alias("last")))).alias("ends"))
    # the first block's keys stand as they are, a later block's are joined to the key before it
    chain = F.when(F.col("ends").isNull(), F.array(F.lit(ROOT))).otherwise(
        F.concat(F.array(F.lit(ROOT)), _chained(F.slice(F.col("ends.last"), 2, F.size("ends")), F.get("ends.last", F.lit(0))))
    )
    whole = convs.join(ends, "conv_id", "left").select("conv_id", chain.alias("chain"))
    return cut(whole.withColumn("key", F.element_at("chain", -1)), "trie-sequences"), blocks


def prefixes(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """conv_id, n, depth, key, parent, chars: every prefix of the sequences (conv_id, n, chain), from the root on."""
    root = groups.select("conv_id", "n", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("chars"))
    begun = groups.select(F.col("conv_id").alias("g_conv"), "n", F.posexplode("chain").alias("g_block", "before"))
    laid = blocks.join(begun, (F.col("conv_id") == F.col("g_conv")) & (F.col("block") == F.col("g_block")))
    outer = F.transform(F.slice("inner", 2, F.size("inner")), lambda k: F.when(F.col("block") == 0, k).otherwise(F.sha2(F.concat("before", k), 256)))
    rows = laid.select("conv_id", "n", "items", outer.alias("keys"), "before").select("conv_id", "n", F.inline(F.transform("items", lambda x, i: F.struct((x["place"] + 1).alias("depth"), F.get("keys", i).alias("key"), F.when(i == 0, F.col("before")).otherwise(F.get("keys", i - 1)).alias("parent"), x["chars"].alias("chars")))))
    return root.unionByName(rows)


def trie(convs: DataFrame, turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, place from 0, mark, chars) of ``convs`` (conv_id)."""
    ship(convs.sparkSession)
    whole, blocks = sequences(convs, turns, block_turns)
    chunk = whole.groupBy("key", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    ends = chunk.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_chunks_hashed, "key string, ends_sha256 string")
    groups = whole.groupBy(F.col("key").alias("g_key")).agg(F.min("conv_id").alias("g_conv"), F.count("*").alias("n"))
    groups = groups.join(whole.select(F.col("conv_id").alias("g_conv"), "chain"), "g_conv").select(F.col("g_conv").alias("conv_id"), "g_key", "n", "chain")
    paths = cut(prefixes(groups.select("conv_id", "n", "chain"), blocks), "trie-paths")
    nodes = paths.groupBy("key").agg(F.min("conv_id").alias("owner"), F.sum("n").alias("n_convs"), F.count("*").alias("n_paths"), F.max("parent").alias("n_parent"))
    nodes = cut(nodes, "trie-nodes")
    children = nodes.filter("n_parent IS NOT NULL").groupBy(F.col("n_parent").alias("c_key")).agg(F.count("*").alias("n_children"))
    children = cut(children, "trie-children")
    # each path's own nodes, and the last node above them, which is another sequence's
    placed = spread_join(paths.select("conv_id", "depth", "key", "parent", "chars"), nodes.drop("n_parent"), "key", "n_paths", F.col("conv_id"))
    placed = cut(placed.withColumn("own", F.col("owner") == F.col("conv_id")).withColumn("saved", F.when(F.col("own"), (F.col("n_convs") - 1) * F.col("chars"))), "trie-placed")
    above = placed.groupBy(F.col("conv_id").alias("s_conv")).agg(F.min(F.when(F.col("own"), F.col("depth"))).alias("top"), F.coalesce(F.sum("saved"), F.lit(0)).alias("total"), F.max_by("owner", F.when(~F.col("own"), F.col("depth"))).alias("above"))
    leaves = groups.join(children, F.col("g_key") == F.col("c_key"), "left_anti").select(F.col("conv_id").alias("l_conv"), F.lit(1).cast("long").alias("leaf"))
    told = cut(above.join(leaves, F.col("s_conv") == F.col("l_conv"), "left").select("s_conv", "top", "total", "above", F.coalesce("leaf", F.lit(0)).alias("leaf")), "trie-told")
    sums = placed.join(small(told.select("s_conv", "total", "leaf")), F.col("conv_id") == F.col("s_conv")).groupBy(F.col("key").alias("t_key")).agg(F.sum("total").alias("through"), F.sum("leaf").alias("n_leaves"))
    # what a sequence's own nodes save above each of them, by blocks
    own = placed.filter("own").withColumn("block", F.floor(F.col("depth") / block_turns))
    per_block = own.groupBy(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block")).agg(F.sum("saved").alias("b_saved"))
    preceding = (Window.unboundedPreceding, -1)
    sofar = per_block.select("b_conv", "b_block", F.coalesce(F.sum("b_saved").over(Window.partitionBy("b_conv").orderBy("b_block").rowsBetween(*preceding)), F.lit(0)).alias("b_before"))
    within = F.coalesce(F.sum("saved").over(Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(*preceding)), F.lit(0))
    own = own.withColumn("within", within).join(sofar, (F.col("conv_id") == F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    own = own.join(small(told.select("s_conv", "top", "above")), F.col("conv_id") == F.col("s_conv"))
    out = own.join(sums, F.col("key") == F.col("t_key")).join(children, F.col("key") == F.col("c_key"), "left").join(ends.withColumnRenamed("key", "e_key"), F.col("key") == F.col("e_key"), "left")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above"))
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("through") - F.col("b_before") - F.col("within")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(read_table(spark, sf_dir, "conversations")))


OP13_SQL = f"""WITH {SQL_CRC},
  turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS own, conv_id - conv_id % 100 AS base FROM turns GROUP BY conv_id),
  headed AS (SELECT convs.*, {sql_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM convs, crc_table),
  seqs AS (SELECT a.conv_id, list_concat(coalesce(b.own[1:h], []), own_of_a[h + 1:]) AS seq FROM (SELECT conv_id, base, h, own AS own_of_a FROM headed) AS a LEFT JOIN convs AS b ON b.conv_id = a.base),
  prefixes AS (SELECT conv_id, len(seq) AS n, d, seq[1:d] AS p, seq[d].x AS x FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM seqs)),
  nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(any_value(x)), 0) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
  kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
  full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
  sums AS (SELECT p[1:k] AS p, sum(CAST((n_convs - 1) * chars AS BIGINT)) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(d + 1)) AS k FROM full_nodes) GROUP BY 1)
  SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, sums.n_leaves, CAST(saved AS BIGINT) AS saved_tokens, a.ends_sha256
  FROM full_nodes AS a JOIN sums USING (p) LEFT JOIN nodes AS b ON a.d > 0 AND b.p = a.p[1:a.d - 1]"""
