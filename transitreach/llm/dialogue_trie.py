"""The prefix trie of conversations, in balanced parentheses per shard.

Conversations are rebuilt from shared beginnings (``rebuilt``): the first ``h`` turns of
conversation ``c - c % 20``, then conversation ``c``'s own turns after its first ``h``, with
``h = crc32(c) % 4``.  A node of the trie is a distinct sequence of first turns; its key is its
depth and the XOR of two 64-bit hashes of every (place, turn) up to it, so a turn's key is a
running XOR and its parent's key one XOR away.

1. Turns are ordered over range partitions that also cut within a conversation; only the carry
   of the conversation that runs into a partition (count and XOR) goes from one to the next.
2. Nodes are counted by grouping on the key, with partial sums, so a first turn that a third of
   all conversations share is one row per task.
3. Below a node with one member there is nothing to count, so only nodes of two members and
   more enter the trie.  Of all conversations with the same shared path one stands for it.
   The distinct paths are dealt in path order to shards, and each shard writes its part of the
   trie as balanced parentheses: ``find_close`` delimits a subtree, the rank of leaf pairs
   counts its leaves, cumulative arrays give its savings.
4. Neighbouring shards share the spine from the root to where their paths part.  A shard is
   told the last path before it, and a node's own numbers count only in the first shard that
   has it; so the shards' sums for the nodes of the spines add up.

The conversations that end at a node are listed in pieces, one or more per range partition, and
hashed as a stream, so a long list is never one value.

Edge cases: rows without a conv_id belong to no conversation and are ignored.  NULL turns come
first; rows of the same turn are ordered by the SHA-256 of role and text; rows that repeat are
turns of their own.  NULL roles and texts are empty.  A conversation whose rebuilt form has no
turns is a member of the root only.  A very long conversation is spread over partitions; its
shared part, if other conversations have that too, is one path of a shard.  An empty table
gives an empty result.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, join_unique, materialise
from .parentheses import Parentheses

FAMILY, HEADS = 20, 4            # conversations that share beginnings; head lengths 0 to 3
SHARD_NODES = 100_000            # path nodes of one shard, about
PIECE_IDS = 20_000               # conv_ids in one piece of a list
EMIT_BYTES = 1_000_000       # of rows in one Arrow batch
MOST_BROADCAST = 500_000         # conversations or nodes: some longs each

_NODE = ["d", "x1", "x2"]


def _hashes(place: Column, digest: Column) -> list[Column]:
    return [F.xxhash64(place.cast("bigint"), digest), F.xxhash64(digest, place.cast("bigint"), F.lit(1))]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``part, c, pos, digest, words``: every turn with its place in its conversation, from 1.

    Written once; ``part`` is the range partition the turn is in.
    """
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn").cast("bigint").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("tie")).where("c IS NOT NULL")
    order = ["c", "turn", "digest", "tie"]       # ascending, NULL first; the tie cuts repeated rows as well
    dealt = materialise(conversations.sparkSession, turns.repartitionByRange(*order).withColumn(
        "part", F.spark_partition_id()), "trie_turns")
    # only a partition's first conversation can have begun before it
    counts = dealt.groupBy("part", "c").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.withColumn("before", F.sum("n").over(before)).where("before IS NOT NULL").select("part", "c", "before")
    within = Window.partitionBy("part", "c").orderBy(*order[1:])
    return (dealt.withColumn("pos", F.row_number().over(within).cast("bigint"))
            .join(F.broadcast(carry), ["part", "c"], "left")               # at most one row a partition
            .select("part", "c", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words"))


def _head_length(c: Column) -> Column:
    return F.crc32(c.cast("string")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (``c, length``) and the turns of their rebuilt forms:
    ``c, d, x1, x2, p1, p2, words`` with the node's key and its parent's."""
    spark = conversations.sparkSession
    turns = materialise(spark, ordered_turns(conversations), "trie_ordered")
    base = (F.col("c") - F.col("c") % FAMILY).alias("base")
    everyone = turns.groupBy("c").agg(F.max("pos").alias("own")).select(
        "c", "own", base, _head_length(F.col("c")).alias("h"))
    first = (turns.where((F.col("c") % FAMILY == 0) & (F.col("pos") < HEADS))
             .select(F.col("c").alias("base"), F.col("pos").alias("d"), "digest", "words"))
    h1, h2 = _hashes(F.col("d"), F.col("digest"))
    heads = (everyone.join(first, "base").where("d <= h").select("c", "d", "words", h1.alias("h1"), h2.alias("h2")))
    upto = Window.partitionBy("c").orderBy("d")                             # three turns at most
    heads = materialise(spark, heads.withColumns({"x1": F.bit_xor("h1").over(upto), "x2": F.bit_xor("h2").over(upto)}),
                        "trie_heads")
    spine = heads.groupBy("c").agg(F.max("d").alias("head"), F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    everyone = materialise(spark, everyone.join(spine, "c", "left").select(
        "c", (F.coalesce("head", F.lit(0)) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"),
        *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("head", "s1", "s2")], "own"), "trie_conversations")

    # own turns go on from the head; their running XOR is carried over partitions as the places were
    own = turns.where(F.col("pos") > _head_length(F.col("c")))
    own = join_unique(own, everyone.select("c", "head", "s1", "s2", "own"), "c", "own", turns.count(), MOST_BROADCAST)
    own = own.withColumn("d", F.col("pos") - _head_length(F.col("c")) + F.col("head"))
    own = materialise(spark, own.withColumns({"h1": h1, "h2": h2}).select(
        "part", "c", "d", "words", "h1", "h2", "s1", "s2"), "trie_own")
    totals = own.groupBy("part", "c").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("part", "c", F.bit_xor("t1").over(before).alias("b1"), F.bit_xor("t2").over(before).alias("b2"))
    carry = carry.where("b1 IS NOT NULL")
    within = Window.partitionBy("part", "c").orderBy("d")
    own = own.join(F.broadcast(carry), ["part", "c"], "left")               # at most one row a partition

    def running(i: int) -> Column:
        return F.bit_xor(f"h{i}").over(within).bitwiseXOR(F.coalesce(f"b{i}", F.lit(0)).cast("bigint")).bitwiseXOR(F.col(f"s{i}"))

    columns = ["c", "d", "words", "h1", "h2", "x1", "x2"]
    every = own.withColumns({"x1": running(1), "x2": running(2)}).select(*columns).unionByName(heads.select(*columns))
    return everyone.select("c", "length"), materialise(spark, every.select(
        "c", F.col("d").cast("bigint").alias("d"), "x1", "x2", F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"),
        F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"), "words"), "trie_rebuilt")


def nodes(everyone: DataFrame, turns: DataFrame) -> DataFrame:
    """``d, x1, x2, p1, p2, words, conv_id, n_convs, n_children, single`` of every node, the root first
    (no parent); ``single`` counts the children of one member."""
    found = turns.groupBy(*_NODE).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"),
                                      F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = (everyone.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .select(zero.alias("d"), zero.alias("x1"), zero.alias("x2"), nothing.alias("p1"), nothing.alias("p2"),
                    zero.alias("words"), "conv_id", "n_convs"))
    found = materialise(turns.sparkSession, found.unionByName(root), "trie_nodes")
    below = (found.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
             .agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single")))
    return materialise(turns.sparkSession, found.join(below, _NODE, "left").fillna(0, ["n_children", "single"]),
                       "trie_counted")


# ---------------------------------------------------------------- shards
def shard_paths(turns: DataFrame, found: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``part, spine, path``: the distinct shared paths in shards, in path order, and before each
    shard's own the last path of the shard before (``spine``).  A step of a path has the node's
    ``d, x1, x2`` and ``weight`` (what it saves itself), ``single`` and ``leaf``."""
    spark = turns.sparkSession
    shared = found.where("n_convs > 1 AND d > 0")
    inner = shared.select((F.col("d") - 1).alias("d"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).distinct()
    # a node without a shared child ends a path; its smallest member stands for all that share it
    ends = shared.join(inner, _NODE, "left_anti").select(F.col("conv_id").alias("c"), F.col("d").alias("last"))
    ends = materialise(spark, ends, "trie_ends")
    steps = materialise(spark, turns.select("c", *_NODE).join(
        broadcast_if(ends, ends.count(), MOST_BROADCAST), "c").where("d <= last").drop("last"), "trie_steps")
    size = steps.count()
    own = shared.select(*_NODE, ((F.col("n_convs") - 1) * F.col("words")).alias("weight"), "single",
                        (F.col("n_children") == 0).alias("leaf"), "n_convs")
    steps = join_unique(steps, own, _NODE, "n_convs", size, MOST_BROADCAST)
    paths = steps.groupBy("c").agg(F.sort_array(F.collect_list(F.struct(*_NODE, "weight", "single", "leaf"))).alias("path"))
    dealt = materialise(spark, paths.repartitionByRange(size // shard_nodes + 1, "path").select(
        F.spark_partition_id().alias("part"), "path"), "trie_paths")
    last = dealt.groupBy("part").agg(F.max("path").alias("path"))
    onward = Window.orderBy("part")                                        # one row per shard
    spines = last.select(F.lead("part").over(onward).alias("part"), F.lit(True).alias("spine"), "path").where("part IS NOT NULL")
    return dealt.select("part", F.lit(False).alias("spine"), "path").unionByName(spines)


def encode(paths: list[list[tuple]], known: int) -> tuple[np.ndarray, list[tuple], np.ndarray]:
    """The parentheses of sorted paths of steps ``(key, ...)`` under one root, the steps in the order of their
    opening, and which of them count here: not the root's first ``known`` steps of the first path."""
    bits, steps, counts, path = [1], [], [], []
    for k, new in enumerate(paths):
        same = 0
        while same < min(len(path), len(new)) and path[same][:3] == new[same][:3]:
            same += 1
        bits += [0] * (len(path) - same) + [1] * (len(new) - same)
        steps += new[same:]
        counts += [k > 0 or i >= known for i in range(same, len(new))]
        path = new
    bits += [0] * (len(path) + 1)
    return np.array(bits, dtype=np.uint8), steps, np.array(counts, dtype=bool)


_SUMS = "d bigint, x1 bigint, x2 bigint, leaves bigint, saved bigint"


def subtree_sums(shard: pa.Table) -> pa.Table:
    """One shard's ``leaves`` and ``saved`` of every node in it, the root included (as its first path has it)."""
    rows = [(spine, [(s["d"], s["x1"], s["x2"], s["weight"], s["single"], s["leaf"]) for s in path])
            for spine, path in zip(shard.column("spine").to_pylist(), shard.column("path").to_pylist())]
    before = next((path for spine, path in rows if spine), None)
    paths = sorted(path for spine, path in rows if not spine)
    known = 0
    if before is not None:
        while known < min(len(before), len(paths[0])) and before[known][:3] == paths[0][known][:3]:
            known += 1
    bits, steps, counts = encode(paths, known)
    tree = Parentheses(bits)
    opened = np.flatnonzero(bits)
    # a leaf pair of this shard is a leaf of the trie, or stands for a node whose children all have one member
    pair = bits[opened + 1] == 0
    weight = np.array([0] + [s[3] for s in steps], dtype=np.int64)
    single = np.array([0] + [s[4] for s in steps], dtype=np.int64)
    leaf = np.array([False] + [s[5] for s in steps])
    here = np.append(False, counts)                    # the root's own number is added once, outside
    saved = np.concatenate(([0], np.cumsum(np.where(here, weight, 0))))
    extra = np.concatenate(([0], np.cumsum(np.where(here, single, 0) - (pair & ~(here & leaf)))))
    out = []
    for k, at in enumerate(opened.tolist()):
        a, b, leaves = tree.subtree(at)
        key = steps[k - 1][:3] if k else (0, 0, 0)
        out.append((*key, leaves + int(extra[b] - extra[a]), int(saved[b] - saved[a])))
    return pa.table({name: pa.array(list(v), pa.int64()) for name, v in zip(("d", "x1", "x2", "leaves", "saved"), zip(*out))})


# ---------------------------------------------------------------- ends
def _batched(rows, names, last):
    """Rows of longs and one text in batches."""
    held, size = [], 0

    def batch():
        columns = list(zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(list(v), pa.string() if n == last else pa.int64())
                                           for n, v in zip(names, columns)], names=names)

    for row in rows:
        held.append(row)
        size += 100 + len(row[-1])
        if size >= EMIT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _keyed(batches):
    for batch in batches:
        for *key, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
            yield key, value


def _pieces(batches):
    def rows():
        node, held = None, []
        for key, c in _keyed(batches):
            if key != node or len(held) >= PIECE_IDS:
                if held:
                    yield *node, held[0], ",".join(map(str, held))
                node, held = key, []
            held.append(c)
        if held:
            yield *node, held[0], ",".join(map(str, held))

    yield from _batched(rows(), [*_NODE, "first", "ids"], "ids")


def _digests(batches):
    def rows():
        node, state = None, None
        for key, ids in _keyed(batches):
            if key == node:
                state.update(b",")
            else:
                if state is not None:
                    yield *node, state.hexdigest()
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        if state is not None:
            yield *node, state.hexdigest()

    yield from _batched(rows(), [*_NODE, "ends_sha256"], "ends_sha256")


def end_digests(everyone: DataFrame, turns: DataFrame) -> DataFrame:
    """``d, x1, x2, ends_sha256`` of the nodes at which conversations end."""
    last = turns.groupBy("c").agg(F.max(F.struct("d", "x1", "x2")).alias("e"))
    zero = F.lit(0).cast("bigint")
    ends = last.select("e.d", "e.x1", "e.x2", "c").unionByName(everyone.where("length = 0").select(
        zero.alias("d"), zero.alias("x1"), zero.alias("x2"), "c"))
    key = "d bigint, x1 bigint, x2 bigint"
    # a list is cut over the ranges; what goes on to one task per node is a few long strings
    pieces = (ends.repartitionByRange(*_NODE, "c").sortWithinPartitions(*_NODE, "c").select(*_NODE, "c")
              .mapInArrow(_pieces, f"{key}, first bigint, ids string"))
    pieces = materialise(turns.sparkSession, pieces, "trie_pieces")
    return (pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").select(*_NODE, "ids")
            .mapInArrow(_digests, f"{key}, ends_sha256 string"))


def trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = conversations.sparkSession
    everyone, turns = rebuilt(conversations)
    found = nodes(everyone, turns)
    sums = (shard_paths(turns, found, shard_nodes).groupBy("part").applyInArrow(subtree_sums, _SUMS)
            .groupBy(*_NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    sums = materialise(spark, sums, "trie_sums")
    total = found.count()
    parents = found.where("n_children > 0").select(
        (F.col("d") + 1).alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"), "n_children")
    rows = join_unique(found.drop("n_children"), parents.withColumnRenamed("n_children", "siblings"),
                       ["d", "p1", "p2"], "siblings", total, MOST_BROADCAST)
    rows = rows.join(found.select(*_NODE, "n_children"), _NODE).join(sums, _NODE, "left").join(
        end_digests(everyone, turns), _NODE, "left")
    alone = F.greatest(F.lit(1), F.col("single"))       # not in a shard: one member, or nothing shared below the root
    return rows.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.coalesce(F.when(F.col("d") == 0, F.col("leaves") + F.col("single")).otherwise(F.col("leaves")),
                   alone).cast("bigint").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


# The contract's query in DuckDB SQL (with CRC-32 by its table of remainders).
ORACLE_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda a, b:
           CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), t AS (
  SELECT conv_id AS c, COALESCE(role, '') AS role, COALESCE(text, '') AS text, ROW_NUMBER() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(CAST(length(COALESCE(role, '')) AS VARCHAR) || ':' || COALESCE(role, '') || COALESCE(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), e AS (
  SELECT c, own, c - c % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
           string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
           lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295) % 4 AS h
  FROM (SELECT c, COUNT(*) AS own FROM t GROUP BY c), crc
), r AS (
  SELECT e.c, t.pos AS p, t.role, t.text FROM e JOIN t ON t.c = e.base AND t.pos <= e.h
  UNION ALL
  SELECT e.c, LEAST(e.h, COALESCE(b.own, 0)) + t.pos - e.h, t.role, t.text
  FROM e JOIN t ON t.c = e.c AND t.pos > e.h LEFT JOIN e b ON b.c = e.base
), l AS (
  SELECT e.c, COALESCE(x.l, []) AS l
  FROM e LEFT JOIN (SELECT c, list({'r': role, 't': text} ORDER BY p) AS l FROM r GROUP BY c) x ON x.c = e.c
), n AS (
  SELECT d, l[1:d] AS k, MIN(c) AS conv_id, COUNT(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(l[d].t), '[^\x20\x09-\x0D]+')) END AS words
  FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM l) GROUP BY 1, 2
), ch AS (
  SELECT d - 1 AS d, k[1:d - 1] AS k, COUNT(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2
), m AS (
  SELECT n.*, COALESCE(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.d = n.d AND ch.k = n.k
), s AS (
  SELECT a AS d, k[1:a] AS k, SUM((n_convs - 1) * words) AS saved, COUNT(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT m.*, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1, 2
), z AS (
  SELECT l AS k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM l GROUP BY l
)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
       sha256(COALESCE(z.ids, '')) AS ends_sha256
FROM m JOIN s ON s.d = m.d AND s.k = m.k
LEFT JOIN n p ON p.d = m.d - 1 AND p.k = m.k[1:m.d - 1]
LEFT JOIN z ON z.k = m.k
"""
