"""A prefix trie over conversations from one global sort.

Each conversation is an array of turns, each turn 128 bits of a SHA-256 over its role and text. Arrays are range-sorted
over the cluster, ties by conv_id, so that a large group of equal conversations is cut like any other stretch. Every task
then sweeps its stretch once: adjacent longest common prefixes say which nodes of a stack close and which open, and a node
that closes hands its sums to the one below. Nodes on the path of a task's first or last row may go on in a neighbour; they
are written open, as if the task's stretch stood alone, and where two stretches meet, the common prefix of the rows on both
sides says what was counted twice. These corrections are sums too, so open nodes are stitched by one grouping, however
long the path and however many tasks a node spans.

Turns are ordered by number, null first, ties by hash; null roles and texts are empty. Rows without conv_id belong to no
conversation and are left out. Repeated rows are turns of their own. An empty table has no node, not even a root. One
conversation is one row of the sort, 32 bytes a turn; nothing else is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: Hex digits of a turn in a path.
TURN = 32
#: Conversations that share one conversation's first turns, and the most turns shared, exclusive.
FAMILY, MOST_SHARED = 100, 6
#: Rows that a task hands on at once.
BATCH_ROWS = 4096
NODE, OPEN, FIRST, LAST = 0, 1, 2, 3

SWEPT_SCHEMA = (
    "kind int, part int, key string, parent string, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, chars array<long>"
)
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_SWEPT = [
    ("kind", pa.int32()), ("part", pa.int32()), ("key", pa.string()), ("parent", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("chars", pa.list_(pa.int64())),
]


def turn_arrays(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, key, chars): one row per conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.left(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(TURN))
    turn = F.struct(F.col("turn").alias("turn"), key.alias("key"), F.char_length(text).cast("long").alias("chars"))
    return rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % 100, where h = crc32(c in decimal) % 6, and goes
    on with its own turns after its first h."""
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    shared = convs.select(F.col("conv_id").alias("_first"), F.slice("turns", 1, MOST_SHARED - 1).alias("_shared"))
    both = convs.withColumn("_first", first).join(shared, "_first", "left")
    head = F.coalesce(F.slice("_shared", F.lit(1), h), F.slice("turns", 1, 0))
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return both.select("conv_id", F.concat(head, tail).alias("turns"))


class _Node:
    __slots__ = ("chars", "children", "depth", "ends", "key", "leaves", "low", "n", "open", "saved")

    def __init__(self, key: str, depth: int, chars: int, open_: bool) -> None:
        self.key, self.depth, self.chars, self.open = key, depth, chars, open_
        self.low, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[str] = []


def child_key(parent: str, turn: str) -> str:
    return hashlib.sha256((parent + turn).encode()).hexdigest()[:TURN]


def common_turns(a: str, b: str) -> int:
    """How many turns two paths have in common at their beginnings."""
    same, most = 0, min(len(a), len(b)) // TURN
    while same < most and a[same * TURN : (same + 1) * TURN] == b[same * TURN : (same + 1) * TURN]:
        same += 1
    return same


def ends_digest(ends: list[str]) -> str:
    return hashlib.sha256(",".join(ends).encode()).hexdigest()


def sweep(rows: Iterator[tuple[int, str, list[int]]], part: int) -> Iterator[tuple]:
    """Rows of SWEPT_SCHEMA for sorted (conv_id, path, characters of each turn): nodes, open nodes, and the first and last path."""
    stack: list[_Node] = []
    path, chars = "", []

    def close() -> tuple:
        node = stack.pop()
        node.leaves += not node.children
        node.saved += (node.n - 1) * node.chars
        if stack:
            below = stack[-1]
            below.n, below.children, below.leaves, below.saved = below.n + node.n, below.children + 1, below.leaves + node.leaves, below.saved + node.saved
            below.low = node.low if below.low is None else min(below.low, node.low)
        ends = (",".join(node.ends) if node.ends else None) if node.open else ends_digest(node.ends)
        return (OPEN if node.open else NODE, part, node.key, stack[-1].key if stack else None, node.depth, node.low, node.n, node.children, node.leaves, node.saved, ends, None)

    for conv, new, new_chars in rows:
        first = not stack
        if first:
            stack.append(_Node("", 0, 0, True))
            yield (FIRST, part, *[None] * 8, new, new_chars)
        same = common_turns(path, new)
        while stack[-1].depth > same:
            yield close()
        for d in range(same, len(new) // TURN):
            stack.append(_Node(child_key(stack[-1].key, new[d * TURN : (d + 1) * TURN]), d + 1, new_chars[d], first))
        top = stack[-1]
        top.n += 1
        top.low = conv if top.low is None else min(top.low, conv)
        top.ends.append(str(conv))
        path, chars = new, new_chars
    if stack:
        yield (LAST, part, *[None] * 8, path, chars)
    while stack:
        stack[-1].open = True
        yield close()


def _in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*some), _SWEPT)], names=[n for n, _ in _SWEPT])

    for row in rows:
        some.append(row)
        if len(some) == BATCH_ROWS:
            yield batch()
            some = []
    if some:
        yield batch()


def swept(convs: DataFrame) -> DataFrame:
    """The sweep of every task over its stretch of the sorted arrays."""
    arrays = convs.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["key"]), "").alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from _in_batches(sweep(rows, TaskContext.get().partitionId()))

    return keep(arrays).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(run, SWEPT_SCHEMA)


def border(before: str, after: str, chars: list[int]) -> Iterator[tuple]:
    """Rows of SWEPT_SCHEMA that take off what the stretches on both sides of a border have counted twice: common nodes as
    children, their last texts, and the last row before the border as a leaf, if the next one equals or extends it."""
    same, key, parent = common_turns(before, after), "", None
    again = sum(chars[:same])
    for d in range(same + 1):
        yield (OPEN, None, key, parent, d, None, 0, -(d < same), -(same * TURN == len(before)), again, None, None)
        if d < same:
            again -= chars[d - 1] if d else 0
            parent, key = key, child_key(key, before[d * TURN : (d + 1) * TURN])


def corrections(found: DataFrame) -> DataFrame:
    """What was counted on both sides of each border between stretches, as open nodes with sums to take off."""
    parts = found.where(F.col("kind") == FIRST).select("part")
    # one number per task that had rows
    neighbours = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))
    left = found.where(F.col("kind") == LAST).select("part", F.col("ends").alias("before"), "chars")
    right = found.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("ends").alias("after"))
    borders = left.join(neighbours, "part").join(right, "next").select("before", "after", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(row for b in batches for sides in zip(*(c.to_pylist() for c in b.columns)) for row in border(*sides))

    return borders.mapInArrow(run, SWEPT_SCHEMA)


def open_ends(found: DataFrame) -> DataFrame:
    """key and ends_sha256 of open nodes: a node's conversations stream through the digest task by task, in order."""
    some = found.where((F.col("kind") == OPEN) & F.col("ends").isNotNull()).select("key", "part", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            for new, ends in zip(batch.column(0).to_pylist(), batch.column(2)):
                if new == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = new, hashlib.sha256()
                digest.update(ends.as_buffer())
            if len(done) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*done)], names=["key", "ends_sha256"])
                done = []
        if key is not None:
            done.append((key, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*done)], names=["key", "ends_sha256"])

    return some.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, "key string, ends_sha256 string")


def conversation_trie(convs: DataFrame) -> DataFrame:
    """The trie's nodes for conversations of turn_arrays(): conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    found = keep(swept(convs))
    parts = found.where(F.col("kind") == OPEN).unionByName(corrections(found))
    stitched = parts.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS])
    stitched = stitched.join(open_ends(found), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(ends_digest([]))))
    names = ["key", "parent", "depth", "conv_id", *SUMS, "ends_sha256"]
    whole = found.where(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256").select(names).unionByName(stitched.select(names))
    parents = whole.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256")


ORACLE = f"""
WITH bits AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), {TURN}) AS key
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'key': key, 'chars': length(text)}} ORDER BY turn NULLS FIRST, key) AS turns FROM turns GROUP BY conv_id
), shared AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {MOST_SHARED} AS h
  FROM own, bits
), rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(o.turns[:s.h], []), s.turns[s.h + 1:]) AS turns FROM shared s LEFT JOIN own o ON o.conv_id = s.conv_id - s.conv_id % {FAMILY}
), prefixes AS (
  SELECT conv_id, d AS depth, len(turns) AS n, list_transform(turns[:d], lambda t: t.key) AS path, CASE WHEN d > 0 THEN turns[d].chars ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY path, depth
), children AS (
  SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path
), below AS (
  SELECT path[:d] AS path, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.path = c.path LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[:c.depth - 1]
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(rebuilt(turn_arrays(table(spark, sf_dir, "conversations"))))
