"""The prefix trie of conversations: which prefixes they share, and what sharing them saves.

A turn is a digest of its role and text and the text's code points; a conversation is the list of its turns, so texts are
read once and not moved again.  Equal conversations are one row with their count, so copies make no large group.

Rows are dealt by the digest of their first turn.  A group of more turns than a task should hold, and of more than one
different conversation, is dealt anew by the next turn after the prefix that all of it shares, and so on until none is too
large; each round is a few aggregations by group and a join with the list of large groups.  Groups then go by hash to
buckets.  In a bucket tries are built of dictionaries from a turn's digest to a node's number, and summed in an order in
which children come before parents, without recursion.  The nodes above, of groups that were split, are summed from their
children's tops, level by level from the deepest.

Lists of members that end at a node are hashed as a stream: ids are range-sorted by conversation and id, joined to pieces
where they lie, and the few pieces of a list are hashed in order.  SHA-256 of one list is sequential by its nature, but no
list is held whole.

A null role or text is empty; a null turn stands first; turns of equal number are ordered by their digest; repeated rows
are turns of their own.  Rows without a conversation id take no part.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import map_arrow, maybe_broadcast, written

#: Turns of a group that is never split; turns that one task holds at most, but for a single conversation.
LEAST_TURNS, MOST_TURNS = 1_000, 50_000
#: Ids joined to one piece of a list.
PIECE_IDS = 4096
_SEQ = "array<struct<token:binary,size:bigint>>"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _short(text: Column) -> Column:
    """The first 128 bits of the digest of a text or bytes."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def in_order(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` as (conv_id, seq): each conversation's turns as digest and code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = _short(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    each = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", token.alias("token"), F.length(text).cast("long").alias("size")).alias("t"))
    listed = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select("conv_id", F.transform("ts", lambda t: F.struct(t["token"].alias("token"), t["size"].alias("size"))).alias("seq"))


def rebuilt(ordered: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 100 (all if fewer, none if that is
    absent); h is the unsigned crc32 of c's decimal digits mod 6.  At most five turns of a base are sent to its hundred."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    bases = ordered.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base_id"), F.slice("seq", 1, 5).alias("head"))
    of = ordered.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 100}).join(bases, F.col("base") == F.col("base_id"), "left")
    head = F.slice(F.coalesce("head", F.array().cast(_SEQ)), F.lit(1), F.col("h"))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return of.select("conv_id", F.concat(head, rest).alias("seq"))


def _ends(members: DataFrame) -> DataFrame:
    """``members(class, conv_id)``: the digest of each class's ids, ascending and joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids = None, []
        piece = lambda: pa.record_batch({"class": pa.array([of], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))])})
        for batch in batches:
            for c, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (c != of or len(ids) == PIECE_IDS):
                    yield piece()
                    ids = []
                of = c
                ids.append(i)
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        row = lambda: pa.record_batch({"class": pa.array([of], pa.binary()), "ends": pa.array([state.hexdigest()])})
        for batch in batches:
            for c, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if c != of or state is None:
                    if state is not None:
                        yield row()
                    of, state = c, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state is not None:
            yield row()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.repartitionByRange(n, "class", "conv_id").sortWithinPartitions("class", "conv_id")
    pieces = map_arrow(ranged, join, "class binary, first long, ids string")
    return map_arrow(pieces.repartition("class").sortWithinPartitions("class", "first"), digest, "class binary, ends string")


class _Forest:
    """Tries of a bucket: nodes are numbers, a node's children a dictionary from a turn's digest to a number."""

    def __init__(self):
        self.tops: dict[bytes, int] = {}
        self.children: list[dict[bytes, int] | None] = []
        self.parent, self.depth, self.size, self.n, self.conv, self.ends = [], [], [], [], [], []

    def node(self, parent: int, depth: int, size: int) -> int:
        for values, value in zip((self.children, self.parent, self.depth, self.size, self.n, self.conv, self.ends), (None, parent, depth, size, 0, None, NO_ENDS)):
            values.append(value)
        return len(self.parent) - 1

    def add(self, top: bytes, level: int, tokens, sizes, n: int, conv: int, ends: str) -> None:
        """A conversation below the prefix ``top`` of ``level`` turns, counted ``n`` times."""
        at = self.tops.get(top)
        if at is None:
            at = self.tops[top] = self.node(-1, level, sizes[level - 1])
        self.count(at, n, conv)
        for depth in range(level + 1, len(tokens) + 1):
            below = self.children[at]
            if below is None:
                below = self.children[at] = {}
            token = tokens[depth - 1]
            child = below.get(token)
            if child is None:
                child = below[token] = self.node(at, depth, sizes[depth - 1])
            at = child
            self.count(at, n, conv)
        self.ends[at] = ends

    def count(self, at: int, n: int, conv: int) -> None:
        self.n[at] += n
        if self.conv[at] is None or conv < self.conv[at]:
            self.conv[at] = conv

    def summed(self) -> tuple[list[int], list[int]]:
        """Leaves and saved tokens of each node's subtree.  A parent is made before its children, so from the last node to
        the first all children are summed before their parent."""
        leaves, saved = [0] * len(self.parent), [0] * len(self.parent)
        for at in range(len(self.parent) - 1, -1, -1):
            leaves[at] = leaves[at] or 1
            saved[at] += (self.n[at] - 1) * self.size[at]
            if (parent := self.parent[at]) >= 0:
                leaves[parent] += leaves[at]
                saved[parent] += saved[at]
        return leaves, saved


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's tries; ``above`` and ``up_conv`` of a top are what its rows carry."""
    forest, above = _Forest(), {}
    for top, level, tokens, sizes, n, conv, ends, up_key, up_conv in zip(*(group[c] for c in ("key", "level", "tokens", "sizes", "n", "conv", "ends", "up_key", "up_conv"))):
        forest.add(top, level, tokens, sizes, n, conv, ends)
        above[forest.tops[top]] = (up_key, up_conv)
    leaves, saved = forest.summed()
    up = [above[i] if p < 0 else (None, forest.conv[p]) for i, p in enumerate(forest.parent)]
    return pd.DataFrame({
        "conv_id": forest.conv, "depth": forest.depth, "parent_conv_id": [u[1] for u in up], "n_convs": forest.n, "n_children": [len(c or ()) for c in forest.children],
        "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": forest.ends, "up_key": [u[0] for u in up],
    })


def trie(conversations: DataFrame, least_turns: int = LEAST_TURNS, most_turns: int = MOST_TURNS) -> DataFrame:
    """``conversations(conv_id, seq)``, one row an id: a row for each node of their prefix trie.

    ``most_turns`` and a task's share of all turns, but at least ``least_turns``, bound the groups that are built in one
    piece; single conversations are never split.  A bucket holds about as many turns again.  Only counts come to the driver."""
    spark = conversations.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _short(F.array_join(F.transform("seq", lambda t: F.hex(t["token"])), "").cast("binary"))
    each = written(conversations.withColumn("class", name), "rebuilt")
    different = each.groupBy("class").agg(F.first("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    split = different.join(_ends(each.select("class", "conv_id")), "class").select("n", "conv", "ends", F.col("seq.token").alias("tokens"), F.col("seq.size").alias("sizes"))
    classes = written(split, "classes")
    whole = classes.agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum(F.size("tokens")).alias("turns"), F.max(F.when(F.size("tokens") == 0, F.col("ends"))).alias("ends")).first()
    if whole["conv"] is None:
        return spark.createDataFrame([], _NODE)
    limit = max(least_turns, min(most_turns, whole["turns"] // tasks))

    root = F.lit(b"")
    columns = ["key", "level", "tokens", "sizes", "n", "conv", "ends", "up_key", "up_conv"]
    token_at = lambda level: F.element_at("tokens", level)
    moving = classes.where(F.size("tokens") > 0).withColumns({"key": _short(token_at(F.lit(1))), "level": F.lit(1), "up_key": root, "up_conv": F.lit(whole["conv"]).cast("long")})
    settled, split_groups = [], []
    while True:
        turns = F.sum(F.size("tokens") - F.col("level") + 1)
        sizes = moving.groupBy("key").agg(turns.alias("turns"), F.count("*").alias("different"), F.min("conv").alias("over_conv"), F.sum("n").alias("over_n"))
        large = written(sizes.where((F.col("turns") > limit) & (F.col("different") > 1)).select("key", "over_conv", "over_n"), "large")
        n_large = large.count()
        if not n_large:
            settled.append(moving.select(columns))
            break
        both = moving.join(maybe_broadcast(large, n_large, 5), "key", "left")
        settled.append(both.where("over_n IS NULL").select(columns))
        inside = both.where("over_n IS NOT NULL")
        # All turns that the least and the greatest list share are shared by the whole group.
        ends = inside.groupBy("key").agg(F.min(F.struct("tokens", "sizes")).alias("low"), F.max("tokens").alias("high"), F.first("level").alias("level"), F.first("up_key").alias("up_key"), F.first("up_conv").alias("up_conv"))
        shared = F.array_position(F.zip_with("low.tokens", "high", lambda a, b: a.eqNullSafe(b)), False) - 1
        chains = ends.withColumn("shared", shared.cast("int")).withColumn("sizes", F.slice("low.sizes", F.col("level"), F.col("shared") - F.col("level") + 1))
        chains = written(chains.select("key", "level", "shared", "sizes", "up_key", "up_conv"), "chains")
        inside = inside.join(maybe_broadcast(chains.select("key", "shared"), n_large, 4), "key")
        ended = inside.where(F.size("tokens") == F.col("shared")).select("key", F.col("ends").alias("over_ends"))
        split_groups.append(written(large.join(chains, "key").join(ended, "key", "left"), "split"))
        below = inside.where(F.size("tokens") > F.col("shared"))
        below = below.withColumns({"up_key": F.col("key"), "up_conv": F.col("over_conv"), "level": F.col("shared") + 1, "key": _short(F.concat("key", token_at(F.col("shared") + 1)))})
        moving = written(below.select(columns), "moving")

    n_buckets = max(tasks, -(-2 * whole["turns"] // most_turns))
    dealt = reduce(DataFrame.unionByName, settled).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n_buckets)))
    nodes = written(dealt.groupBy("bucket").applyInPandas(_build, _NODE + ", up_key binary"), "nodes")
    tops = nodes.where("up_key IS NOT NULL").select("up_key", "n_leaves", "saved_tokens")
    parts = [nodes.drop("up_key")]
    below = lambda: tops.groupBy(F.col("up_key").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("under"))
    for groups in reversed(split_groups):
        met = groups.join(below(), "key").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("shared") - F.col("level")))).withColumn("last", F.col("at") == F.col("shared") - F.col("level"))
        to_end = F.sum(F.element_at("sizes", F.col("at") + 1)).over(W.partitionBy("key").orderBy(F.desc("at")))
        chain = met.select(
            "key", "up_key", "at", F.col("over_conv").alias("conv_id"), (F.col("level") + F.col("at")).cast("long").alias("depth"), F.when(F.col("at") == 0, F.col("up_conv")).otherwise(F.col("over_conv")).alias("parent_conv_id"),
            F.col("over_n").alias("n_convs"), F.when(F.col("last"), F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
            (F.col("under") + (F.col("over_n") - 1) * to_end).alias("saved_tokens"), F.coalesce(F.when(F.col("last"), F.col("over_ends")), F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        chain = written(chain, "chain")
        tops = tops.unionByName(chain.where("at = 0").select("up_key", "n_leaves", "saved_tokens"))
        parts.append(chain.drop("key", "up_key", "at"))
    under = tops.where(F.col("up_key") == root).agg(F.count("*").alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    parts.append(under.select(
        F.lit(whole["conv"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole["n"]).cast("long").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens", F.lit(whole["ends"] or NO_ENDS).alias("ends_sha256"),
    ))
    return reduce(DataFrame.unionByName, parts)


def op12_prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(in_order(turns)))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, c - c % 100 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, y:
    list_reduce(list_prepend(xor(a, y), range(8)), lambda s, k: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
u AS (
  SELECT h.c, 0 AS own, t.i, t.role, t.text FROM h JOIN t ON t.c = h.b AND t.i <= h.h
  UNION ALL SELECT h.c, 1, t.i, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.i > h.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, role, text FROM u),
n AS (SELECT c, max(d) AS n FROM r GROUP BY c),
p AS (
  SELECT c, 0 AS d, '' AS path, 0 AS size, coalesce(n, 0) = 0 AS ends FROM h LEFT JOIN n USING (c)
  UNION ALL SELECT c, d, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d), length(text), d = n FROM r JOIN n USING (c)),
m AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, path),
w AS (SELECT p.c, p.d, m.conv_id FROM p JOIN m USING (d, path)),
e AS (SELECT m.*, up.conv_id AS parent_conv_id FROM m LEFT JOIN w up ON up.c = m.conv_id AND up.d = m.d - 1),
k AS (SELECT e.*, (SELECT count(*) FROM e x WHERE x.d = e.d + 1 AND x.parent_conv_id = e.conv_id) AS n_children FROM e)
SELECT a.conv_id, a.d::BIGINT AS depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
       count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size)::BIGINT AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
FROM k a JOIN w ON w.conv_id = a.conv_id AND w.d = a.d JOIN k b ON b.conv_id = w.c AND b.d >= a.d GROUP BY a.conv_id, a.d
"""
