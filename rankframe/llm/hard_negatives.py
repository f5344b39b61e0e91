"""Hard-negative mining by a two-dimensional block matrix product over anchors and rows.

Rows are dealt to shards and their vectors cut into dimension chunks, so a block is (shard, chunk).  A shuffle brings the
blocks of anchors and of rows together under the key (anchor shard, row shard, run of chunks); each chunk's product is a
partial tile of int64 scores, and the tiles of a run are added where they meet.  Blocks are shuffled, not tiles, as far as the
chunks of a pair of shards fit one task; of wider vectors the runs' tiles are shuffled by (anchor shard, row shard)
and added again.  A whole tile is reduced to the best of each anchor or window at once, so no score leaves it but those.

Two products are taken.  The first covers pairs of shards that can share a label and gives each anchor's positives.  The
second covers pairs of shards that can differ in label; its anchor blocks carry the positives' score windows.  Shards hold
rows of one bin of labels, so for labels with bins of their own no pair of shards is multiplied twice.  A label of any
size is dealt to as many shards as its counted rows need.

A row counts if id, label and vector are there and all parts are finite.  Of rows with one id the one with the smallest
label, then vector, counts.  Vectors of different widths are compared over their common parts (missing parts are zero).
Ties go to the smaller id.  An anchor without another row of its label, and a window without a row in it, give no rows;
empty tables give none.  Scores outside 64 bits wrap around.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: Bins of labels; rows and anchors of one shard; chunks a vector is cut into at least; bytes of one block at most, and of
#: the blocks of rows that one task brings together for a tile.
BINS, ROWS, ANCHORS, CHUNKS, BLOCK_BYTES, RUN_BYTES = 64, 8192, 512, 2, 4 << 20, 32 << 20
#: Parts that pairs of shards are dealt to; eight pairs each beyond.
PARTS = 96
_BLOCK = "k int, bin int, ids binary, labels binary, raw binary, kind string, n_wins binary, wins binary"
_TILE = "c int, r int, k int, tile binary, anchors binary, anchor_labels binary, rows binary, row_labels binary, n_wins binary, wins binary"


def quantised(table: DataFrame) -> DataFrame:
    """``table(vec_id, embedding, label)`` as (id, label, x): parts times 256, rounded down; ids divisible by 7 carry a
    wrong label, the next of ten."""
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return usable.select("id", label.alias("label"), F.transform("v", lambda x: F.floor(x * 256)).alias("x"))


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _blocks(pieces: DataFrame, shard: str) -> DataFrame:
    """Pieces (shard, k, id, label, x, wins) as one block a shard and chunk, its rows by id, parts in the least width."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = group.column("x").combine_chunks()
        sizes = x.value_lengths().to_numpy()
        parts = np.zeros((len(sizes), max(1, int(sizes.max()))), np.int64)
        parts[np.arange(parts.shape[1]) < sizes[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
        low, high = int(parts.min()), int(parts.max())
        kind = next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        wins = group.column("wins").to_pylist()
        flat = [v for w in wins for pair in w or [] for v in pair.values()]
        as_bytes = lambda a: np.asarray(a, "<i8").tobytes()
        row = {
            **{n: group.column(n)[0].as_py() for n in (shard, "k", "bin")}, "ids": as_bytes(group.column("id").to_numpy()), "labels": as_bytes(group.column("label").to_numpy()),
            "raw": parts.astype(f"<{kind}").tobytes(), "kind": kind, "n_wins": as_bytes([len(w or []) for w in wins]), "wins": as_bytes(flat),
        }
        schema = pa.schema([*((n, pa.int32()) for n in (shard, "k", "bin")), *((n, pa.binary()) for n in ("ids", "labels", "raw")), ("kind", pa.string()), ("n_wins", pa.binary()), ("wins", pa.binary())])
        return pa.Table.from_pylist([row], schema)

    return pieces.groupBy(shard, "k", "bin").applyInArrow(pack, f"{shard} int, {_BLOCK}")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices in int64; in doubles where those are exact."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    if top(a) * top(b) * max(width, 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


_SIDE = "c int, r int, g int, ours boolean, k int, ids binary, labels binary, raw binary, kind string, n_wins binary, wins binary"


def _tile(group: pa.Table, same: bool) -> dict | None:
    """The sum of the partial tiles of the blocks that meet, as a row of ``_TILE``; None where no pair of rows has labels as
    asked (``same``, or not) or one side is empty."""
    sides: dict[bool, dict] = {True: {}, False: {}}
    for row in group.to_pylist():
        sides[row["ours"]][row["k"]] = row
    if not all(sides.values()):
        return None
    ours, theirs = (next(iter(side.values())) for side in (sides[True], sides[False]))
    a, b = (set(_ints(row["labels"]).tolist()) for row in (ours, theirs))
    if not (a & b if same else len(a | b) > 1):
        return None
    matrix = lambda row: np.frombuffer(row["raw"], f"<{row['kind']}").reshape(len(row["ids"]) // 8, -1)
    total = np.zeros((len(ours["ids"]) // 8, len(theirs["ids"]) // 8), np.int64)
    for k in sides[True].keys() & sides[False].keys():
        total += product(matrix(sides[True][k]), matrix(sides[False][k]))
    of_rows = {"rows": theirs["ids"], "row_labels": theirs["labels"]}
    return {"c": ours["c"], "r": ours["r"], "k": ours["g"], "tile": total, "anchors": ours["ids"], "anchor_labels": ours["labels"], "n_wins": ours["n_wins"], "wins": ours["wins"]} | of_rows


def _tiles_as_bytes(group: pa.Table, same: bool) -> pa.Table:
    schema = pa.schema([(n, pa.int32() if kind == "int" else pa.binary()) for n, kind in (c.split() for c in _TILE.split(", "))])
    tile = _tile(group, same)
    return pa.Table.from_pylist([tile | {"tile": tile["tile"].tobytes()}] if tile else [], schema)


def _heads(tile: dict) -> dict:
    return {n: _ints(tile[n]) for n in ("anchors", "anchor_labels", "rows", "row_labels", "n_wins", "wins")}


def _added(group: pa.Table) -> tuple[np.ndarray, dict]:
    """The sum of a pair's tiles, and what they say of its rows."""
    rows = group.to_pylist()
    total = sum(_ints(r["tile"]) for r in rows)
    return total.reshape(len(rows[0]["anchors"]) // 8, -1), _heads(rows[0])


def _reduced(met: DataFrame, same: bool, runs: int, best: Callable[[np.ndarray, dict], pa.Table], schema: str) -> DataFrame:
    """``best`` of every tile: where its blocks meet if one run of chunks is all, else after a shuffle of the runs' tiles."""

    def at_once(group: pa.Table) -> pa.Table:
        tile = _tile(group, same)
        return best(tile["tile"], _heads(tile)) if tile else best(np.zeros((0, 0), np.int64), dict.fromkeys(("anchors", "anchor_labels", "rows", "row_labels", "n_wins", "wins"), np.zeros(0, np.int64)))

    if runs == 1:
        return met.groupBy("c", "r", "g").applyInArrow(at_once, schema)
    tiles = met.groupBy("c", "r", "g").applyInArrow(lambda g: _tiles_as_bytes(g, same), _TILE)
    return tiles.groupBy("c", "r").applyInArrow(lambda g: best(*_added(g)), schema)


def _best_positives(scores: np.ndarray, at: dict, k: int) -> pa.Table:
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    for i, anchor in enumerate(at["anchors"]):
        mine = np.flatnonzero((at["row_labels"] == at["anchor_labels"][i]) & (at["rows"] != anchor))
        best = mine[np.argsort(-scores[i, mine], kind="stable")[:k]]  # rows stand by id
        out.append((np.full(len(best), anchor), at["rows"][best], scores[i, best]))
    names = ("anchor_id", "positive_id", "positive_score")
    return pa.table({n: pa.array(np.concatenate([o[j] for o in out]), pa.int64()) for j, n in enumerate(names)})


def _best_negatives(scores: np.ndarray, at: dict, k: int, low: int, high: int) -> pa.Table:
    starts = np.concatenate([[0], np.cumsum(at["n_wins"])])
    wins = at["wins"].reshape(-1, 2)
    out: list[tuple] = [(np.zeros(0, np.int64),) * 5]
    for i, anchor in enumerate(at["anchors"]):
        other = np.flatnonzero(at["row_labels"] != at["anchor_labels"][i])
        other = other[np.argsort(-scores[i, other], kind="stable")]
        falling = -scores[i, other]
        for positive, score in wins[starts[i] : starts[i + 1]].tolist():
            # Whole scores s with low * score <= 100 * s <= high * score.
            first, last = np.searchsorted(falling, -(high * score // 100)), np.searchsorted(falling, low * -score // 100, "right")
            found = other[first : max(first, min(last, first + k))]
            n = len(found)
            out.append((np.full(n, anchor), np.full(n, positive), at["rows"][found], np.full(n, score), scores[i, found]))
    names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
    return pa.table({n: pa.array(np.concatenate([o[j] for o in out]), pa.int64()) for j, n in enumerate(names)})


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shard_rows: int = ROWS, shard_anchors: int = ANCHORS) -> DataFrame:
    """``rows(id, label, x)`` of whole numbers; ``anchors`` says of a row whether it is one.

    For each anchor and each of its ``positives`` best rows of its label: the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` hundredths of the positive's.  Gives anchor_id, positive_id, rank, negative_id and both
    scores.  What comes to the driver is one count a bin of labels."""
    one = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("s"))
    bin_of = F.pmod(F.xxhash64("s.label"), F.lit(BINS)).cast("int")
    rows = written(one.select("id", "s.*", bin_of.alias("bin"), anchors.alias("is_anchor")), "vectors")
    counts = {r["bin"]: r for r in rows.groupBy("bin").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_anchor"), 1)).alias("a"), F.max(F.size("x")).alias("w")).collect()}
    width = max((r["w"] for r in counts.values()), default=0)
    chunk = max(1, min(-(-width // CHUNKS), BLOCK_BYTES // (8 * shard_rows)))
    n_chunks = max(1, -(-width // chunk))
    per_run = max(1, RUN_BYTES // (8 * chunk * shard_rows))
    runs = -(-n_chunks // per_run)
    # Shards of bin b: from base[b], as many as its rows need.
    n_r = [-(-counts[b]["n"] // shard_rows) if b in counts else 0 for b in range(BINS)]
    n_c = [-(-counts[b]["a"] // shard_anchors) if b in counts else 0 for b in range(BINS)]
    pairs = sum(n_r) * sum(n_c) * runs
    r_base, c_base = np.concatenate([[0], np.cumsum(n_r)]).tolist(), np.concatenate([[0], np.cumsum(n_c)]).tolist()
    of_bin = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bin") + 1).cast("int")
    shard = lambda base, n: (of_bin(base[:BINS]) + F.pmod(F.xxhash64("id", F.lit(11)), F.greatest(of_bin(n), F.lit(1)))).cast("int")
    one_of = lambda base, n: F.when(of_bin(n) > 0, F.sequence(of_bin(base[:BINS]), of_bin(base[:BINS]) + of_bin(n) - 1))
    every = lambda n: F.sequence(F.lit(0), F.lit(max(n - 1, 0)))
    no_wins = F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>")

    def blocks(of: DataFrame, name: str, at: Column) -> DataFrame:
        cut = of.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
        return _blocks(cut.select(at.alias(name), "k", "bin", "id", "label", F.slice("x", F.col("k") * chunk + 1, F.lit(chunk)).alias("x"), "wins"), name)

    row_blocks = written(blocks(rows.withColumn("wins", no_wins), "r", shard(r_base, n_r)), "row-blocks")
    g = F.floor(F.col("k") / per_run).cast("int").alias("g")
    side = lambda of, ours: of.select("c", "r", g, F.lit(ours).alias("ours"), *_SIDE.replace(",", "").split()[8::2])

    def best_of(ours: DataFrame, same: bool, best: Callable[[np.ndarray, dict], pa.Table], schema: str) -> DataFrame:
        to_r, to_c = (one_of(r_base, n_r), one_of(c_base, n_c)) if same else (every(r_base[-1]), every(c_base[-1]))
        left = blocks(ours, "c", shard(c_base, n_c)).withColumn("r", F.explode(to_r))
        met = side(left, True).unionByName(side(row_blocks.withColumn("c", F.explode(to_c)), False))
        # Blocks are small and their products are not: as many parts as pairs of shards ask for, whatever the bytes.
        met = met.repartition(max(1, min(pairs, max(PARTS, pairs // 8))), "c", "r", "g")
        return _reduced(met, same, runs, best, schema)

    asked = rows.where("is_anchor")
    found = best_of(asked.withColumn("wins", no_wins), True, lambda t, at: _best_positives(t, at, positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("place", place).where(F.col("place") <= positives)
    windows = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("wins"))
    windowed = written(asked.join(windows, F.col("id") == F.col("anchor_id")).drop("anchor_id"), "windows")
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    negative = best_of(windowed, False, lambda t, at: _best_negatives(t, at, negatives, low, high), schema)
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return negative.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(table: DataFrame) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; 5 positives, 10 negatives each, 0.3 to 0.9 of the positive's score."""
    return mine(quantised(table), F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, b.v) END::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
