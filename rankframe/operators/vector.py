"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot

#: Queries in one block, and corpus rows in one: a pair of blocks is what one matrix product sees.
QUERY_BLOCK, CORPUS_BLOCK = 1024, 5000
#: Corpus blocks that a join makes at once for a block of many queries.
SHARE_BLOCKS = 4
#: Bytes of query vectors that one pass over the corpus is sent, and of best rows that a task may hold in it; more queries
#: take further passes.
SENT_BYTES, HELD_BYTES = 256 << 20, 512 << 20
#: Queries from which on a search no smaller than its corpus is dealt by queries; the least queries of one part and the most, between
#: them as many as make ``PARTS``; bytes of best rows that a part holds.
DEALT_QUERIES, PART_QUERIES, MOST_QUERIES, PARTS, PART_BYTES = 4096, 2048, 8000, 128, 64 << 20
#: Queries and rows of one 32-bit product, and pairs scored at once, so that they stay in the processor's caches.
TILE, PAIRS = (512, 1024), 2048
_HITS = "qid long, did long, score double"


class _Best:
    """The k best of each query of a block while corpus blocks go by.

    What cannot reach a query's k best so far is not taken; the rest waits until it outweighs what is kept, then
    both are cut to k a query.  Of rows of one id the best counts."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.floor = np.full(len(qids), -np.inf)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows (place of the query, id, score)."""
        good = scores >= self.floor[at]
        self.waiting.append((at[good], ids[good], scores[good]))
        self.n_waiting += int(good.sum())
        if self.n_waiting > max(1 << 16, len(self.kept[0])):
            self.cut()

    def cut(self) -> None:
        at, ids, scores = (np.concatenate(x) for x in zip(self.kept, *self.waiting))
        order = np.lexsort((-scores, ids, at))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(at[order]) != 0) | (np.diff(ids[order]) != 0)
        order = order[new]
        order = order[np.lexsort((ids[order], -scores[order], at[order]))]
        place = np.arange(len(order)) - np.searchsorted(at[order], np.arange(len(self.qids)))[at[order]]
        last = order[place == self.k - 1]
        self.floor[at[last]] = scores[last]
        order = order[place < self.k]
        self.kept, self.waiting, self.n_waiting = (at[order], ids[order], scores[order]), [], 0

    def rows(self) -> pa.RecordBatch:
        self.cut()
        return pa.record_batch({"qid": self.qids[self.kept[0]], "did": self.kept[1], "score": self.kept[2]})


def _kind(*tables: DataFrame) -> str:
    """32-bit parts where all tables hold no more."""
    return "<f4" if all(dict(t.dtypes)["vec"] == "array<float>" for t in tables) else "<f8"


def _matrix(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)


def pass_queries(dim: int, k: int, block: int, part_bytes: int) -> int:
    """Queries of one pass, in whole blocks: their vectors and ids, and k rows (place, id, score) a query with as many
    waiting, stay within the budgets."""
    rows = min(SENT_BYTES // (dim * part_bytes + 8), HELD_BYTES // (2 * 24 * k))
    return max(1, rows // block) * block


def _packed(vectors: DataFrame, size: int, kind: str = "<f8", calls: int = 0) -> DataFrame:
    """Rows (id, as_id, vec) as blocks of at most ``size``: their ids, the width and the parts as bytes.  Nothing moves.

    ``calls``: behind a block, ``call`` -1, stand rows that are empty but for a ``call`` of 0, 1, …, one for each share of another table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            even = max(1, -(-batch.num_rows // max(1, -(-batch.num_rows // size))))
            for start in range(0, batch.num_rows, even):
                part = batch.slice(start, even)
                vec = part.column(2)
                widths = set(pc.list_value_length(vec).to_pylist())
                if len(widths) > 1 or None in widths:
                    raise ValueError("vectors of one table differ in width, or one is null")
                x = vec.flatten().to_numpy(zero_copy_only=False).astype(kind)
                if not np.isfinite(x).all():
                    raise ValueError("a vector has a part that is not finite")
                ids, names = (pa.array([part.column(i).to_pylist()], pa.list_(pa.int64())) for i in (0, 1))
                block = {"ids": ids, "names": names, "dim": pa.array([widths.pop()], pa.int32()), "raw": pa.array([x.tobytes()], pa.binary())}
                yield pa.record_batch(block | ({"call": pa.array([-1], pa.int32())} if calls else {}))
                if calls:
                    empty = {name: pa.nulls(calls, column.type) for name, column in block.items()}
                    yield pa.record_batch(empty | {"call": pa.array(range(calls), pa.int32())})

    source = vectors.select(F.col("id").cast("long"), F.col("as_id").cast("long"), F.col("vec").cast("array<double>"))
    return source.mapInArrow(pack, "ids array<long>, names array<long>, dim int, raw binary" + ", call int" * bool(calls))


def _scan(corpus: DataFrame, blocks: DataFrame, k: int, cosine: bool, digits: int, skip_self: bool, kind: str = "<f8") -> DataFrame:
    """Every block of queries meets every block of the corpus where that lies; each task gives its own k best a query."""

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None] if cosine else x

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for block, qids, queries, ids, names, dim, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if block not in best:
                    best[block] = _Best(np.array(qids, np.int64), k)
                known, ids, names = best[block].qids, np.array(ids, np.int64), np.array(names, np.int64)
                scores = np.round(unit(_matrix(queries, dim, kind)) @ unit(_matrix([raw], dim, kind)).T, digits)
                if skip_self:
                    scores[known[:, None] == ids[None, :]] = -np.inf
                best[block].add(*_top(scores, names, k))
        for found in best.values():
            yield found.rows()

    both = corpus.join(F.broadcast(blocks)).select("block", "qids", "queries", "ids", "names", "dim", "raw")
    return both.mapInArrow(partial, _HITS)


def _top(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, id, score) of each row's k best ids; ties go to the smaller id, equal ids count once."""
    if len(set(names.tolist())) < len(names):
        order = np.argsort(names, kind="stable")
        names, starts = np.unique(names[order], return_index=True)
        scores = np.maximum.reduceat(scores[:, order], starts, axis=1)
    else:
        order = np.argsort(names, kind="stable")
        names, scores = names[order], scores[:, order]
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above, level = scores > floor, scores == floor
        # Columns stand by id, so the first of those level with the k-th are those of the smaller ids.
        chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        chosen = np.ones(scores.shape, bool)
    at = np.nonzero(chosen & (scores > -np.inf))
    return at[0], names[at[1]], scores[at]


class _Lists:
    """``_Best`` for ids that no two rows share: a row of places for each query, with room for two thirds of new ones.

    What is added goes behind a query's best; where a row would be full, all are sorted and cut to k."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.floor, self.last = np.full(len(qids), -np.inf), np.zeros(len(qids), np.int64)
        self.scores, self.ids = np.full((len(qids), 3 * k), -np.inf), np.zeros((len(qids), 3 * k), np.int64)
        self.filled = np.zeros(len(qids), np.int64)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows (place of the query, id, score), by place; at most 2 k of a place."""
        good = (scores > self.floor[at]) | ((scores == self.floor[at]) & (ids < self.last[at]))
        at, ids, scores = at[good], ids[good], scores[good]
        if not len(at):
            return
        counts = np.bincount(at, minlength=len(self.qids))
        if (self.filled + counts).max() > 3 * self.k:
            self.cut()
        to = self.filled[at] + np.arange(len(at)) - np.searchsorted(at, at)
        self.scores[at, to], self.ids[at, to] = scores, ids
        self.filled += counts

    def cut(self) -> None:
        width = int(self.filled.max(initial=0))
        for low in range(0, len(self.qids), 256):
            part = slice(low, low + 256)
            scores, ids = self.scores[part, :width], self.ids[part, :width]
            by_id = np.argsort(ids, axis=1)
            order = np.take_along_axis(by_id, np.argsort(-np.take_along_axis(scores, by_id, axis=1), axis=1, kind="stable"), axis=1)
            self.scores[part, :width], self.ids[part, :width] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
        self.scores[:, self.k :] = -np.inf
        self.filled = np.minimum(self.filled, self.k)
        whole = self.filled == self.k
        self.floor[whole], self.last[whole] = self.scores[whole, self.k - 1], self.ids[whole, self.k - 1]

    def rows(self) -> pa.RecordBatch:
        self.cut()
        real = np.arange(self.k) < self.filled[:, None]
        return pa.record_batch({"qid": np.repeat(self.qids, self.filled), "did": self.ids[:, : self.k][real], "score": self.scores[:, : self.k][real]})


class _Block:
    """A block of vectors: 64-bit parts (unit length for cosine), their norms, and 32-bit parts for a first look."""

    def __init__(self, raw: bytes, dim: int, kind: str, cosine: bool):
        x = _matrix([raw], dim, kind)
        norms = np.linalg.norm(x, axis=1)
        if cosine:
            x, norms = x / np.maximum(norms, 1e-12)[:, None], np.ones(len(x))
        self.x, self.norms = x, norms
        self.small = bool(np.abs(x).max(initial=0) < 1e15)
        self.rough = x.astype(np.float32) if self.small else None


def _exact(asked: _Block, block: _Block, known: np.ndarray, names: np.ndarray, rows: np.ndarray, k: int, digits: int, skip_self: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, id, score) of the k best of the queries in ``rows``, by all their 64-bit scores, in parts of 256 queries."""
    for low in range(0, len(rows), 256):
        part = rows[low : low + 256]
        scores = np.round(asked.x[part] @ block.x.T, digits)
        if skip_self:
            scores[known[part][:, None] == names[None, :]] = -np.inf
        at, ids, scores = _top(scores, names, k)
        yield part[at], ids, scores


def _least(asked: _Block, block: _Block, floor: np.ndarray, known: np.ndarray, names: np.ndarray, k: int, digits: int, skip_self: bool, unique: bool) -> np.ndarray | None:
    """The 32-bit score that a pair must have for its rounded score to reach the floor: the floor but for the most that rounding
    can be off.  A query without a floor takes the k-th best of the block for one.  None where no first look is to be had."""
    if not (asked.small and block.small):
        return None
    off = (asked.x.shape[1] + 4) * 2.0**-23 * asked.norms * block.norms.max(initial=0) + 0.51 * 10.0**-digits
    least, new = floor - off, np.flatnonzero(np.isneginf(floor))
    if len(new) and not unique:
        return None
    if len(names) > k:
        for low in range(0, len(new), 256):
            part = new[low : low + 256]
            rough = asked.rough[part] @ block.rough.T
            if skip_self:
                rough[known[part][:, None] == names[None, :]] = -np.inf
            least[part] = np.partition(rough, len(names) - k, axis=1)[:, -k] - 2 * off[part]
    return np.nextafter(least.astype(np.float32), np.float32(-np.inf))


def _likely(asked: _Block, block: _Block, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose 32-bit score is ``least`` or more, by query.  Where the last tile had few, the
    next is searched only in rows whose best reaches it."""
    found, room, rare = [], np.empty(TILE[0] * TILE[1], np.float32), False
    for top in range(0, len(least), TILE[0]):
        a, floor = asked.rough[top : top + TILE[0]], least[top : top + TILE[0]]
        for low in range(0, len(block.rough), TILE[1]):
            b = block.rough[low : low + TILE[1]]
            scores = np.matmul(a, b.T, out=room[: len(a) * len(b)].reshape(len(a), len(b)))
            rows = np.flatnonzero(scores.max(axis=1) >= floor) if rare else None
            if rare and not len(rows):
                continue
            at, d = np.divmod(np.flatnonzero((scores[rows] >= floor[rows, None]) if rare else (scores >= floor[:, None])), len(b))
            found.append(((rows[at] if rare else at) + top, d + low))
            rare = len(at) < len(a) // 8
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, d = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(q, kind="stable")
    return q[order], d[order]


def _meet(asked: _Block, held: _Lists | _Best, block: _Block, names: np.ndarray, k: int, digits: int, skip_self: bool, unique: bool) -> None:
    """A block of the corpus is held against a block of queries.  Only pairs that a 32-bit product leaves in question are scored
    in 64 bits; of a query that it leaves more than 2 k of, all are."""
    known = held.qids
    least = _least(asked, block, held.floor, known, names, k, digits, skip_self, unique)
    crowded = np.arange(len(known))
    if least is not None:
        q, d = _likely(asked, block, least)
        counts = np.bincount(q, minlength=len(known))
        crowded, few = np.flatnonzero(counts > 2 * k), counts[q] <= 2 * k
        if skip_self:
            few &= known[q] != names[d]
        q, d = q[few], d[few]
        scores = [np.einsum("ij,ij->i", asked.x[q[j : j + PAIRS]], block.x[d[j : j + PAIRS]]) for j in range(0, len(q), PAIRS)]
        if scores:
            held.add(q, names[d], np.round(np.concatenate(scores), digits))
    for rows in _exact(asked, block, known, names, crowded, k, digits, skip_self):
        held.add(*rows)
    if not np.isfinite(held.floor).all():
        held.cut()


def _dealt_scan(blocks: DataFrame, corpus: DataFrame, k: int, cosine: bool, digits: int, skip_self: bool, kind: str, unique: bool) -> DataFrame:
    """Blocks of queries, each where it lies, meet all blocks of the corpus: a task ranks its queries whole, and nothing but
    their best is given on.  Scores are 64-bit; a 32-bit product says first which can matter.

    ``corpus`` has each block's ``share``.  A join makes all rows of a row of its left side before it gives one on, so a block of queries
    is a row that meets no share, and its calls, which hold no vectors, bring in one share each."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[_Block, _Lists | _Best]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids = batch.column(1)[i].as_py(), lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023
                if dim is not None:
                    best.append((_Block(batch.column(2)[i].as_py(), dim, kind, cosine), (_Lists if unique else _Best)(ids(0).copy(), k)))
                    continue
                asked, held = best[-1]
                block, names = _Block(batch.column(4)[i].as_py(), asked.x.shape[1], kind, cosine), ids(3)
                _meet(asked, held, block, names, k, digits, skip_self, unique)
        if best:
            rows = pa.Table.from_batches([held.rows() for _, held in best])
            qid, did, score = (rows.column(c).to_numpy() for c in ("qid", "did", "score"))
            asked_ids = np.concatenate([held.qids for _, held in best])
            if len(np.unique(asked_ids)) < len(asked_ids):  # a query that stands twice
                order = np.lexsort((did, -score, qid))
                qid, did, score = qid[order], did[order], score[order]
            at = np.arange(len(qid))
            place = at - np.maximum.accumulate(np.where(np.diff(qid, prepend=qid[:1] - 1) != 0, at, 0))
            first = place < k
            yield pa.record_batch({"qid": qid[first], "did": did[first], "score": score[first], "rank": (place[first] + 1).astype(np.int32)})

    called = blocks.select(F.col("ids").alias("qids"), "dim", F.col("raw").alias("queries"), "call")
    shares = corpus.select("names", F.col("raw").alias("vectors"), "share")
    none = shares.sparkSession.range(1).select(F.lit(None).cast("array<long>").alias("names"), F.lit(None).cast("binary").alias("vectors"), F.lit(-1).alias("share"))
    both = called.join(F.broadcast(shares.unionByName(none)), F.col("call").between(F.col("share"), F.col("share")))
    return both.select("qids", "dim", "queries", "names", "vectors").mapInArrow(whole, f"{_HITS}, rank int")


def _dealt(asked: DataFrame, corpus: DataFrame, n: int, m: int, k: int, dim: int, cosine: bool, digits: int, skip_self: bool, kind: str, unique: bool) -> DataFrame:
    per_part = max(64, min(max(PART_QUERIES, min(n // PARTS, MOST_QUERIES)), PART_BYTES // (2 * 24 * k)))
    parts = asked.repartition(-(-n // per_part), "id")
    block = per_part + per_part // 4  # parts are of about one size; none should be two blocks, which would meet the corpus twice
    passes = max(1, -(-m * (dim * int(kind[-1]) + 8) // SENT_BYTES))
    shares = -(-m // (passes * SHARE_BLOCKS * CORPUS_BLOCK)) or 1
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)).cast("int").alias("share")
    found = []
    for p in range(passes):
        mine = corpus.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p) if passes > 1 else corpus
        found.append(_dealt_scan(_packed(parts, block, kind, shares), _packed(mine, CORPUS_BLOCK, kind).select("names", "raw", share), k, cosine, digits, skip_self, kind, unique))
    return found[0] if passes == 1 else ranked(reduce(DataFrame.unionByName, found).drop("rank"), k)


def _search(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool, digits: int, skip_self: bool, block: int, shared_ids: bool = False) -> DataFrame:
    asked = queries.select(F.col("qid").cast("long").alias("id"), F.col("qid").cast("long").alias("as_id"), "vec")
    kind = _kind(queries, corpus)
    n, dim = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    if n >= DEALT_QUERIES and not shared_ids:
        m, width, least, names = corpus.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.min(F.size("vec")), F.lit(0)), F.count_distinct("as_id")).first()
        if m <= n and least == width == dim:
            return _dealt(asked, corpus, n, m, k, max(dim, 1), cosine, digits, skip_self, kind, names == m)
    per_pass = pass_queries(max(dim, 1), k, block, int(kind[-1])) // block
    # Queries are dealt to blocks by digest: about ``block`` in each, and the blocks of a pass are broadcast.
    n_blocks = max(1, -(-n // block))
    of_block = F.pmod(F.xxhash64("id"), F.lit(n_blocks))
    packed = _packed(corpus, CORPUS_BLOCK, kind)
    passes = []
    for low in range(0, n_blocks, per_pass):
        mine = asked.withColumn("block", of_block).where((F.col("block") >= low) & (F.col("block") < low + per_pass))
        raw = mine.select("block", "id", F.col("vec").cast("array<double>").alias("vec"))
        blocks = raw.groupBy("block").agg(F.collect_list(F.struct("id", "vec")).alias("rows")).select("block", F.col("rows.id").alias("qids"), F.col("rows.vec").alias("vecs"))
        passes.append(_scan(packed, _with_bytes(blocks, kind), k, cosine, digits, skip_self, kind))
    found = reduce(DataFrame.unionByName, passes)
    if shared_ids:
        # Another task may have met the same id.  Dealt by query once, for this and for the ranking.
        found = found.repartition("qid").groupBy("qid", "did").agg(F.max("score").alias("score"))
    return ranked(found, k)


def _with_bytes(blocks: DataFrame, kind: str = "<f8") -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [[np.asarray(v, kind).tobytes() for v in vecs] for vecs in batch.column(2).to_pylist()]
            yield pa.record_batch({"block": batch.column(0), "qids": batch.column(1), "queries": pa.array(raw, pa.list_(pa.binary()))})

    return blocks.mapInArrow(pack, "block long, qids array<long>, queries array<binary>")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", digits: int = 6, skip_self: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """``queries(qid, vec)`` against all of ``corpus(id, vec)``: qid, did, score, rank.

    A stated query set meets all rows, in blocks: query blocks are broadcast to the corpus partitions, and each
    task keeps its best k a query over all its rows, so at most k rows a query and task are shuffled, also where
    one vector is repeated everywhere.  Where the queries are many and no fewer than the rows, the rows are broadcast to parts of
    the queries instead, and a task ranks its queries whole: no scored row is shuffled.  Scores are rounded before ranking and ties go to the smaller id."""
    return _search(queries, corpus.select("id", F.col("id").alias("as_id"), "vec"), k, metric == "cosine", digits, skip_self, block)


def all_scores(queries: DataFrame, corpus: DataFrame, digits: int = 6) -> DataFrame:
    """Every query against every row: qid, did and the dot product.  As many rows as both counts multiplied, so it is for
    a stated, bounded query set; ``top_k`` is the way to keep the best.  More than one pass can be sent is an error."""
    n, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    if n * (dim + 1) * 8 > SENT_BYTES:
        raise ValueError(f"{n} queries of {dim} parts are too many for all scores")
    at = F.broadcast(queries.select("qid", F.col("vec").alias("asked")))
    return corpus.select(F.col("id").alias("did"), "vec").join(at).select("qid", "did", F.round(dot(F.col("asked"), F.col("vec")), digits).alias("score"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The best k of each query: score descending, then id."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "did"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_distinct(queries: DataFrame, corpus: DataFrame, k: int, aliases: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """Top k over ids that several vectors may share: ``aliases(id, did)``; the best vector of an id counts.

    Vectors take their shared ids before the search, so each task dedupes as it goes and keeps k distinct ids."""
    named = corpus.join(aliases.select("id", F.col("did").alias("as_id")), "id").select("id", "as_id", "vec")
    return _search(queries, named, k, True, 6, False, block, shared_ids=True)


def without(run: DataFrame, excluded: DataFrame, depth: int) -> DataFrame:
    """A run without each query's excluded ids (qid, did), ranked anew to ``depth``."""
    return ranked(run.drop("rank").join(excluded, ["qid", "did"], "left_anti"), depth)


def self_check(stored: DataFrame, fresh: DataFrame, wanted: int, floor: float) -> DataFrame:
    """Whether an encoder makes an index's own vectors again: n, median and least cosine, in one row.

    ``stored(id, vec)`` is looked at in twice ``wanted`` evenly spaced positions by id; the first ``wanted`` of those that
    ``fresh(id, vec)`` has are compared.  Fails, when it is read, where fewer than half of the wanted are there or the
    median is below ``floor``.  Nulls and vectors of another width count as cosine 0."""
    from ..functions.vectors import cosine
    from .planning import evenly_spaced

    picked = evenly_spaced(stored.select("id", "vec"), "id", 2 * wanted).distinct()
    both = picked.join(fresh.select("id", F.col("vec").alias("again")), "id").orderBy("id").limit(wanted)
    alike = F.when(F.size("vec") == F.size("again"), F.coalesce(cosine(F.col("vec"), F.col("again")), F.lit(0.0))).otherwise(0.0)
    found = both.select(alike.alias("c")).agg(F.count("*").alias("n"), F.percentile("c", F.lit(0.5)).alias("median"), F.min("c").alias("least"))
    bad = (F.col("n") < wanted // 2) | F.col("median").isNull() | (F.col("median") < floor)
    said = F.format_string(f"the encoder does not reproduce the index: %d of {wanted} rows, median cosine %s, floor {floor}", "n", F.col("median").cast("string"))
    return found.withColumn("n", F.when(bad, F.raise_error(said)).otherwise(F.col("n")))
