"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

**Space.**  With M the largest norm, a row x stands at (x / M, sqrt(1 - |x|^2 / M^2)) and a query q at (q / |q|, 0): both on
the unit sphere, and the nearer of two rows is the one of the larger inner product.

**Index.**  Each of ``tables`` tables cuts k projections on Gaussian (2-stable) directions, made orthogonal, into cells of
``CELL`` times the distance at which a neighbour is expected; the k cells are a bucket.  That distance is taken from a
sample of ``SAMPLE`` rows, those of the smallest id hash: the 0.9 quantile, over them, of the distance to the neighbour of
the sampled rank.  k grows with the logarithm of the counted rows up to 16.  Every row is in every table.

**Probes.**  By the law of the projections a neighbour at that distance lies in a given cell with a known chance.  A query
visits its own bucket and then perturbed ones (cells one up or down) in the order of their chances, by a heap, until the
chances sum to what makes a miss in all tables as rare as ``1 - RECALL``.  There is no fixed number of probes.

**Search.**  Buckets are dealt by hash to parts; a row or query goes to a part once, with its buckets there.  Parts with
many rows or queries are split (rows by id, queries by id), so that a bucket of any size is spread over tasks without
leaving a pair out.  In a part each bucket's queries meet its rows in one matrix product, and the best candidates are
scored again exactly, part by part in a fixed order, so that a score does not depend on where it was computed.  Tables
are merged by query, and the best of equal ids counts once.

Equal vectors are one row of the index with their smallest ids, as many as a result can need, so copies fill no bucket.
A query that found fewer rows than asked for, though there are more, is compared with all rows in the same parts.

A row counts if its id and vector are there, all parts are finite and one is not zero.  Of rows with one id the one with the
smallest bytes counts.  Shorter vectors are padded with zeros.  Ties go to the smaller id; fewer rows than k give all of
them; a single row or an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import map_arrow, maybe_broadcast, written

#: Tables; cells' width in expected distances; share of neighbours to be found by the model; rows of the sample.
TABLES, CELL, RECALL, SAMPLE = 8, 2.7, 0.95, 2048
#: Rows and queries of one part, a part with more is split; parts of a small table.  A query brings back its best rows from
#: each part that it visits, so parts are as many as the rows need and not as many as a shuffle has.
PART_ROWS, PART_QUERIES, LEAST_PARTS = 32_768, 16_384, 16
_DEALT = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("raw", pa.binary()), ("buckets", pa.list_(pa.int64()))])
_FOUND = "query_id long, rep long, score double"


class Family:
    """The hash functions of all tables, from a seed: the same on the driver and in every task."""

    def __init__(self, width: int, k: int, tables: int, distance: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k, self.tables, self.z = k, tables, 1 / CELL
        cell = CELL * max(distance, 1e-6)
        self.directions, self.offsets = [], rng.uniform(0, 1, (tables, k))
        for _ in range(tables):
            a = rng.normal(size=(width + 1, k))
            if k <= width + 1:
                a = np.linalg.qr(a)[0] * math.sqrt(width + 1)
            self.directions.append(a / cell)
        self.salt = rng.integers(1, 1 << 62, (tables, k), dtype=np.int64) | 1

    def places(self, points: np.ndarray, table: int) -> np.ndarray:
        return points @ self.directions[table] + self.offsets[table]

    def bucket(self, cells: np.ndarray, table: int) -> np.ndarray:
        """64-bit names of buckets; two buckets of one name are searched as one."""
        with np.errstate(over="ignore"):
            mixed = (cells * self.salt[table]).sum(axis=-1, dtype=np.int64) + self.salt[table, 0]
            mixed = (mixed ^ (mixed >> 29)) * np.int64(-4658895280553007687)
            return mixed ^ (mixed >> 32)

    def probes(self, places: np.ndarray, table: int, wanted: float) -> list[np.ndarray]:
        """For each row of ``places`` the buckets to visit, likeliest first, until their chances sum to ``wanted``."""
        home = np.floor(places)
        inside = places - home
        cdf = lambda x: 0.5 * (1 + _erf(x / (self.z * math.sqrt(2))))
        own = cdf(1 - inside) - cdf(-inside)
        down, up = cdf(-inside) - cdf(-inside - 1), cdf(2 - inside) - cdf(1 - inside)
        # A neighbouring cell is never likelier than the own one, so costs are not negative.
        costs = np.maximum(np.log(own)[:, :, None] - np.log(np.maximum(np.stack([down, up], axis=2), 1e-300)), 0).reshape(len(places), -1)
        order = np.argsort(costs, axis=1, kind="stable")
        out = []
        for cells, cost, at, chance in zip(home.astype(np.int64), costs, order, np.prod(own, axis=1)):
            moves = list(_in_order(cost[at].tolist(), (at // 2).tolist(), float(chance), wanted))
            visited = np.repeat(cells[None, :], len(moves), axis=0)
            for i, move in enumerate(moves):
                for j in move:
                    visited[i, at[j] // 2] += 2 * (at[j] % 2) - 1
            out.append(self.bucket(visited, table))
        return out


def _erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in x.ravel().tolist()]).reshape(x.shape)


def _in_order(costs: list[float], of: list[int], chance: float, wanted: float) -> Iterator[tuple[int, ...]]:
    """Sets of perturbations (places in the sorted ``costs``) by rising cost, at most one of each projection ``of``, from the
    empty set on, while the chances given so far sum to less than ``wanted``.

    A set's successors move its last member one place on, or add the next place; so each set is made once."""
    yield ()
    total, heap = chance, [(costs[0], (0,))] if costs else []
    while heap and total < wanted:
        cost, move = heapq.heappop(heap)
        if len({of[j] for j in move}) == len(move):
            yield move
            total += chance * math.exp(-cost)
        after = move[-1] + 1
        if after < len(costs):
            heapq.heappush(heap, (cost - costs[move[-1]] + costs[after], (*move[:-1], after)))
            heapq.heappush(heap, (cost + costs[after], (*move, after)))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added part by part from the first."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class _Best:
    """The best k rows of each query of a part while its buckets go by."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.rows, self.ids, self.k = queries, rows, ids, k
        self.floor = np.full(len(queries), -np.inf)
        self.slack = 1e-9 * np.linalg.norm(queries, axis=1) * max(np.linalg.norm(rows, axis=1).max(initial=0), 1e-300)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def meet(self, q: np.ndarray, x: np.ndarray) -> None:
        scores = self.queries[q] @ self.rows[x].T
        i, j = np.nonzero(~(scores < (self.floor[q] - self.slack[q])[:, None]))
        self.waiting.append((q[i], x[j]))
        self.n_waiting += len(i)
        if self.n_waiting > max(1 << 18, 2 * len(self.kept[0])):
            self.cut()

    def cut(self) -> None:
        q, x = (np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*self.waiting)) if self.waiting else (np.zeros(0, np.int64),) * 2
        pair = np.unique(q * len(self.rows) + x) if len(self.rows) else q
        q, x = pair // max(len(self.rows), 1), pair % max(len(self.rows), 1)
        scores = np.concatenate([exact(self.queries[q[s : s + 65536]], self.rows[x[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.zeros(0)])
        q, x, scores = (np.concatenate(p) for p in zip(self.kept, (q, x, scores)))
        order = np.lexsort((self.ids[x], -scores, q))
        q, x, scores = q[order], x[order], scores[order]
        new = np.ones(len(q), bool)
        new[1:] = (np.diff(q) != 0) | (np.diff(x) != 0)  # a pair met again has the same score, so it stands next to itself
        q, x, scores = q[new], x[new], scores[new]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.queries)))[q]
        last = place == self.k - 1
        self.floor[q[last]] = scores[last]
        kept = place < self.k
        self.kept, self.waiting, self.n_waiting = (q[kept], x[kept], scores[kept]), [], 0


def _by_bucket(buckets: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = buckets.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _matrix(raw: list[bytes], kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), width).astype(np.float64)


def _search(rows: DataFrame, queries: DataFrame, k: int, kind: str, width: int, part_rows: int, part_queries: int) -> DataFrame:
    """(part, id, raw, buckets) of both sides: for each query the best k rows of the parts' common buckets."""
    n_rows, n_queries = rows.groupBy("part").agg(F.count("*").alias("n")), queries.groupBy("part").agg(F.count("*").alias("m"))
    split = lambda c, most: F.greatest(F.ceil(F.col(c) / most), F.lit(1)).cast("int")
    loads = written(n_rows.join(n_queries, "part").select("part", split("n", part_rows).alias("subs"), split("m", part_queries).alias("lots")), "loads")
    loads = maybe_broadcast(loads, loads.count())
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n)).cast("int")
    dealt = ["part", "sub", "lot"]
    left = rows.join(loads, "part").select("part", own("subs").alias("sub"), all_of("lots").alias("lot"), "id", "raw", "buckets")
    right = queries.join(loads, "part").select("part", all_of("subs").alias("sub"), own("lots").alias("lot"), "id", "raw", "buckets")

    def meet(theirs: pa.Table, ours: pa.Table) -> pa.Table:
        ids, asked = theirs.column("id").to_numpy(), ours.column("id").to_numpy()
        schema = pa.schema([("query_id", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
        if not len(ids) or not len(asked):
            return schema.empty_table()
        best = _Best(_matrix(ours.column("raw").to_pylist(), kind, width), _matrix(theirs.column("raw").to_pylist(), kind, width), ids, k)
        (names, at), (q_names, q_at) = _by_bucket(theirs.column("buckets")), _by_bucket(ours.column("buckets"))
        order, q_order = np.argsort(names, kind="stable"), np.argsort(q_names, kind="stable")
        names, at, q_names, q_at = names[order], at[order], q_names[q_order], q_at[q_order]
        for name in np.intersect1d(names, q_names):
            x = at[np.searchsorted(names, name) : np.searchsorted(names, name, "right")]
            q = q_at[np.searchsorted(q_names, name) : np.searchsorted(q_names, name, "right")]
            for start in range(0, len(q), 512):  # blocks of at most 512 x PART_ROWS scores
                best.meet(np.unique(q[start : start + 512]), np.unique(x))
        best.cut()
        q, x, scores = best.kept
        return pa.table([asked[q], ids[x], scores], schema=schema)

    return left.groupBy(*dealt).cogroup(right.groupBy(*dealt)).applyInArrow(meet, _FOUND)


def _packed(table: DataFrame, id: str, vector: str) -> tuple[DataFrame, str, int]:
    """(id, raw) of the rows that count, the parts' kind and their number."""
    kind = "<f4" if dict(table.dtypes)[vector] == "array<float>" else "<f8"
    v = F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>")
    rows = table.select(F.col(id).cast("long").alias("id"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))
    width = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((len(sizes), width), kind)
            x[np.arange(width) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
            yield pa.record_batch({"id": batch.column(0), "raw": pa.array([r.tobytes() for r in x], pa.binary())})

    return map_arrow(rows, pack, "id long, raw binary"), kind, width


def _sampled(index: DataFrame, kind: str, width: int, n: int, k: int, sample: int) -> float:
    """The distance at which a query's neighbour of rank k is expected, from at most ``sample`` rows brought to the driver."""
    raw = [r["raw"] for r in index.select("raw", "id").orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    x = _matrix(raw, kind, width)
    if len(x) < 3:
        return 1.0
    norms = np.linalg.norm(x, axis=1)
    scores = (x / norms[:, None]) @ (x / norms.max()).T
    np.fill_diagonal(scores, -np.inf)
    rank = max(1, min(len(x) - 1, math.ceil(k * len(x) / n)))
    of_rank = np.partition(scores, len(x) - rank, axis=1)[:, len(x) - rank]
    return float(max(np.quantile(np.sqrt(np.maximum(2 - 2 * of_rank, 0)), 0.9), 1e-3))


def _dealt(rows: DataFrame, kind: str, width: int, family: Family, largest: float, n_parts: int, wanted: float | None) -> DataFrame:
    """Rows (id, raw) as (part, id, raw, buckets): rows of the index with their buckets or, with ``wanted``, queries with
    those to visit."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), kind, width)
            norms = np.linalg.norm(x, axis=1)
            if wanted is None:
                points = np.hstack([x / largest, np.sqrt(np.maximum(1 - (norms / largest) ** 2, 0))[:, None]])
            else:
                points = np.hstack([x / norms[:, None], np.zeros((len(x), 1))])
            of, names = [], []
            for t in range(family.tables):
                places = family.places(points, t)
                found = [family.bucket(np.floor(places).astype(np.int64)[:, None, :], t)] if wanted is None else family.probes(places, t, wanted)
                found = list(found[0]) if wanted is None else found
                of.append(np.repeat(np.arange(len(x)), [len(f) for f in found]))
                names.append(np.concatenate(found) if found else np.zeros(0, np.int64))
            of, names = np.concatenate(of), np.concatenate(names)
            part = (names & 0x7FFFFFFFFFFFFFFF) % n_parts
            order = np.lexsort((part, of))
            of, names, part = of[order], names[order], part[order]
            first = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(part) != 0)]) if len(of) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(of)], pa.int32()), pa.array(names, pa.int64()))
            at = pa.array(of[first], pa.int64())
            yield pa.record_batch([pa.array(part[first], pa.int32()), batch.column(0).take(at), batch.column(1).take(at), lists], schema=_DEALT)

    return map_arrow(rows, deal, "part int, id long, raw binary, buckets array<long>")


def nearest(table: DataFrame, asked: Column, k: int, id: str = "id", vector: str = "vec", tables: int = TABLES, recall: float = RECALL, sample: int = SAMPLE, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """The k rows of the largest inner product with each row for which ``asked`` (of a column ``id``) holds, but itself:
    query_id, rank from 1, id, score.  To the driver come counts, the largest norm and the sample."""
    packed, kind, width = _packed(table, id, vector)
    one = packed.groupBy("id").agg(F.min("raw").alias("raw"))
    of_copies = W.partitionBy("raw").orderBy("id")
    rows = written(one, "vectors")
    # Of equal vectors the k + 1 smallest ids can be in a result; the smallest stands for them.
    placed = rows.withColumn("place", F.row_number().over(of_copies)).where(F.col("place") <= k + 1)
    members = written(placed.withColumn("rep", F.min("id").over(W.partitionBy("raw"))).withColumn("raw", F.when(F.col("place") == 1, F.col("raw"))), "members")
    index = members.where("place = 1").select("id", "raw")
    n, n_all = index.count(), rows.count()
    norm = lambda batches: (pa.record_batch({"m": pa.array([np.linalg.norm(_matrix(b.column(0).to_pylist(), kind, width), axis=1).max()])}) for b in batches if b.num_rows)
    largest = map_arrow(index.select("raw"), norm, "m double").agg(F.max("m").alias("m")).first()["m"] or 1.0
    family = Family(width, max(2, min(16, round(math.log2(max(n, 2))) - 4)), tables, _sampled(index, kind, width, max(n, 1), k, sample))
    n_parts = max(LEAST_PARTS, -(-n * tables // part_rows))
    wanted = 1 - (1 - recall) ** (1 / tables)
    queries = rows.where(asked)
    search = lambda left, right: _search(left, right, k + 1, kind, width, part_rows, part_queries)
    found = search(written(_dealt(index, kind, width, family, largest, n_parts, None), "dealt"), written(_dealt(queries, kind, width, family, largest, n_parts, wanted), "probes"))

    def merged(candidates: DataFrame) -> DataFrame:
        best = candidates.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
        best = best.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rep"))).where(F.col("place") <= k + 1)
        of = members.select(F.col("rep").alias("of"), "id")
        each = best.join(of, F.col("rep") == F.col("of")).where("id <> query_id").select("query_id", "id", "score")
        return each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    first = written(merged(found), "found")
    enough = first.where(F.col("rank") == min(k, n_all - 1)).select(F.col("query_id").alias("id"))
    short = written(queries.join(enough, "id", "left_anti"), "short")
    out = first.select("query_id", "rank", "id", "score")
    if short.limit(1).count() and n_all > 1:
        # What the probes left short meets all rows: parts by id, one bucket in each.
        everywhere = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).select("part", "id", "raw", F.array(F.lit(0).cast("long")).alias("buckets"))
        spread = index.select(F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("part"), "id", "raw", F.array(F.lit(0).cast("long")).alias("buckets"))
        whole = merged(search(spread, everywhere)).select("query_id", "rank", "id", "score")
        out = out.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
    return out


def op13_neighbours(table: DataFrame) -> DataFrame:
    """Queries are the rows whose id is divisible by 20; 20 neighbours each."""
    found = nearest(table, F.col("id") % 20 == 0, 20, "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
