"""Hard negatives, the prefix trie and nearest neighbours against brute force, and on the edges of their inputs."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.llm import hard_negatives, neighbours, prefix_trie

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def usable(rows, labelled):
    found = {}
    for i, v, label in rows:
        if i is None or v is None or (labelled and label is None) or any(x is None or not math.isfinite(x) for x in v):
            continue
        if not labelled and not any(v):
            continue
        key = ((label + 1) % 10 if labelled and i % 7 == 0 else label, [math.floor(256 * x) for x in v]) if labelled else np.array(v, "<f4").tobytes()
        found[i] = min(found.get(i, key), key)
    return found


def mined(rows):
    at, out = usable(rows, True), []
    score = lambda a, b: sum(x * y for x, y in zip(at[a][1], at[b][1]))
    for a in (i for i in at if i % 100 == 0):
        ranked = sorted((b for b in at if b != a), key=lambda b: (-score(a, b), b))
        for p in [b for b in ranked if at[b][0] == at[a][0]][:5]:
            ok = [n for n in ranked if at[n][0] != at[a][0] and 30 * score(a, p) <= 100 * score(a, n) <= 90 * score(a, p)]
            out += [(a, p, r, n, score(a, p), score(a, n)) for r, n in enumerate(ok[:10], 1)]
    return sorted(out)


def hard_rows(n=420, labels=4):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.3, (n, 6)).round(1)
    x[n // 3 : 2 * n // 3] = x[0]  # a third of the rows are one vector
    rows = [(int(i) * 5, [float(v) for v in x[i]], int(rng.integers(labels)) if i % 3 else 1) for i in range(n)]
    odd = [(None, [1.0] * 6, 1), (1, None, 1), (2, [1.0] * 6, None), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (4, [NAN] * 6, 1), (6, [INF] + [0.0] * 5, 1), (7, [0.5, 0.25], 2), (9, [], 2), (11, [0.0] * 6, 3)]
    return rows + odd + rows[:50] + [(200, [0.9] * 6, 3), (-100, [0.3] * 6, -1)]


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 16, "shard_anchors": 2}])
def test_hard_negatives(spark, limits):
    rows = hard_rows()
    table = spark.createDataFrame(rows, VECTORS).withColumns({"x": F.lit("own"), "ID": F.lit(1), "k": F.lit(2)})
    found = hard_negatives.mine(hard_negatives.quantised(table), F.col("id") % 100 == 0, **limits)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100


@pytest.mark.parametrize("run_bytes, shuffled", [(hard_negatives.RUN_BYTES, False), (1, True)])
def test_tiles_are_shuffled_only_where_their_chunks_do_not_fit_one_task(spark, monkeypatch, run_bytes, shuffled):
    monkeypatch.setattr(hard_negatives, "RUN_BYTES", run_bytes)
    rows = hard_rows()
    found = hard_negatives.mine(hard_negatives.quantised(spark.createDataFrame(rows, VECTORS)), F.col("id") % 100 == 0, shard_rows=64, shard_anchors=4)
    assert ("tile#" in found._jdf.queryExecution().optimizedPlan().toString()) == shuffled
    assert sorted(map(tuple, found.collect())) == mined(rows)


def test_hard_negatives_edges(spark):
    assert hard_negatives.op11_hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard_negatives.op11_hard_negatives(spark.createDataFrame([(0, [1.0], 1)], VECTORS)).collect() == []
    wide = [(i, [1e6 * (i % 9 - 4)] * 3, i % 2) for i in range(0, 100, 3)]  # scores beyond what doubles hold exactly
    wide = [(i, [v + 1 / 256 for v in x], label) for i, x, label in wide]
    as_double = VECTORS.replace("float", "double")
    assert sorted(map(tuple, hard_negatives.op11_hard_negatives(spark.createDataFrame(wide, as_double)).collect())) == mined(wide)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (1 << 7, 1 << 30, 1 << 31):
        a, b = rng.integers(-top, top, (5, 8)), rng.integers(-top, top, (7, 8))
        with np.errstate(over="ignore"):
            assert (hard_negatives.product(a, b) == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]).all()


def trie_of(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    full, members, below = {}, defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    sums, out = {}, []
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        sums[p] = (sum(sums[x][0] for x in below[p]) or 1, sum(sums[x][1] for x in below[p]) + ((n - 1) * len(p[-1][1]) if p else 0))
        ends = ",".join(str(c) for c in sorted(members[p]) if full[c] == p)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(below[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def talk(n=330):
    rows = []
    for c in range(n):
        shared = ["hello", "yes", None, "é😀", "so"][: 1 + c % 5] if c % 3 else ["hello", "yes"]
        own = [] if c % 4 == 0 else [f"turn {c % 17}", "x" * (c % 7)]
        if c % 50 == 3:
            own = [f"long {i}" for i in range(60)] + own
        rows += [(c, i if i else None, ["user", "assistant", None][i % 3], t) for i, t in enumerate(shared + own)]
    return rows + [(None, 1, "user", "nobody's"), (100_000_007, 3, None, None), (-7, 1, "user", "hello")] + [(200 + i, 0, "user", "short") for i in (201, 203, 207)]


@pytest.mark.parametrize("limits", [(), (20, 40), (1, 1)])
def test_trie(spark, limits):
    rows = talk()
    table = spark.createDataFrame(rows, TURNS).withColumns({"seq": F.lit("own"), "key": F.lit(1)})
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.in_order(table)), *limits)
    assert sorted(map(tuple, found.collect()), key=str) == trie_of(rows)


def test_trie_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.op12_prefix_trie(empty).collect() == []
    # Conversation 1 has h = 5 and no base: turnless, so the root is a leaf that it ends at.
    rows = [(c, 0, "user", "only") for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6][:2]
    assert sorted(map(tuple, prefix_trie.op12_prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == trie_of(rows)
    duck = duckdb.connect()
    more = talk()
    duck.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", more)
    assert sorted(duck.sql(prefix_trie.ORACLE_SQL).fetchall(), key=str) == trie_of(more)


def nearest_of(rows, k, asked):
    at = {i: np.frombuffer(raw, "<f4").astype(float) for i, raw in usable(rows, False).items()}
    width = max(map(len, at.values()))
    at = {i: np.pad(v, (0, width - len(v))) for i, v in at.items()}
    out = {}
    for q in filter(asked, at):
        scores = {i: float(neighbours.exact(at[q][None], v[None])[0]) for i, v in at.items() if i != q}
        out[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


def test_neighbours_of_few_rows_are_all(spark):
    for n in (0, 1, 2, 15):
        rows = [(i * 10, [float(i % 4), 1.0, -0.5], None) for i in range(n)] + [(5, None, 1), (None, [1.0], 1), (7, [0.0, 0.0], 1), (8, [NAN, 1.0], 1), (9, [None, 1.0], 1)]
        found = neighbours.op13_neighbours(spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("own")))
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        want = {} if n < 2 else nearest_of(rows, 20, lambda i: i % 20 == 0)
        got = sorted(map(tuple, found.collect()))
        assert got == sorted((q, r, i, s) for q, v in want.items() for r, (i, s) in enumerate(v, 1))


@pytest.mark.parametrize("limits", [{}, {"part_rows": 64, "part_queries": 8}])
def test_neighbours_recall_ties_and_copies(spark, limits):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 24))
    x = centres[rng.integers(8, size=900)] + rng.normal(0, 0.5, (900, 24))
    x[300:600] = x[300]  # a third of the rows are one vector
    rows = [(int(i), [float(v) for v in x[i]], 0) for i in range(900)]
    rows += rows[:40] + [(1000, [1.0] * 5, 0)]
    found = neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("id") % 20 == 0, 20, "vec_id", "embedding", **limits).toPandas()
    want = nearest_of(rows, 20, lambda i: i % 20 == 0)
    hits = 0
    for q, group in found.groupby("query_id"):
        group = group.sort_values("rank")
        assert group["rank"].tolist() == list(range(1, 21)) and q not in set(group["id"])
        true = dict(want[q])
        hits += len(set(group["id"]) & set(true))
        assert all(true.get(i, s) == s for i, s in zip(group["id"], group["score"]))
        assert list(zip(-group["score"], group["id"])) == sorted(zip(-group["score"], group["id"]))
    assert set(found["query_id"]) == set(want) and hits >= 0.9 * 20 * len(want)


def test_probes_go_by_rising_cost_and_name_each_bucket_once():
    costs = sorted([0.1, 0.4, 0.45, 1.0, 1.1, 2.0])
    of = [0, 1, 0, 2, 1, 2]
    moves = list(neighbours._in_order(costs, of, 0.05, 2.0))
    sums = [sum(costs[j] for j in m) for m in moves]
    assert sums == sorted(sums) and len(set(moves)) == len(moves) == 27  # three choices for each of three projections
    few = list(neighbours._in_order(costs, of, 0.2, 0.5))
    assert few == moves[: len(few)] and 0.2 * sum(math.exp(-s) for s in sums[: len(few)]) >= 0.5


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_neighbours_recall_on_the_table(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = neighbours.op13_neighbours(table).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(found[ids[q]] & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(found)
