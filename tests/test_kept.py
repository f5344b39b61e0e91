"""Kept indexes, pooled tokens, label choice and budgets against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.operators import evaluation, inverted, labels, pooling
from rankframe.plans import search
from rankframe.streaming import spend

TOKENS = "id long, hidden array<array<float>>, attention array<int>, mask array<int>"


def pooled(spark, rows, how, head=None):
    return {r["id"]: r["vec"] for r in pooling.pool(spark.createDataFrame(rows, TOKENS), how, head).collect()}


def test_pooling(spark):
    hidden = [[[float(12 * b + 3 * i + j) for j in range(3)] for i in range(4)] for b in range(2)]
    rows = [(0, hidden[0], [1, 1, 0, 0], [1, 1, 0, 0]), (1, hidden[1], [1, 1, 1, 1], [0, 1, 1, 1])]
    assert pooled(spark, rows, "last") == {0: hidden[0][1], 1: hidden[1][3]}
    assert pooled(spark, rows, "cls") == {0: hidden[0][0], 1: hidden[1][0]}
    means = pooled(spark, [(0, [[1.0, 0.0], [0.0, 3.0], [9.0, 9.0]], [1, 1, 0], [1, 1, 0])], "mean")
    assert means == {0: [0.5, 1.5]}
    unit = pooled(spark, [(0, [[3.0, 4.0], [0.0, 2.0], [0.0, 0.0]], [1, 1, 1], [1, 1, 1])], "mean_tokennorm")
    assert unit[0] == pytest.approx([0.2, 0.6])
    # Ragged rows in one batch, nothing pooled, no token, nulls.
    odd = [(0, [[1.0, 2.0]], [1], [0]), (1, [], [], []), (2, None, None, None), (3, [[1.0, 1.0], [5.0, 5.0], [2.0, 0.0]], [0, 0, 0], [1, 0, 1])]
    assert pooled(spark, odd, "mean") == {0: [0.0, 0.0], 1: None, 2: None, 3: [1.5, 0.5]}
    assert pooled(spark, odd, "last") == {0: [1.0, 2.0], 1: None, 2: None, 3: None}
    assert pooled(spark, odd[:0], "cls") == {}
    for bad in ([(0, [[1.0]], [1, 1], [1])], [(0, [[1.0], [1.0, 2.0]], [1, 1], [1, 1])]):
        with pytest.raises(Exception, match="other numbers|differ in width"):
            pooled(spark, bad, "mean")
    with pytest.raises(ValueError):
        pooling.pool(spark.createDataFrame(odd, TOKENS), "max")
    with pytest.raises(ValueError):
        pooling.pool(spark.createDataFrame(odd, TOKENS), "latent")


def attended(head, token):
    """One token through the head, head by head and latent by latent."""

    def standard(x, norm):
        mean = sum(x) / len(x)
        spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x) + 1e-5)
        return [(v - mean) / spread * w + b for v, w, b in zip(x, *norm)]

    times = lambda x, m: [sum(a * m[i][j] for i, a in enumerate(x)) for j in range(m.shape[1])]
    q = times(standard(token, head.norms[0]), head.to_q)
    kv = [times(standard(list(latent), head.norms[1]), head.to_kv) for latent in head.latents]
    width, inner = len(q) // head.heads, len(q)
    met = []
    for h in range(head.heads):
        part = range(h * width, (h + 1) * width)
        e = [math.exp(sum(q[i] * k[i] for i in part) / math.sqrt(width)) for k in kv]
        met += [sum(w * k[inner + i] for w, k in zip(e, kv)) / sum(e) for i in part]
    x = [a + b for a, b in zip(times(met, head.to_out), token)]
    up = [a + b for a, b in zip(times(standard(x, head.norms[2]), head.up), head.up_bias)]
    half = len(up) // 2
    gated = [v * 0.5 * g * (1 + math.erf(g / math.sqrt(2))) for v, g in zip(up[:half], up[half:])]
    return [a + b + c for a, b, c in zip(times(gated, head.down), head.down_bias, x)]


def test_latent_pooling(spark):
    head = search.latent_head()
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(n, 8)).round(2).tolist(), [1] * n, [int(j % 3 != i % 3) for j in range(n)]) for i, n in enumerate((7, 1, 3, 0))]
    found = pooled(spark, rows, "latent", head)
    for i, hidden, _, mask in rows:
        used = [attended(head, np.float32(t).astype(float).tolist()) for t, m in zip(hidden, mask) if m]
        want = [sum(v) / len(used) for v in zip(*used)] if used else [0.0] * 8
        assert found[i] == pytest.approx(want, abs=1e-9) if hidden else found[i] is None
    whole = {(r["id"], r["part"]) for r in search.pooled_parts(spark, "/root/testdata/sf0.001", "latent", head).collect()}
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(whole) == 8 * n


def bm25(docs, queries, fields, k):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    scores = {q: defaultdict(float) for q, _ in queries}
    for f in fields:
        counts = {d["did"]: Counter(words(d[f])) for d in docs}
        sizes = {d: sum(c.values()) for d, c in counts.items()}
        mean = sum(sizes.values()) / len(sizes)
        df = Counter(t for c in counts.values() for t in c)
        for q, text in queries:
            for t in set(words(text)):
                for d, c in counts.items():
                    if c[t]:
                        scores[q][d] += math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 1.9 / (c[t] + 0.9 * (0.6 + 0.4 * sizes[d] / mean))
    out = set()
    for q, found in scores.items():
        best = sorted(((-round(s, 6), d) for d, s in found.items()))[:k]
        out |= {(q, d, r, round(-s, 4)) for r, (s, d) in enumerate(best, 1)}
    return out


def test_kept_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(vocabulary[int(i)] for i in np.minimum(rng.geometric(0.08, n), 59))
    docs = [{"did": i, "title": draw(int(rng.integers(0, 6))) or None, "text": draw(int(rng.integers(1, 60))) + (" rare" if i in (17, 190) else "")} for i in range(240)]
    queries = [(1, "w1 w2 RARE"), (2, "w3, w40 w58!"), (3, "unknown"), (4, None), (5, "rare rare"), (6, "w1")]
    path = f"file://{tmp_path}/index"
    frame = spark.createDataFrame(docs, "did long, title string, text string")
    for low, high in ((0, 150), (150, 151), (151, 240)):
        inverted.append_index(frame.where(f"did >= {low} AND did < {high}"), path, ("title", "text"), group_docs=16, buckets=3)
    asked = spark.createDataFrame(queries, "qid long, text string")
    tidy = lambda df: {(r["qid"], r["did"], r["rank"], round(r["score"], 4)) for r in df.collect()}
    found = inverted.search_index(spark, path, asked, 7)
    assert tidy(found) == bm25(docs, queries, ("title", "text"), 7) == tidy(inverted.search_index(spark, path, asked, 7, prune=False))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "title" not in plan and "_corrupt" not in plan  # documents are not read again
    assert inverted.search_index(spark, path, asked.limit(0)).collect() == []
    # A block holds a group's documents at most, and its maxima are those of its documents.
    blocks = spark.read.parquet(f"{path}/postings")
    assert blocks.where((F.col("n") != F.size("docs")) | (F.col("max_tf") != F.array_max("docs.tf")) | (F.col("min_len") != F.array_min("docs.len"))).count() == 0
    assert blocks.agg(F.max("n")).first()[0] < 40


def test_kept_index_equals_search_by_joins(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("did"), "text")
    queries = docs.where("did % 20 = 0").select(F.col("did").alias("qid"), F.substring("text", 1, 80).alias("text"))
    inverted.append_index(docs, f"file://{tmp_path}/index", group_docs=20)
    found = inverted.search_index(spark, f"file://{tmp_path}/index", queries, 5)
    assert sorted(map(tuple, found.select("qid", "did", "rank").collect())) == sorted(map(tuple, evaluation.bm25(docs, queries, 5).select("qid", "did", "rank").collect()))


LABELS = "label_id string, brand_names array<string>, generic_names array<string>, applications array<string>, effective_time string"


def test_label_choice(spark):
    rows = [
        ("a", ["Lopressor"], ["metoprolol tartrate"], ["NDA017963"], "20200101"), ("b", ["Lopressor"], ["Metoprolol Tartrate"], ["ANDA1"], "20240101"),
        ("c", ["Metoprolol"], ["metoprolol succinate"], [], "20250101"), ("d", ["Toprol-XL"], ["metoprolol succinate"], ["NDA19962", "NDA2"], "20230101"),
        ("e", ["Other brand"], ["unlike"], ["NDA0017963"], "20260101"), ("f", ["HCTZ combo"], ["x and hydrochlorothiazide"], ["NDA5"], "20200101"), ("g", ["Microzide"], ["hydrochlorothiazide"], ["NDA20504"], "20190101"),
        ("h", ["gen"], ["plain"], ["ANDA7"], "20200101"), ("i", ["gen"], ["plain"], ["ANDA8", "BLAx"], "20210101"), ("j", ["gen"], ["plain"], None, "20220101"), ("k", None, None, ["NDA1"], None), ("l", ["same day"], [None], ["NDA30"], "2020"), ("m", ["same day"], [], ["NDA30"], "2020"),
    ]
    asked = ["lopressor", "METOPROLOL", "metoprolol succinate", "hydrochlorothiazide", "gen", "nothing", "", None, "brand", "same/day", "gen"]
    frame = spark.createDataFrame(rows, LABELS)
    found = {r["name"]: tuple(r)[1:] for r in labels.choose_label(spark.createDataFrame([(n,) for n in asked], "name string"), frame).collect()}
    assert found == {
        # NDA017963 is the only original one; "c" is a brand of that name without an application, so "in generic" wins.
        "lopressor": ("brand", "NDA017963", "a"), "METOPROLOL": ("in generic", "NDA2", "d"), "metoprolol succinate": ("generic", "NDA2", "d"),
        "hydrochlorothiazide": ("generic", "NDA20504", "g"), "gen": ("brand", None, "j"), "nothing": (None, None, None), "": (None, None, None), None: (None, None, None),
        "brand": ("in brand", "NDA0017963", "e"), "same/day": ("brand", "NDA30", "l"),
    }
    assert labels.choose_label(spark.createDataFrame([], "name string"), frame).collect() == []


def test_label_choice_lists_no_matches(spark):
    """Every label matches one name: names meet one row a key and tier, and none is sent whole."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("label_id"), F.array(F.lit("Brand x")).alias("brand_names"), F.array(F.lit("g")).alias("generic_names"), F.array(F.format_string("NDA%05d", F.col("id") % 50 + 1)).alias("applications"), F.format_string("20%02d", F.col("id") % 9).alias("effective_time"))
    assert labels._by_key(rows).count() == 6 == labels._by_key(rows).where("filed AND o.application = 'NDA00001' AND newest.label_id = '1007'").count()
    found = labels.choose_label(spark.createDataFrame([("brand",), ("G",)], "name string"), rows)
    assert sorted(map(tuple, found.collect())) == [("G", "generic", "NDA00001", "1250"), ("brand", "in brand", "NDA00001", "1250")]
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


CALLS = "lane string, at long, usd double"


def spent(spark, folder, **limits):
    return spend.guarded_spend(spark, f"{folder}/in", CALLS, f"{folder}/out", f"{folder}/checkpoint", "lane", "at", "usd", **limits)


def add_calls(spark, folder, rows):
    spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_budget_stops_the_stream_and_restarts(spark, tmp_path):
    folder = f"file://{tmp_path}"
    add_calls(spark, folder, [("x", 1, 2.0), ("y", 2, 1.0), ("x", 4, None), ("x", 3, 1.0), (None, 5, 9.0)])
    found = spent(spark, folder, warn=3, abort=10)
    assert {(r["at"], r["total"], r["calls"], r["state"]) for r in found.collect()} == {(1, 2.0, 1, "ok"), (3, 3.0, 2, "warn"), (4, 3.0, 3, "warn"), (2, 1.0, 1, "ok"), (5, 9.0, 1, "warn")}
    assert spend.stopped(spark, f"{folder}/out") is None
    spend.check(spark, f"{folder}/out")
    add_calls(spark, folder, [("y", 6, 1.0), ("x", 7, 8.0), ("x", 8, 1.0)])  # x crosses at call 7
    add_calls(spark, folder, [("y", 9, 1.0)])
    assert {r["at"] for r in spent(spark, folder, warn=3, abort=10).collect()} == {1, 2, 3, 4, 5, 6, 7}
    assert [tuple(r) for r in spend.stopped(spark, f"{folder}/out").collect()] == [("x", 7, 11.0)]
    with pytest.raises(spend.BudgetReached, match="lane x spent 11.00 by call 7"):
        spend.check(spark, f"{folder}/out")
    add_calls(spark, folder, [("z", 10, 1.0)])
    assert {r["at"] for r in spent(spark, folder, warn=3, abort=10).collect()} == {1, 2, 3, 4, 5, 6, 7}  # stays stopped
