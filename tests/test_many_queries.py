"""Searches of as many queries as rows, and metrics whose positives are classes, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.operators import composites, metrics, naming, vector


def near(x, k, cosine, skip_self=True):
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None] if cosine else x
    scores = np.round(unit @ unit.T, 6)
    best = lambda i: sorted((-s, j) for j, s in enumerate(scores[i]) if not (skip_self and i == j))[:k]
    return {(i, rank): (j, pytest.approx(-s)) for i in range(len(x)) for rank, (s, j) in enumerate(best(i), 1)}


@pytest.mark.parametrize("sent", [vector.SENT_BYTES, 2000])
@pytest.mark.parametrize("kind", ["random", "copies", "large", "tiny k"])
def test_searches_dealt_by_queries(spark, monkeypatch, kind, sent):
    for name, value in (("DEALT_QUERIES", 1), ("PART_QUERIES", 64), ("CORPUS_BLOCK", 32), ("SENT_BYTES", sent)):
        monkeypatch.setattr(vector, name, value)
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(300, 6)).astype(np.float32).astype(float)
    if kind == "copies":  # most scores are tied
        x[20:] = x[rng.integers(3, size=280)]
        x[7] = 0
    if kind == "large":  # beyond what 32-bit products hold
        x[::50] *= 2.0**60
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").repartition(3)
    asked, k = table.select(F.col("id").alias("qid"), "vec"), 2 if kind == "tiny k" else 9
    for metric in ("cosine", "dot") if kind != "large" else ("cosine",):
        found = vector.top_k(asked, table, k, metric=metric, skip_self=True)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("Window" in plan) == (sent == 2000)  # one pass shuffles no scored row
        rows = found.collect()
        assert {(r["qid"], r["rank"]): (r["did"], r["score"]) for r in rows} == near(x, k, metric == "cosine") and len(rows) == 300 * k


def test_queries_are_joined_to_no_rows_and_rows_come_in_shares(spark, monkeypatch):
    """A join holds all rows that one row makes: none of them repeats the queries' vectors, and none makes the whole corpus."""
    for name, value in (("DEALT_QUERIES", 1), ("PART_QUERIES", 64), ("CORPUS_BLOCK", 16), ("SHARE_BLOCKS", 2)):
        monkeypatch.setattr(vector, name, value)
    x = np.random.default_rng(4).normal(size=(300, 6)).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").repartition(3)
    joined, real = [], type(table).mapInArrow
    monkeypatch.setattr(type(table), "mapInArrow", lambda df, *a, **b: joined.append(df) or real(df, *a, **b))
    rows = vector.top_k(table.select(F.col("id").alias("qid"), "vec"), table, 9, skip_self=True).collect()
    assert {(r["qid"], r["rank"]): (r["did"], r["score"]) for r in rows} == near(x, 9, True)
    sent = joined[-1].select(F.col("queries").isNotNull().alias("asks"), F.col("vectors").isNotNull().alias("meets"), F.size("names").alias("n")).collect()
    assert not any(r["asks"] and r["meets"] for r in sent)
    blocks = sum(r["asks"] for r in sent)
    assert 5 <= blocks < 10 and sum(r["n"] for r in sent if r["meets"]) == 300 * blocks


@pytest.mark.parametrize("skip_self", [True, False])
def test_few_pairs_of_a_block_are_scored_in_64_bits(monkeypatch, skip_self):
    """Neither the first block, where no query has a floor, nor a later one is scored whole, but for a rare query that it crowds."""
    rng, k, scored, whole = np.random.default_rng(1), 20, [], []
    x = rng.normal(size=(6000, 6)).astype(np.float32)
    x[4000:4400] = x[:400]
    monkeypatch.setattr(vector, "_exact", lambda *a, real=vector._exact: whole.append(len(a[4])) or real(*a))
    monkeypatch.setattr(vector.np, "einsum", lambda how, a, b, real=np.einsum: scored.append(len(a)) or real(how, a, b))
    asked, held = vector._Block(x[:600].tobytes(), 6, "<f4", True), vector._Lists(np.arange(600), k)
    for low in range(0, 6000, 1500):
        names = np.arange(low, low + 1500)
        vector._meet(asked, held, vector._Block(x[names].tobytes(), 6, "<f4", True), names, k, 6, skip_self, True)
    rows = held.rows().to_pydict()
    unit = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = np.round(unit[:600] @ unit.T, 6)
    if skip_self:
        want[np.arange(600), np.arange(600)] = -np.inf
    order = np.argsort(-want, axis=1, kind="stable")[:, :k]
    assert rows["qid"] == np.repeat(np.arange(600), k).tolist() and rows["did"] == order.ravel().tolist()
    assert rows["score"] == pytest.approx(np.take_along_axis(want, order, axis=1).ravel().tolist())
    assert sum(scored) < 600 * 5 * k < 600 * 6000 / 50 and sum(whole) < 0.02 * 600 * 4


def test_lists_keep_the_best_of_ties_as_they_overflow():
    rng, n, k = np.random.default_rng(2), 30, 7
    held, seen = vector._Lists(np.arange(100, 100 + n), k), [[] for _ in range(n)]
    ids = rng.permutation(5000)
    for step in range(40):
        at = np.sort(rng.integers(n if step % 3 else 2, size=14))
        rows = ids[step * 14 : step * 14 + 14]
        scores = rng.integers(-3, 3, size=14) / 2
        held.add(at, rows, scores)
        for q, d, s in zip(at, rows, scores):
            seen[q].append((-s, int(d)))
    out = held.rows().to_pydict()
    want = [(100 + q, d, -s) for q in range(n) for s, d in sorted(seen[q])[:k]]
    assert list(zip(out["qid"], out["did"], out["score"])) == want


def class_rows(spark):
    rng = np.random.default_rng(3)
    kinds = [(i, int(rng.integers(4)) if i % 9 else None) for i in range(60)] + [(60, 77)]
    run = [(q, int(d), rank) for q in range(61) if q % 7 for rank, d in enumerate(rng.permutation([i for i in range(61) if i != q])[:12], 1)]
    return spark.createDataFrame(kinds, "id long, cls int"), spark.createDataFrame(run, "qid long, did long, rank int")


def test_classes_give_what_their_pairs_give(spark):
    classes, run = class_rows(spark)
    a, b = classes.where("cls IS NOT NULL"), classes.select(F.col("id").alias("did"), "cls")
    qrels = a.join(b, "cls").where("id <> did").select(F.col("id").alias("qid"), "did", F.lit(1).alias("rel"), "cls")
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for missing in ("skip", "zero"):
        options = {"cuts": (3, 10), "recall_cuts": (5, 100), "missing": missing}
        found = metrics.per_query_of_classes(run, classes, **options)
        assert rows(found) == rows(metrics.per_query(run, qrels, **options)) and found.count() > 30
        assert "cls" not in found._jdf.queryExecution().analyzed().output().toString()
    assert rows(metrics.unretrieved_of_classes(run, classes, "cls").drop("queries")) == rows(metrics.unretrieved(qrels, run, "cls"))
    assert rows(metrics.unretrieved_of_classes(run, classes).drop("queries")) == rows(metrics.unretrieved(qrels, run))
    assert rows(composites.unretrieved_report_of_classes(run, classes)) == rows(composites.unretrieved_report(qrels, run, "cls").withColumn("class", F.col("class")))
    assert rows(metrics.missed_of_classes(run, classes)) == rows(qrels.select("qid", "did").join(run, ["qid", "did"], "left_anti"))


@pytest.mark.parametrize("chunk", [3, 4096])
def test_missed_pairs_come_of_chunks_of_a_class(spark, monkeypatch, chunk):
    monkeypatch.setattr(metrics, "CHUNK", chunk)
    classes, run = class_rows(spark)
    a, b = classes.where("cls IS NOT NULL"), classes.select(F.col("id").alias("did"), "cls")
    pairs = a.join(b, "cls").where("id <> did").select(F.col("id").alias("qid"), "did")
    found = metrics.missed_of_classes(run, classes)
    assert sorted(found.collect()) == sorted(pairs.join(run, ["qid", "did"], "left_anti").collect())
    assert "explode(ids" in found._jdf.queryExecution().optimizedPlan().toString()
    assert not metrics.missed_of_classes(run, classes.where("id < 0")).count()


@pytest.mark.parametrize("group", [2, 2048])
def test_texts_are_counted_by_concept_without_their_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(naming, "GROUP_IDS", group)
    names = [(1, "Heart"), (1, " art "), (2, "ÉCOLE"), (3, ""), (4, None), (5, "a b"), (6, "heart"), (7, "heart"), (8, "nowhere"), (9, "nowhere"), (9, "o")]
    texts = [(1, "HEARTH"), (2, "école a b"), (3, None), (4, "nothing art art"), (1, "hearth x"), (5, "heart"), (6, "zzz")]
    texts, names = spark.createDataFrame(texts, "did long, text string"), spark.createDataFrame(names, "cid long, name string")
    found = naming.texts_by_concept(texts, names)
    want = naming.named_concepts(texts, names).groupBy("cid").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() == 6
    assert "did" not in str(found._jdf.queryExecution().optimizedPlan().output())
    assert naming.texts_by_concept(texts, names.limit(0)).collect() == [] and naming.texts_by_concept(texts.limit(0), names).collect() == []
