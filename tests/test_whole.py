"""Queries and operators against brute force where a part of the rows, the text or the ranking would not do."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankframe import plans
from rankframe.operators import assembly, evaluation, judging, naming, planning, vector
from rankframe.sources import files, raw_vectors

SF = "/root/testdata/sf0.001"


def test_recall_goes_as_deep_as_its_cuts(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").sort_by("vec_id")
    ids, labels, x = table["vec_id"].to_numpy(), table["label"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for i in range(len(ids)):
        score = np.round(x @ x[i], 6)
        score[i] = -np.inf
        good = (labels == labels[i])[np.lexsort((ids, -score))[:-1]]
        if good.any():
            want[int(ids[i])] = (good[:100].sum() / good.sum(), good[:1000].sum() / good.sum(), 1 / (np.argmax(good) + 1))
    got = {r["qid"]: (r["recall_100"], r["recall_1000"], r["mrr"]) for r in plans.queries()["a2_recall_100_1000"](spark, SF).collect()}
    assert set(got) == set(want) and all(got[q] == pytest.approx(want[q], abs=1e-5) for q in want)
    cut = {r["qid"]: r["recall_100"] for r in plans.queries()["a2_recall_100"](spark, SF).collect()}
    assert all(cut[q] == pytest.approx(want[q][0], abs=1e-5) for q in want)


def indel(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return len(a) + len(b) - 2 * int(best[-1, -1]) if a and b else 10**6


def test_title_edits_compare_whole_texts(spark, tmp_path):
    texts = ["abcde " * 20 + "end", "The " + "x y" * 40 + " Tail!", "ab", "", None, "short", "q" * 61 + "  zz -- z"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    norm = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split())
    got = {r["item_id"]: r["edits"] for r in plans.queries()["f4_title_edits"](spark, str(tmp_path)).collect()}
    assert got == {i: indel(norm(t or ""), norm((t or "")[2:])) for i, t in enumerate(texts)}


@pytest.mark.parametrize("count, budget", [(64, 20_000), (7, 0), (50, 90), (5000, 10**6)])
def test_length_packing_is_one_fold(spark, count, budget):
    rng = np.random.default_rng(5)
    lengths = [int(n) for n in rng.integers(0, 300, 9000)] + [0, 5000, 20_000, 20_001]
    want, width, held, batch = {}, 0, 0, 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if held and (held >= count or (budget and (held + 1) * width > budget)):
            batch, held = batch + 1, 0
        width = width if held else lengths[i]
        held += 1
        want[i] = (batch, lengths[i])
    rows = spark.createDataFrame(list(enumerate(lengths)), "id long, length long").repartition(7)
    got = assembly.pack_by_length(rows, count, budget).collect()
    assert len(got) == len(want) and {r["id"]: (r["batch"], r["length"]) for r in got} == want
    assert assembly.pack_by_length(rows.limit(0), count, budget).collect() == []


@pytest.mark.parametrize("n", [0, 1, 10, 64, 1000])
def test_even_sample_goes_by_position(spark, n):
    ids = [3 + 25 * i * i for i in range(n)]
    rows = spark.createDataFrame([(i,) for i in ids], "vec_id long").repartition(5)
    want = [ids[i] for i in np.linspace(0, n - 1, 64, dtype=np.int64)] if n else []
    assert sorted(r["vec_id"] for r in planning.evenly_spaced(rows, "vec_id", 64).collect()) == want


@pytest.mark.parametrize("k, block", [(3, 1024), (40, 7), (400, 50)])
def test_top_k_equals_brute_force_with_ties(spark, monkeypatch, k, block):
    """Few different vectors, so that most scores are tied; every task gives k rows a query at most."""
    monkeypatch.setattr(vector, "CORPUS_BLOCK", 16)
    rng = np.random.default_rng(k)
    kinds = rng.normal(size=(5, 4))
    corpus = [(i, kinds[rng.integers(5)].tolist()) for i in range(300)] + [(900, [0.0] * 4)]
    queries = [(1000 + i, rng.normal(size=4).tolist()) for i in range(20)] + [(7, corpus[7][1])]
    x, q = (np.array([v for _, v in rows]) for rows in (corpus, queries))
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1), 1e-12)[:, None]
    scores = np.round(unit(q) @ unit(x).T, 6)
    want = {}
    for (qid, _), row in zip(queries, scores):
        best = sorted((-s, i) for (i, _), s in zip(corpus, row) if i != qid)[:k]
        want |= {(qid, rank): (i, -s) for rank, (s, i) in enumerate(best, 1)}
    asked, table = spark.createDataFrame(queries, "qid long, vec array<double>"), spark.createDataFrame(corpus, "id long, vec array<double>").repartition(3)
    got = vector.top_k(asked, table, k, skip_self=True, block=block).collect()
    assert {(r["qid"], r["rank"]): (r["did"], pytest.approx(r["score"])) for r in got} == want
    blocks = vector._with_bytes(spark.createDataFrame([(0, [i for i, _ in queries], [v for _, v in queries])], "block long, qids array<long>, vecs array<array<double>>"))
    packed = vector._packed(table.select("id", F.col("id").alias("as_id"), "vec"), 16)
    assert vector._scan(packed, blocks, k, True, 6, False).count() <= 3 * k * len(queries)
    names = table.select("id", (F.col("id") % 50).alias("did"))
    distinct = vector.top_k_distinct(asked, table, k, names, block=block).collect()
    for (qid, _), row in zip(queries, scores):
        best = {}
        for (i, _), s in zip(corpus, row):
            best[i % 50] = max(s, best.get(i % 50, -2.0))
        expected = [i for _, i in sorted((-s, i) for i, s in best.items())][:k]
        assert [r["did"] for r in sorted(distinct, key=lambda r: r["rank"]) if r["qid"] == qid] == expected


def test_running_sums_over_many_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)) or None, i, int(rng.integers(10))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "lane long, at long, n long").repartition(7)
    want, sums = {}, {}
    for lane, at, n in rows:
        want[at] = sums.get(lane, 0)
        sums[lane] = want[at] + n
    assert {r["at"]: r["before"] for r in planning.running_before(frame, ["lane"], ["at"], "n").collect()} == want
    total = planning.running_before(frame, [], ["at"], "n")
    assert {r["at"]: r["before"] for r in total.collect()} == {i: sum(n for _, _, n in rows[:i]) for i in range(3000)}
    assert planning.running_before(frame.limit(0), ["lane"], ["at"], "n").collect() == []


def test_raw_shards(spark, tmp_path):
    rows = [(i * 3, [float(i), 0.5]) for i in range(50)]
    path = f"file://{tmp_path}/index"
    raw_vectors.write_raw_vectors(spark.createDataFrame(rows, "id long, vec array<float>").repartition(3), path, shard_rows=7)
    back = raw_vectors.read_raw_vectors(spark, path, 2)
    assert sorted((r["id"], r["vec"]) for r in back.collect()) == rows
    shard = next((tmp_path / "index" / "vectors").glob("*.fp16"))
    whole = shard.read_bytes()
    for content, message in ((whole[:-4], rf"{shard.stem}: \d+ vectors but"), (whole[:-1], "vectors but"), (whole[:-4] + np.array([np.nan, 1], "<f2").tobytes(), rf"{shard.stem}: vector row {len(whole) // 4 - 1} is not finite")):
        shard.write_bytes(content)
        with pytest.raises(Exception, match=message):
            raw_vectors.read_raw_vectors(spark, path, 2).count()
    shard.unlink()
    with pytest.raises(Exception, match="no ids, or ids but no vectors"):
        raw_vectors.read_raw_vectors(spark, path, 2).count()


def test_one_shard_is_read_by_many_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/one"
    raw_vectors.write_raw_vectors(spark.range(1000).select("id", F.array(F.col("id") % 100, F.lit(0.25)).alias("vec")).coalesce(1), path)
    back = raw_vectors.read_raw_vectors(spark, path, 2, range_rows=64)
    assert back.rdd.getNumPartitions() == 16 and len(list((tmp_path / "one" / "vectors").glob("*.fp16"))) == 1
    assert {(r["row_index"], r["id"], *r["vec"]) for r in back.collect()} == {(i, i, i % 100, 0.25) for i in range(1000)}


def test_zero_shot_lists(spark):
    papers = spark.createDataFrame(
        [(1, "A Study of Things", 50, ""), (2, "a study of things.", 1, "77"), (3, "Other matters entirely", 2, None), (4, "Other matters entirely", 9, None), (5, "", 1, "1")],
        "did long, title string, cited int, pmid string",
    )
    lists = [(1, 0, " A study of thinks "), (1, 1, "A study of things"), (1, 2, "Invented by a model"), (1, 3, "A study of things"), (1, 4, ""), (1, 5, None), (1, 6, "Other matters: entirely"), (2, 0, "Other matter entirely")]
    found = evaluation.zero_shot(spark.createDataFrame(lists, "qid long, place long, title string"), papers, keep=1)
    got = {(r["qid"], r["place"]): (r["did"], r["edits"], r["kept"]) for r in found.collect()}
    assert got == {(1, 0): (2, 2, 1), (1, 1): (2, 0, None), (1, 2): (None, None, None), (1, 6): (4, 0, None), (2, 0): (4, 1, 1)}
    rates = {r["qid"]: (r["listed"], r["unresolved"], r["rate"]) for r in evaluation.hallucination_rate(found, "qid").collect()}
    assert rates == {1: (4, 1, 0.25), 2: (1, 0, 0.0)}


def test_best_match(spark):
    cited = spark.createDataFrame([(1, "Some title here.", "2001", "Smith A"), (2, "Else", "", "")], "cid long, title string, year string, author string")
    records = [(1, 0, 10, "Some title here", "1990", "Smith"), (1, 1, 11, "Some titles here", "2002", "SMITH"), (1, 2, 12, "Some title heres", "2000", "smith"), (1, 3, 13, "Some title here", "2001", "Jones")]
    frame = spark.createDataFrame(records, "cid long, place long, did long, title string, year string, author string")
    got = {r["cid"]: (r["did"], r["edits"], r["accepted"]) for r in evaluation.best_match(cited, frame, "cid").collect()}
    assert got == {1: (11, 1, True), 2: (None, None, None)}


def test_replace_is_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    files.replace_table(spark.range(3), path)
    before = files.read_current(spark, path)
    with pytest.raises(Exception, match="half way"):
        files.replace_table(spark.range(9).select(F.when(F.col("id") > 4, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).alias("id")), path)
    assert files.read_current(spark, path).count() == 3
    files.replace_table(spark.range(5), path)
    assert (files.read_current(spark, path).count(), before.count()) == (5, 3)


@pytest.mark.parametrize("budget", [1, 200])
def test_names_in_texts_take_as_many_passes_as_they_need(spark, budget):
    names = [(1, "Heart"), (1, " art "), (2, "ÉCOLE"), (3, ""), (4, None), (5, "a b"), (6, "heart")]
    texts = [(1, "HEARTH", None), (2, "école a", "b"), (3, None, None), (4, "nothing", "art art"), (1, "hearth", "x")]
    found = naming.named_concepts(spark.createDataFrame(texts, "did long, title string, body string"), spark.createDataFrame(names, "cid long, name string"), ("title", "body"), most_bytes=budget)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 6), (2, 2), (2, 5), (4, 1)]
    assert naming.named_concepts(spark.createDataFrame(texts, "did long, title string, body string"), spark.createDataFrame([], "cid long, name string"), ("title",)).collect() == []


def test_searches_of_a_small_budget_take_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(120)]
    table = spark.createDataFrame(rows, "id long, vec array<float>")
    asked = table.select(F.col("id").alias("qid"), "vec")
    whole = sorted(map(tuple, vector.top_k(asked, table, 5, skip_self=True, block=16).collect()))
    assert vector.pass_queries(4, 5, 16, 4) > 120 and vector.pass_queries(1024, 1000, 1024, 8) < 32768
    monkeypatch.setattr(vector, "HELD_BYTES", 2 * 24 * 5 * 40)
    found = vector.top_k(asked, table, 5, skip_self=True, block=16)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 4
    assert sorted(map(tuple, found.collect())) == whole


def test_self_check_refuses(spark):
    stored = spark.createDataFrame([(i, [1.0, float(i % 5)]) for i in range(400)], "id long, vec array<float>")
    assert tuple(vector.self_check(stored, stored, 16, 0.999).first()) == (16, pytest.approx(1.0), pytest.approx(1.0))
    turned = stored.select("id", F.reverse("vec").alias("vec"))
    few = stored.where("id < 60")
    for fresh in (turned, few, stored.limit(0), stored.select("id", F.slice("vec", 1, 1).alias("vec"))):
        with pytest.raises(Exception, match="does not reproduce"):
            vector.self_check(stored, fresh, 16, 0.999).collect()


def test_rankings_after_each_hop(spark):
    rows = [("q", "10", 0, "d"), ("q", "2", 1, "b"), ("q", "2", 0, "a"), ("q", "end", 0, "a"), ("q", "end", 1, "e"), ("q", "10", 1, "a"), ("q", None, 0, "z"), ("q", "2", 5, None), ("r", "x", 0, "a")]
    found = {(r["qid"], r["hop"], r["rank"], r["did"]) for r in evaluation.hop_rankings(spark.createDataFrame(rows, "qid string, hop string, place long, did string")).collect()}
    lists = {("q", "2"): "ab", ("q", "10"): "abd", ("q", "end"): "abde", ("r", "x"): "a"}
    assert found == {(q, h, i, did) for (q, h), dids in lists.items() for i, did in enumerate(dids, 1)}


def test_assembled_index_refers_to_its_shards(spark, tmp_path):
    base, out = f"file://{tmp_path}/base", f"file://{tmp_path}/out"
    rows = spark.range(60).select("id", F.array(F.col("id"), F.lit(1)).alias("vec"))
    for part in range(3):
        raw_vectors.write_raw_vectors(rows.where(f"id % 3 = {part}").coalesce(1), base, prefix=f"s{part}-")
    added = spark.range(100, 105).select("id", F.array(F.lit(0), F.col("id")).alias("vec"))
    raw_vectors.assemble_index([base], added.coalesce(1), out, ("s1-000000-0000",))
    back = raw_vectors.read_assembled(spark, out, 2, range_rows=8)
    assert {r["id"] for r in back.collect()} == {i for i in range(60) if i % 3 != 1} | set(range(100, 105)) and back.rdd.getNumPartitions() == 7
    assert [p.name for p in (tmp_path / "out" / "vectors").glob("*.fp16")] == ["added000000-0000.fp16"]
    for bases, left_out, message in (([base], ("none",), "no shard none"), ([base, base], (), "two shards of one name")):
        with pytest.raises(ValueError, match=message):
            raw_vectors.assemble_index(bases, added.coalesce(1), f"file://{tmp_path}/{len(bases)}", left_out)
    (tmp_path / "base" / "vectors" / "s0-000000-0000.fp16").unlink()
    with pytest.raises(Exception, match="named, but not in"):
        raw_vectors.read_assembled(spark, out, 2).count()


def test_guards_refuse(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, " ", 1), (3, None, 2), (4, "b", 2)], "k long, text string, g int")
    assert tuple(files.no_blanks(docs, "text", 0.5).first()) == (4, 2) and tuple(files.even_groups(docs, "g").first()) == (2, 2, 2)
    pinned = files.manifest(docs, "k", "text").first()
    assert files.same_manifest(files.manifest(docs.repartition(3), "k", "text"), *pinned).first() == pinned
    assert tuple(files.all_settled(docs, planning.settled(F.col("k"), F.col("k"), F.lit(0))).first()) == (4, 0)
    for refused in (
        files.no_blanks(docs, "text", 0.4), files.even_groups(docs.where("k > 1"), "g"), files.same_manifest(files.manifest(docs.where("k < 4"), "k", "text"), *pinned),
        files.same_manifest(files.manifest(docs.withColumn("text", F.lit("a")), "k", "text"), *pinned), files.all_settled(docs, planning.settled(F.col("k"), F.lit(1), F.lit(0))),
    ):
        with pytest.raises(Exception, match="blank|differ in size|not the one|not settled"):
            refused.collect()


def test_judge_inputs(spark):
    questions = spark.createDataFrame([("q1", "why {{n}}"), ("q2", "what"), ("q3", None)], "qid string, question string")
    sources = [("q1", "ours", 2, "w2", None, None, None), ("q1", "ours", 1, None, "T", "V", "1999"), ("q1", "ours", 3, "w1", None, None, None), ("q1", "other", 1, "w1", None, None, None), ("q1", "other", 1, "gone", None, None, None), ("q2", "other", 1, "w2", None, None, None), ("no", "ours", 1, "w1", None, None, None)]
    frame = spark.createDataFrame(sources, "qid string, side string, place int, work_id string, title string, venue string, year string")
    records = spark.createDataFrame([("w1", "One", "v1", "2001", "abs {{n}}"), ("w2", "Two", None, "2002", "abs2")], "work_id string, title string, venue string, year string, abstract string")
    shown = {}
    for flip in (False, True):
        for name, more in (("all", {}), ("even", {"same_length": True}), ("records", {"records_only": True, "keep": 2})):
            made = judging.judge_inputs(questions, frame, records, "{{question}}|{{list_a}}|{{list_b}}", "{{n}} {{title}}/{{venue}}/{{abstract}}", "{{n}}: {{title}}, {{year}}", "r", flip=flip, **more)
            shown |= {(name, r["qid"], flip): (r["ours_is"], r["n_ours"], r["n_other"], r["prompt"]) for r in made.collect()}
    for qid in ("q1", "q2", "q3"):
        assert shown["all", qid, False][0] != shown["all", qid, True][0]
    lists = {("all", "q1"): ("1: T, 1999\n2 Two//abs2\n3 One/v1/abs {{n}}", "1 //\n2 One/v1/abs {{n}}"), ("even", "q1"): ("1: T, 1999\n2 Two//abs2", "1 //\n2 One/v1/abs {{n}}"), ("records", "q1"): ("1 Two//abs2", "1 //\n2 One/v1/abs {{n}}"), ("all", "q2"): ("", "1 Two//abs2"), ("even", "q2"): ("", "")}
    for (name, qid), (ours, other) in lists.items():
        for flip in (False, True):
            first, n_ours, n_other, prompt = shown[name, qid, flip]
            assert prompt == "|".join(({"q1": "why {{n}}", "q2": "what"}[qid], *((ours, other) if first == "A" else (other, ours))))
            assert (n_ours, n_other) == tuple(len(x.splitlines()) for x in (ours, other))
    assert shown["all", "q3", False][1:] == (0, 0, "||")
