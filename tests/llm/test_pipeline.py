"""The pipeline's stages on a small fixture against brute force, each on its predecessor's rows."""

import random
import re
from collections import Counter

import corpus_pipeline
from rankframe.llm import quality
from test_corpus_ops import brute_components, brute_mix, junk, shingles, similar

NAMES = ["quality", "exact_dedup", "near_dedup", "mix", "pack"]


def fixture(spark, folder):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(15, 90))
        bad = rng.random() < 0.2
        text = junk(rng, words) if bad else " ".join(words).capitalize() + "."
        if rows and rng.random() < 0.2:
            text = rows[rng.randrange(len(rows))][1].replace(" ", "  ", rng.randint(0, 2))
        elif rows and rng.random() < 0.2:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        rows.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
        if i % 2:
            labels.append((i, int("!!" not in text and not re.search(r"[*$%|]", text)), 0))
    rows += [rows[3], rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    fixture(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = [tuple(r) for r in docs.collect()]
        assert name == "pack" or docs.columns == columns

    first = spark.read.parquet(f"{folder}/documents.parquet")
    scores = quality.score_documents(first, quality.train(first, spark.read.parquet(f"{folder}/labels.parquet")))
    good = {r["doc_id"] for r in scores.where("score >= 0.3").collect()}
    assert sorted(out["quality"]) == sorted(tuple(r) for r in first.collect() if r["doc_id"] in good)

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    least = {}
    for r in out["quality"]:
        least[norm(r[1])] = min(r[0], least.get(norm(r[1]), r[0]))
    assert sorted(out["exact_dedup"]) == sorted({r for r in out["quality"] if least[norm(r[1])] == r[0]})

    sets = {r[0]: shingles(r[1]) for r in out["exact_dedup"]}
    component = brute_components(sets, lambda a, b: similar(sets[a], sets[b]))
    assert sum(component[d] != d for d in sets) > 15
    assert sorted(out["near_dedup"]) == sorted(r for r in out["exact_dedup"] if component[r[0]] == r[0])

    size, totals, target = brute_mix([(r[0], r[1], r[3]) for r in out["near_dedup"]])
    taken = Counter()
    for r in out["mix"]:
        taken[r[3]] += size[r[0]]
    assert set(out["mix"]) <= set(out["near_dedup"]) and max(Counter(out["mix"]).values()) <= 2
    assert all(target[s] - max(size.values()) <= taken[s] <= target[s] + 1e-6 for s in totals)
    kept = Counter(r[0] for r in out["mix"])
    assert {d: sum(1 for p in out["pack"] if p[0] == d and p[1] == 0) for d in kept} == dict(kept)
    assert sum(p[2] for p in out["pack"]) == sum(p[4] for p in out["pack"] if p[1] == 0)


def test_near_copies_under_null_and_shared_ids(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30)) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0])] + [(7, t) for t in texts[4:7]] + [(None, texts[4]), (9, texts[7]), (8, texts[7] + " ")]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:7]] + [(8, texts[7] + " ")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
