"""Every operator and stage on tables with clashing extra columns, on empty tables and on rows of nulls."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankframe.llm import chat, exact_dedup, html_text, mixing, packing, pii, quality, rules, simhash, token_counts

#: Names that the operators use themselves, in any case.
CLASH = (
    "mark", "fp", "digest", "hash", "size", "keep_id", "component_id", "kept", "score", "sha", "locator", "DIGEST_", "Size_", "label", "picked_id", "order", "x", "n", "ids", "at", "part", "local", "base",
    "mix_source", "mix_size", "mix_target", "mix_rounds", "mix_threshold", "mix_copies", "mix_copy", "__mark", "__id", "__of", "__scored_text", "count", "of", "best", "target", "source_size", "window",
)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
OPERATORS = {
    "pii": pii.op1_pii, "packing": packing.pack, "simhash": simhash.op5_simhash, "mixing": mixing.op7_mixing, "exact": exact_dedup.op8_exact_dedup, "tokens": token_counts.count_tokens,
}


def rows(n):
    texts = [None, "", "One two three four five six seven eight nine ten eleven.", "!! | || $ $ $ %% # #", "plain words of a text that is clean and long enough to be kept by rules."]
    return [(None if i == 7 else i, texts[i % 5], None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None) for i in range(n)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 != 3), 0) for i in range(40)] + [(None, 1, 0), (4, None, None)], LABELS)


def clashing(spark, n=40):
    docs = spark.createDataFrame(rows(n), DOCS)
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    plain = sorted(map(str, OPERATORS[name](spark.createDataFrame(rows(40), DOCS)).collect()))
    assert len(plain) >= 40
    if name != "packing":
        assert sorted(map(str, OPERATORS[name](clashing(spark)).collect())) == plain
    else:
        assert OPERATORS[name](clashing(spark)).count() == len(plain)
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("operator", [quality.op4_quality, rules.op6_rules])
def test_judges(spark, labels, operator):
    plain = operator(spark.createDataFrame(rows(40), DOCS), labels).collect()
    clash = operator(clashing(spark), labels.withColumn("order", F.lit(1)).withColumn("text", F.lit("x"))).collect()
    assert sorted(map(str, plain)) == sorted(map(str, clash)) and len(plain) == 40
    assert operator(spark.createDataFrame([], DOCS), labels).collect() == []
    assert len(operator(clashing(spark), spark.createDataFrame([], LABELS)).collect()) == 40


def test_pages_and_turns(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>Some words here</p>", 2), (2, "v", "", 3)], "page_id long, url string, html string, text int")
    found = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert found[1]["text"] == found[2]["text"] == "" and found[1]["n_chars"] == 0 and set(found) == {1, 2, None}
    assert html_text.extract(pages.limit(0)).collect() == []
    turns = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "tool", '{"tool_call_id": "a", "content": 1}', 2), (1, 1, "assistant", "<tool_call>{", 3)], "conv_id long, turn int, role string, text string, call_id int")
    assert chat.op3_chat(turns).count() == 3
    assert chat.op3_chat(turns.limit(0)).collect() == []


@pytest.mark.parametrize("size", [0, 40])
def test_stages_keep_extra_columns(spark, labels, tmp_path, size):
    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    clashing(spark, size).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert name == "pack" or docs.columns == columns
        assert bool(size) == bool(docs.count())
        if name != "pack":
            assert docs.where("score <> 'own score' OR `__mark` <> 'own __mark' OR mix_copies <> 'own mix_copies'").count() == 0
