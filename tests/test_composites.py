"""Errors and empty inputs of the composite steps, sources and runs."""

import pytest
from pyspark.sql import functions as F

from rankframe.operators import composites as C
from rankframe.sources import files, snapshots
from rankframe.streaming import runs

TAXONOMY = "id string, subtypes array<struct<id: string, anchors: array<string>, ask: string>>"
ASIDE = "type_id string, subtype_id string, side_ask string"


def flatten(spark, subtypes, aside=(), tracks=None):
    types = spark.createDataFrame([("t", subtypes)], TAXONOMY)
    return C.drawable_subclasses(types, spark.createDataFrame(list(aside), ASIDE), tracks or {"drug": "drugs"}).collect()


def test_taxonomy_errors_and_rules(spark):
    assert flatten(spark, [("a", ["none"], "x"), ("b", None, "x"), ("c", [], "x")]) == []
    assert [r["ask"] for r in flatten(spark, [("a", ["drug"], "own")], [("t", "a", "aside")])] == ["aside"]
    with pytest.raises(Exception, match="unknown anchor organ"):
        flatten(spark, [("a", ["organ"], "x")])
    for ask in (None, ""):
        with pytest.raises(Exception, match="no ask for t.a"):
            flatten(spark, [("a", ["drug"], ask)])


def test_unknown_lane_is_an_error(spark):
    with pytest.raises(ValueError, match="nowhere"):
        C.only_lanes({"en": spark.range(1)}, ["en", "nowhere"])


def test_first_usable_without_a_good_attempt(spark):
    rows = spark.createDataFrame([(1, a, a) for a in range(9)], "cell long, attempt long, hits long")
    (row,) = C.first_usable(rows, min_hits=7).collect()
    assert (row["attempt"], row["hits"], row["redraws"]) == (None, 5, 5)


def test_partition_check_finds_strays(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    assert tuple(C.partition_check(ids(1, 2, 3), ids(1, 2), ids(2, 9), "k").first()) == (3, 2, 2, 1, 2)


def test_labels_without_a_match_and_malformed(spark):
    table = spark.createDataFrame([(1, '{"openfda": {"brand_name": ["Abc"]}}'), (2, "{"), (3, None)], "id long, body string")
    assert [r["id"] for r in snapshots.search_labels(table, "ABC").collect()] == [1]
    assert snapshots.search_labels(table, "zzz").count() == 0


def test_article_without_record(spark):
    none = spark.createDataFrame([], "body string")
    (row,) = snapshots.articles(none, spark.createDataFrame([("7",)], "pmid string")).collect()
    assert tuple(row) == ("7", "(title unavailable)", "", "", "")


def test_wave_retries_only_failures(spark):
    out, seen = files.scratch(spark, "waves"), []
    spark.createDataFrame([], "k long").write.parquet(out)
    for fails in (1, 99):
        def work(todo, fails=fails):
            seen.append(sorted(r["k"] for r in todo.collect()))
            return todo.where(F.col("k") != fails)

        runs.run_wave(spark.createDataFrame([(0,), (1,), (2,)], "k long"), work, out, "k")
    assert seen == [[0, 1, 2], [1]]


def test_lock_is_free_after_an_error(spark):
    folder = files.scratch(spark, "lock")
    with pytest.raises(KeyError), runs.single_writer(spark, folder):
        raise KeyError
    with runs.single_writer(spark, folder):
        with pytest.raises(RuntimeError), runs.single_writer(spark, folder):
            pass
