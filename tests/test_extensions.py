"""Errors and edge cases of banks, settings and replaceable parts."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankframe.operators import plugins, settings
from rankframe.sources import banks, files

ROOT = Path(__file__).resolve().parent.parent


def points(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, vec array<float>")


def test_index_checks(spark):
    path = files.scratch(spark, "index")
    banks.write_index(points(spark, (1, [1.0, 2.0]), (2, [1.0]), (3, None)), path, dim=2)
    with pytest.raises(ValueError, match="expected 3"):
        banks.read_index(spark, path, 3)
    with pytest.raises(Exception, match="not of 2 dimensions"):
        banks.read_index(spark, path, 2).collect()
    points(spark, (4, [1.0, 2.0])).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="4 rows"):
        banks.read_index(spark, path, 2)


def test_bank_round_trip(spark):
    path = files.scratch(spark, "bank")
    config = {"model": "m", "cut": [1, None]}
    banks.write_bank(points(spark, (1, [0.5])), points(spark), config, path)
    docs, queries, back = banks.read_bank(spark, path)
    assert [tuple(r) for r in docs.collect()] == [("1", [0.5])] and queries.count() == 0 and back == config


def test_query_vectors_need_an_order(spark):
    with pytest.raises(ValueError):
        banks.query_vectors(points(spark, (1, [0.5])).drop("id"))


def test_snapshot_must_be_pinned(spark):
    root, rows = files.scratch(spark, "snapshots"), spark.createDataFrame([("1",)], "id string")
    banks.write_snapshot({"corpus": rows}, root, "b", "r1")
    with pytest.raises(KeyError, match="pinned"):
        banks.read_snapshot(spark, root, "b", {})
    with pytest.raises(Exception, match="(?i)exists"):
        banks.write_snapshot({"corpus": rows}, root, "b", "r1")


def test_split_scan_needs_bounds(spark):
    with pytest.raises(ValueError, match="bounds"):
        banks.read_database(spark, "jdbc:none", "t", "k")


def test_database_is_read_from_other_machines(tmp_path):
    """Two executors of their own JVMs, which share nothing with the driver but the checkpoint folder."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from rankframe import plans
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared")
    .config("spark.sql.warehouse.dir", "file://{tmp_path}/warehouse").getOrCreate())
print("rows:", plans.queries()["s12_database_scan"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, cwd=tmp_path)
    assert "rows: 15" in done.stdout, done.stderr[-2000:]


def test_expanded():
    known = {"A": "1", "EMPTY": ""}
    assert settings.expanded({"x": ["${A}-${B:-two}", 3], "y": "${EMPTY:-}", "z": None}, known) == {"x": ["1-two", 3], "y": "", "z": None}
    for unset in ("${EMPTY}", "${B}"):
        with pytest.raises(KeyError):
            settings.expanded(unset, known)


def test_quoted_list():
    assert settings.quoted_list(["a", "b c"]) == "'a', 'b c'" and settings.quoted_list([]) == ""
    with pytest.raises(ValueError):
        settings.quoted_list(["a", "b' OR '1'='1"])


def test_run_settings():
    tasks = {"t": None, "u": {"dir": "v", "instructions": {"default": "Do", "long": "Do it."}, "doc_instructions": {"long": "D"}, "ignore_identical_ids": True}}
    benchmark = {"name": "b", "data": "/{task}", "dtype": "f16", "max_length": 9, "tasks": tasks, "model_overrides": {"other": {"dtype": "f8"}}}
    of = lambda task, **model: settings.run_settings({"name": "m", **model}, benchmark, task)
    plain = {"folder": "/t", "precision": "f16", "tokens": 9, "query_prompt": "", "document_prompt": "", "drop_own_id": False}
    assert of("t", instruction_suffix=".") == plain
    prompt = lambda **model: of("u", **model)["query_prompt"]
    assert (prompt(instruction_suffix="."), prompt(instruction_set="long", instruction_suffix=".")) == ("Do.", "Do it.")
    assert prompt(use_instruction=False) == "" and of("u", instruction_set="long")["document_prompt"] == "D" and of("u")["drop_own_id"]
    assert (of("u", max_length=100, max_length_cap=5)["tokens"], of("u", dtype="f32")["precision"], of("u", name="other", dtype="f32")["precision"]) == (5, "f32", "f8")
    assert of("u")["folder"] == "/v" and of("u", max_length=None)["tokens"] == 9
    with pytest.raises(KeyError):
        of("w")


def test_layers():
    found = settings.Layered({"a": {"b": 1, "c": 2}, "d": 5}, {"a": {"b": 3}, "d": None})
    assert (found.get("a.b"), found.get("a.c"), found.get("d"), found.get("a.x", 7), found.first("x", "a.c")) == (3, 2, 5, 7, 2)


def test_missing_prompt_file(spark):
    folder = files.scratch(spark, "prompts")
    spark.createDataFrame([("{a}",)], "value string").write.text(folder)
    with pytest.raises(Exception, match="no prompt file gone"):
        settings.read_prompts(spark, folder, {"s": "gone"}).collect()


def test_stage_numbers_are_unique():
    steps = settings.Stages()
    steps.step(1, "a")(lambda rows: rows)
    with pytest.raises(ValueError, match="stage 1 is a"):
        steps.step(1, "b")


def test_backend_stops_and_answers_every_query(spark):
    rank = lambda queries, corpus, k: queries.select("qid", F.lit("d").alias("did"), F.lit(1.0).alias("score"), F.lit(k).alias("rank"))
    backend = plugins.TableSearch(spark.range(1), rank)
    queries = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "qid long, text string")
    assert sorted(r["qid"] for r in plugins.searched(backend, queries, 5).collect()) == [1, 2, 3, 4]
    with pytest.raises(RuntimeError):
        backend.search(queries, 5)


def test_unknown_arm_and_encoder(spark):
    for chosen in (["b"], []):
        with pytest.raises(ValueError):
            plugins.run_arms({"a": lambda: None}, chosen)
    with pytest.raises(ValueError):
        plugins.encoded(spark.range(1), "none")
    none = plugins.encoded(spark.createDataFrame([(1, None)], "id long, text string"), "characters").first()
    assert none["vec"] == [0.0] * 16


def test_stub_replies_repeat(spark):
    asked = spark.createDataFrame([(1, "p"), (2, "p"), (3, None)], "id long, prompt string")
    first, again = (sorted(map(tuple, plugins.replies(asked).collect())) for _ in range(2))
    assert first == again and first[0][1] == first[1][1] and {r[2] for r in first} == {"stub"}
