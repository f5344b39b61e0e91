"""Vector banks, vector indexes, query vectors, pinned snapshots and database tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("corpus", "queries", "qrels")


def _write_sidecar(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_bank(docs: DataFrame, queries: DataFrame, config: dict, path: str) -> None:
    """``docs`` and ``queries`` (id, vec) as Parquet beside the resolved configuration that made them."""
    for name, rows in (("docs", docs), ("queries", queries)):
        rows.select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(f"{path}/{name}")
    _write_sidecar(docs.sparkSession, f"{path}/config", config)


def read_bank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/queries"), read_sidecar(spark, f"{path}/config")


def write_index(points: DataFrame, path: str, **meta) -> None:
    """``points`` (id, vec) and a sidecar with the number of rows and what the caller states (dim, metric)."""
    points.select("id", "vec").write.mode("overwrite").parquet(f"{path}/rows")
    _write_sidecar(points.sparkSession, f"{path}/meta", {**meta, "rows": points.count()})


def read_index(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, vec), after checks that the sidecar states ``dim`` and the table holds what it states.

    A vector of another length fails the scan that meets it."""
    meta = read_sidecar(spark, f"{path}/meta")
    rows = spark.read.parquet(f"{path}/rows")
    if meta["dim"] != dim:
        raise ValueError(f"index of {meta['dim']} dimensions, expected {dim}")
    found = rows.count()
    if found != meta["rows"]:
        raise ValueError(f"index of {found} rows, its sidecar states {meta['rows']}")
    fits = F.coalesce(F.size("vec") == dim, F.lit(False))
    return rows.select("id", F.when(fits, F.col("vec")).otherwise(F.raise_error(F.lit(f"a vector is not of {dim} dimensions"))).alias("vec"))


def query_vectors(rows: DataFrame, order: str | None = None) -> DataFrame:
    """(qid, vec): a table's own ids as text, or its row numbers from 0 in ``order`` where it has none.

    Numbers come from a range sort with an offset a part, so no task numbers all rows."""
    if "id" in rows.columns:
        return rows.select(F.col("id").cast("string").alias("qid"), "vec")
    if order is None:
        raise ValueError("vectors without ids need a column that orders them")
    from ..operators.planning import positions

    return positions(rows, order).select(F.col("position").cast("string").alias("qid"), "vec")


def write_snapshot(tables: dict[str, DataFrame], root: str, name: str, revision: str) -> None:
    for split, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{root}/{name}/{revision}/{split}")


def read_snapshot(spark: SparkSession, root: str, name: str, pinned: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a benchmark at the revision that ``pinned`` names; a name that is not pinned is an error.

    Ids become text, missing titles and texts empty, and queries without a judgement are left out."""
    if name not in pinned:
        raise KeyError(f"no pinned revision of {name}")
    corpus, queries, qrels = (spark.read.parquet(f"{root}/{name}/{pinned[name]}/{split}") for split in SPLITS)
    text = lambda df, c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c in df.columns else F.lit("").alias(c)
    ident = lambda df, c: F.col("_id" if "_id" in df.columns else "id").cast("string").alias(c)
    judged = qrels.select(F.col("query-id").cast("string").alias("qid"), F.col("corpus-id").cast("string").alias("did"), F.col("score").cast("long").alias("rel"))
    asked = queries.select(ident(queries, "qid"), text(queries, "text")).join(judged.select("qid").distinct(), "qid", "left_semi")
    return {"corpus": corpus.select(ident(corpus, "did"), text(corpus, "title"), text(corpus, "text")), "queries": asked, "qrels": judged}


def read_database(spark: SparkSession, url: str, table: str, split_on: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table.  Column choice and filters reach the database; with ``split_on`` and its bounds the
    scan runs as ``parts`` range reads instead of one connection."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_on:
        if bounds is None:
            raise ValueError("a split scan needs the bounds of its column")
        reader = reader.options(partitionColumn=split_on, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()
