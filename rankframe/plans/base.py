"""Bindings of the operators' inputs to the test tables, in Spark and (same names) in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeds import seed_int
from ..operators import metrics, vector
from ..sources.files import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Ranks of a run, and of a run that metrics are taken from: as deep as their largest cut.
DEPTH, METRIC_DEPTH = 20, 100


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a query, and the SQL that states its result after the named common tables."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_tables(ctes, sql)
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def points(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def query_points(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).select(F.col("id").alias("qid"), "vec")


def run(spark, sf_dir, depth: int = DEPTH) -> DataFrame:
    return vector.top_k(query_points(spark, sf_dir), points(spark, sf_dir), depth, skip_self=True)


def half_run(spark, sf_dir, low: int, depth: int = DEPTH) -> DataFrame:
    """A second or third retriever: the dot product of 32 of the dimensions."""
    part = lambda df: df.withColumn("vec", F.slice("vec", low, 32))
    return vector.top_k(part(query_points(spark, sf_dir)), part(points(spark, sf_dir)), depth, metric="dot", skip_self=True)


def qrels(spark, sf_dir) -> DataFrame:
    """Same label, another vector."""
    labelled = points(spark, sf_dir).select(F.col("id").alias("did"), "label")
    asked = labelled.withColumnRenamed("did", "qid")
    return asked.join(labelled, "label").where("qid <> did").select("qid", "did", F.lit(1).alias("rel"))


def classes(spark, sf_dir) -> DataFrame:
    """What ``qrels`` lists by pairs, by rows: the others of a label are a query's positives."""
    return points(spark, sf_dir).select("id", F.col("label").alias("cls"))


def grades(spark, sf_dir) -> DataFrame:
    """A grade of 1 to 10 for every ranked document, 7 or more if the labels agree; of one search, whatever joins them with
    themselves."""
    drawn = (F.pmod(seed_int(F.col("qid"), F.col("did")), F.lit(10)) + 1).cast("int")
    same = metrics.same_class(run(spark, sf_dir), classes(spark, sf_dir))
    return kept(same.select("qid", "did", "rank", "score", F.when(F.col("rel") == 1, F.greatest(drawn, F.lit(7))).otherwise(drawn).alias("grade")), "grades")


_HALF = """
{name} AS (
  SELECT * FROM (SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::INT AS rank FROM (
    SELECT q.id AS qid, e.id AS did, round(list_inner_product(q.v[{low}:{high}], e.v[{low}:{high}]), 6) AS score
    FROM e q JOIN e ON q.id <> e.id)) WHERE rank <= {depth}
)"""
TABLES = {
    "e": "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)",
    "run": """
run AS (
  SELECT * FROM (SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::INT AS rank FROM (
    SELECT q.id AS qid, e.id AS did, round(list_cosine_similarity(q.v, e.v), 6) AS score
    FROM e q JOIN e ON q.id <> e.id)) WHERE rank <= 20
)""",
    "left_run": _HALF.format(name="left_run", low=1, high=32, depth=DEPTH),
    "right_run": _HALF.format(name="right_run", low=33, high=64, depth=DEPTH),
    "left_deep": _HALF.format(name="left_deep", low=1, high=32, depth=METRIC_DEPTH),
    "runs": "runs AS (SELECT 'full' AS retriever, * FROM run UNION ALL SELECT 'left', * FROM left_run UNION ALL SELECT 'right', * FROM right_run)",
    "qrels": "qrels AS (SELECT a.id AS qid, b.id AS did, 1 AS rel FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id)",
    "grades": """
grades AS (
  SELECT r.qid, r.did, r.rank, r.score, CASE WHEN q.rel = 1 THEN greatest(g, 7) ELSE g END::INT AS grade FROM (
    SELECT *, (('0x' || substr(sha1(qid || '|' || did), 1, 12))::BIGINT % 10 + 1) AS g FROM run) r LEFT JOIN qrels q USING (qid, did)
)""",
    "metrics": """
metrics AS (
  WITH n AS (SELECT qid, count(*) AS n_rel, sum(CASE WHEN i <= 10 THEN ln(2) / ln(i + 1) END) AS ideal
             FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY did) AS i FROM qrels) GROUP BY qid),
       h AS (SELECT qid, min(CASE WHEN rel > 0 THEN rank END) AS first, sum(CASE WHEN rel > 0 AND rank <= 10 THEN ln(2) / ln(rank + 1) END) AS dcg,
                    count(CASE WHEN rel > 0 AND rank <= 10 THEN 1 END) AS hits, count(CASE WHEN rel > 0 AND rank <= 100 THEN 1 END) AS hits_100
             FROM {run} LEFT JOIN qrels USING (qid, did) GROUP BY qid)
  SELECT qid, round(coalesce(dcg / ideal, 0), 6) AS ndcg_10, round(hits_100 / n_rel, 6) AS recall_100, round(hits / 10.0::DOUBLE, 6) AS precision_10,
         round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr
  FROM n JOIN h USING (qid)
)""",
}
TABLES["deep"] = TABLES["run"].replace("run AS", "deep AS", 1).replace("rank <= 20", f"rank <= {METRIC_DEPTH}")
TABLES["metrics_left"] = TABLES["metrics"].replace("metrics AS", "metrics_left AS", 1).replace("{run}", "left_deep")
TABLES["metrics"] = TABLES["metrics"].replace("{run}", "deep")
_NEEDS = {
    "run": ["e"], "left_run": ["e"], "right_run": ["e"], "runs": ["run", "left_run", "right_run"], "qrels": ["e"], "grades": ["run", "qrels"],
    "deep": ["e"], "left_deep": ["e"], "metrics": ["deep", "qrels"], "metrics_left": ["left_deep", "qrels"],
}


def with_tables(ctes, sql: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in ctes:
        need(name)
    return ("WITH " + ",\n".join(TABLES[n].strip() for n in order) + "\n" if order else "") + sql
