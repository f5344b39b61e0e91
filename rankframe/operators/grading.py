"""Grade clean-up, hardness, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hardness bands by the number of answering documents among the top n (fixed values).
BANDS = {"ultra_hard": (0, 0), "hard": (1, 3), "medium": (4, 6), "easy": (7, 999)}


def parse_grade_id(x: Column) -> Column:
    """``P12``, ``p12`` or ``12`` → 12, else null."""
    return F.regexp_extract(F.trim(x), r"^[Pp]?([0-9]+)$", 1).try_cast("int")


def clean_grade(x: Column, floor: int = 1, top: int = 10) -> Column:
    """A number as text, rounded half to even and clamped; null if it is none."""
    value = F.bround(x.try_cast("double"), 0)
    return F.greatest(F.lit(floor), F.least(F.lit(top), value.cast("int")))


def impute_omitted(pool: DataFrame, scores: DataFrame, floor: int = 1) -> DataFrame:
    """Every pooled document has a grade: those without a score get the floor."""
    joined = pool.join(scores, ["qid", "did"], "left")
    return joined.withColumn("imputed", F.col("grade").isNull()).withColumn("grade", F.coalesce("grade", F.lit(floor)))


def band(n: Column) -> Column:
    out = None
    for name, (low, high) in BANDS.items():
        out = (F.when if out is None else out.when)(n.between(low, high), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("no band holds "), n.cast("string"))))


def hardness(grades: DataFrame, run: DataFrame | None, top_n: int = 10, answering: int = 7) -> DataFrame:
    """``grades(qid, did, grade)``, ``run(qid, did, rank)`` → density among the top n, band, pool statistics.

    A question without a ranking falls back to its best grades (grade descending, id)."""
    from pyspark.sql import Window as W

    own = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "did"))
    real = grades.select("qid", "did", "grade").where(~F.col("did").cast("string").startswith("synth:")).withColumn("own", own)
    if run is None:
        marked = real.withColumn("rank", F.col("own"))
        has = real.select("qid").distinct().withColumn("ranked", F.lit(False))
    else:
        head = run.where(F.col("rank") <= top_n).select("qid", "did", "rank")
        marked = real.join(head, ["qid", "did"], "left")
        has = real.select("qid").distinct().join(run.select("qid").distinct().withColumn("ranked", F.lit(True)), "qid", "left").withColumn("ranked", F.coalesce("ranked", F.lit(False)))
    top = F.when(F.col("ranked"), F.col("rank")).otherwise(F.col("own"))
    out = marked.join(has, "qid").groupBy("qid").agg(
        F.count(F.when((top <= top_n) & (F.col("grade") >= answering), 1)).alias("density"),
        F.count(F.when(F.col("grade") >= answering, 1)).alias("pool_answering"), F.max("grade").alias("pool_max_grade"),
        F.count(F.when(F.col("grade") >= 9, 1)).alias("n_at_9"), F.count(F.when(F.col("grade") >= 8, 1)).alias("n_at_8"),
    )
    return out.withColumn("band", band(F.col("density")))


def survived(source: Column, admission: tuple[str, ...], survival: tuple[str, ...], min_9: int = 1, min_8: int = 3, min_answering: int = 1) -> Column:
    return (
        F.when(source.isin(*admission), (F.col("n_at_9") >= min_9) | (F.col("n_at_8") >= min_8))
        .when(source.isin(*survival), F.col("pool_answering") >= min_answering).otherwise(True)
    )


def later_wins(grades: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    return grades.groupBy(*key).agg(F.max_by(value, order).alias(value))


def backfill(meta: Column, pool_value: Column) -> Column:
    return F.coalesce(F.nullif(meta, F.lit("")), pool_value)
