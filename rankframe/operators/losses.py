"""Ranking losses over graded candidate lists: ``items(qid, did, score, grade)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def position_weight(alpha: float) -> Column:
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "did"))
    return F.pow(1.0 / rank, F.lit(alpha))


def pairwise(items: DataFrame, sigma: float = 16.0, alpha: float = 0.25, stratum: str | None = None) -> DataFrame:
    """Weighted pairwise logistic loss per query over all pairs of unequal grades; 0 where no pair is.

    The pairs are the operator: a query's candidates are a bounded pool, not a corpus."""
    ranked = items.withColumn("pi", position_weight(alpha)).where("grade IS NOT NULL")
    keys = ["qid", *([stratum] if stratum else [])]
    a = ranked.select(*keys, *(F.col(c).alias(f"{c}_a") for c in ("score", "grade", "pi")))
    b = ranked.select(*keys, *(F.col(c).alias(f"{c}_b") for c in ("score", "grade", "pi")))
    pairs = a.join(b, keys).where("grade_a > grade_b")
    weight = (F.col("grade_a") - F.col("grade_b")) * F.greatest("pi_a", "pi_b")
    sums = pairs.groupBy("qid").agg(F.sum(weight * softplus(-sigma * (F.col("score_a") - F.col("score_b")))).alias("loss"), F.sum(weight).alias("z"))
    return items.select("qid").distinct().join(sums, "qid", "left").select("qid", F.round(F.coalesce(F.col("loss") / F.col("z"), F.lit(0.0)), 6).alias("loss"))


def log_softmax(value: Column, temperature: float) -> Column:
    by = W.partitionBy("qid")
    x = value / temperature
    top = F.max(x).over(by)
    return x - top - F.ln(F.sum(F.exp(x - top)).over(by))


def listwise_kl(items: DataFrame, temperature: float = 1.0) -> DataFrame:
    """KL(softmax(teacher) ‖ softmax(student)) per query; rows without a grade are padding."""
    real = items.where("grade IS NOT NULL")
    both = real.withColumn("t", log_softmax(F.col("grade"), temperature)).withColumn("s", log_softmax(F.col("score"), temperature))
    return both.groupBy("qid").agg(F.round(F.sum(F.exp("t") * (F.col("t") - F.col("s"))), 6).alias("kl"))


def mixed(rows: DataFrame, kl_weight: float) -> DataFrame:
    """Per batch: the mean of one lane's losses plus the weighted mean of the other's."""
    mean = lambda lane: F.coalesce(F.avg(F.when(F.col("lane") == lane, F.col("loss"))), F.lit(0.0))
    return rows.groupBy("batch").agg(F.round(mean("biomed") + kl_weight * mean("general"), 6).alias("loss"))
