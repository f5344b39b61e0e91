"""Training lanes and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seeds import order_key
from .planning import positions, running_before


def stratified_pick(items: DataFrame, k: int, run: str = "0") -> DataFrame:
    """``items(qid, did, grade)``: k of each query, laps over the grades from high to low, one of each per lap."""
    lap = F.row_number().over(W.partitionBy("qid", "grade").orderBy(order_key(F.lit(run), F.col("qid"), F.col("did")), "did"))
    laps = items.withColumn("lap", lap)
    place = F.row_number().over(W.partitionBy("qid").orderBy("lap", F.desc("grade")))
    return laps.withColumn("place", place).where(F.col("place") <= k)


def head_pick(items: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "did"))
    return items.withColumn("place", place).where(F.col("place") <= k)


def live_pairs(items: DataFrame) -> DataFrame:
    """Unordered pairs of different grades per query, from the grade histogram: (n² - Σ c²) / 2."""
    counts = items.groupBy("qid", "grade").agg(F.count("*").alias("c"))
    return counts.groupBy("qid").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).cast("long").alias("live_pairs"))


def group_split(rows: DataFrame, lane: str, group: str, fraction: float, run: str) -> DataFrame:
    """Whole groups, in seeded order, go to ``test`` until a fraction of the lane's rows is reached."""
    groups = rows.groupBy(lane, group).agg(F.count("*").alias("n"))
    totals = groups.groupBy(F.col(lane).alias("_lane")).agg(F.floor(F.sum("n") * fraction).alias("n_test"))
    keyed = groups.withColumn("_key", order_key(F.lit(run), F.col(lane), F.lit("split"), F.col(group)))
    placed = running_before(keyed, [lane], ["_key", group], "n").join(F.broadcast(totals), F.col(lane).eqNullSafe(F.col("_lane")))
    return placed.select(lane, group, F.when(F.col("before") < F.col("n_test"), "test").otherwise("train").alias("split"), "n")


def ratio_cycle(batch: int, ratio: int) -> list[int]:
    """General rows of each batch of a cycle."""
    base, extra = divmod(batch, ratio + 1)
    return [base + 1] * extra + [base] * (ratio + 1 - extra)


def batches(major: DataFrame, minor: DataFrame, batch: int, ratio: int) -> DataFrame:
    """``place``-numbered lanes (1, 2, …) → (batch, lane, place): each batch takes its counts of the cycle.

    The batch of a row is a closed form of its place, so no row waits for another; rows past the last whole
    batch are left over (batch null)."""
    cycle = ratio_cycle(batch, ratio)
    length, per_cycle = len(cycle), sum(cycle)

    def number(counts: list[int]) -> Column:
        inside = F.pmod(F.col("place") - 1, F.lit(sum(counts)))
        step, upto = F.lit(length - 1), 0
        cuts = []
        for i, c in enumerate(counts):
            upto += c
            cuts.append((upto, i))
        for upto, i in reversed(cuts):
            step = F.when(inside < upto, i).otherwise(step)
        return F.floor((F.col("place") - 1) / sum(counts)) * length + step

    def whole(lane: DataFrame, counts: list[int]) -> DataFrame:
        steps = [sum(counts[:i]) for i in range(1, length + 1)]
        rest = F.pmod(F.col("n"), F.lit(sum(counts)))
        more = sum((F.when(rest >= s, 1).otherwise(0) for s in steps), F.lit(0))
        return lane.agg(F.count("*").alias("n")).select((F.floor(F.col("n") / sum(counts)) * length + more).alias("whole"))

    others = [batch - c for c in cycle]
    limit = whole(major, others).unionByName(whole(minor, cycle)).agg(F.min("whole").alias("n_batches"))
    rows = major.select("place", F.lit("major").alias("lane"), number(others).alias("batch")).unionByName(minor.select("place", F.lit("minor").alias("lane"), number(cycle).alias("batch")))
    assert per_cycle == batch
    return rows.crossJoin(F.broadcast(limit)).select("lane", "place", F.when(F.col("batch") < F.col("n_batches"), F.col("batch")).cast("long").alias("batch"))


def pack_by_length(lengths: DataFrame, count: int, budget: int) -> DataFrame:
    """``lengths(id, length)`` longest first into batches of at most ``count`` and, with a budget, at most
    budget // longest each (one at least).  Batches are numbered over the whole table.

    A batch's size depends on its longest length alone, so the fold over all rows goes by the counts of
    distinct lengths (on the driver); a row's batch is then a closed form of its position."""
    runs, start, first, batch = [], 0, 0, 0
    counts = lengths.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("length"))
    for length, n in counts.toLocalIterator():
        size = max(1, min(count, budget // length)) if budget and length else max(1, count)
        runs.append((length, first, batch, size))
        start += n
        opened = max(0, -((first - start) // size))
        first, batch = first + opened * size, batch + opened
    by_length = lengths.sparkSession.createDataFrame(runs, "of long, first long, next long, size long")
    placed = positions(lengths.select("id", "length"), F.desc("length"), "id")
    number = F.col("next") + F.floor((F.col("position") - F.col("first")) / F.col("size"))
    rows = placed.join(F.broadcast(by_length), F.col("length").eqNullSafe(F.col("of")))
    return rows.select(F.when(F.col("position") < F.col("first"), F.col("next") - 1).otherwise(number).cast("long").alias("batch"), "id", "length")


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The upper of the two middle values: exact, by counts of distinct values."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(group).orderBy(value))
    total = F.sum("c").over(W.partitionBy(group))
    return counts.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(group).agg(F.min(value).alias("upper_median"))
