"""Apportionment, yields, round planning, seeded samples and draws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seeds import coin, order_key, uniform, weighted_pick
from ..sources.files import scratch


def largest_remainder(weights: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """Whole shares of ``n`` in proportion to ``weight``: floors, then one each by largest remainder and key."""
    every = W.partitionBy(F.lit(1))
    quota = F.col(weight) * F.lit(n) / F.sum(weight).over(every)
    out = weights.withColumn("quota", F.round(quota, 9)).withColumn("floor", F.floor("quota").cast("long"))
    out = out.withColumn("short", F.lit(n) - F.sum("floor").over(every))
    place = F.row_number().over(W.orderBy(F.desc(F.round(F.col("quota") - F.col("floor"), 9)), key))
    return out.select(key, (F.col("floor") + F.when(place <= F.col("short"), 1).otherwise(0)).alias("share"))


def yields(attempted: DataFrame, written: DataFrame, min_attempts: int = 5) -> DataFrame:
    """Written over attempted per (source, unit); few attempts borrow the source's rate, none are unmeasured."""
    tried = attempted.groupBy("source", "unit").agg(F.count("*").alias("attempted"))
    ok = written.where("status IS NULL OR status = 'ok'").groupBy("source", "unit").agg(F.count("*").alias("written"))
    out = tried.join(ok, ["source", "unit"], "left").withColumn("written", F.coalesce("written", F.lit(0)))
    by = W.partitionBy("source")
    out = out.withColumns({"source_attempted": F.sum("attempted").over(by), "source_written": F.sum("written").over(by)})
    unit, source = F.col("attempted") >= min_attempts, F.col("source_attempted") >= min_attempts
    rate = F.when(unit, F.col("written") / F.col("attempted")).when(source, F.col("source_written") / F.col("source_attempted")).otherwise(1.0)
    basis = F.when(unit, "unit").when(source, "source").otherwise("unmeasured")
    return out.select("source", "unit", "attempted", "written", F.round(rate, 4).alias("rate"), basis.alias("basis"))


def settled(attempted: Column, written: Column, terminal: Column) -> Column:
    return (attempted == 0) | (written + terminal >= attempted)


def round_plan(rows: DataFrame, min_yield: float = 0.35, max_overgen: float = 3.0) -> DataFrame:
    """``target, kept, written, rate`` → remaining, multiplier, planned."""
    remaining = F.greatest(F.lit(0), F.col("target") - F.col("kept") - F.col("written"))
    multiplier = F.least(1.0 / F.greatest(F.col("rate"), F.lit(min_yield)), F.lit(max_overgen))
    out = rows.withColumn("remaining", remaining).withColumn("multiplier", F.round(multiplier, 3))
    return out.withColumn("planned", F.ceil(F.round(F.col("remaining") * multiplier, 9)).cast("long"))


def sample_to_target(rows: DataFrame, unit: list[str], key: str, target: str, run: str) -> DataFrame:
    """At most ``target`` rows of each unit in seeded order; rows of units without a target are dropped.

    Adds ``selected``.  The order depends on the key alone, not on the input's order; a unit of any size is spread over tasks."""
    placed = places(rows, unit, [order_key(F.lit(run), F.lit("subsample"), *map(F.col, unit), F.col(key)), F.col(key)])
    return placed.withColumn("selected", F.coalesce(F.col("place") <= F.col(target), F.lit(False))).drop("place")


def sample_report(selected: DataFrame, unit: list[str], target: str) -> DataFrame:
    out = selected.groupBy(*unit).agg(F.max(target).alias("target"), F.count("*").alias("have"), F.count(F.when(F.col("selected"), 1)).alias("kept"))
    return out.withColumn("surplus", F.col("have") - F.col("kept")).withColumn("short_by", F.greatest(F.lit(0), F.col("target") - F.col("kept")))


def uniform_sample(rows: DataFrame, key: str, n: int, run: str) -> DataFrame:
    """``n`` rows without replacement, in the order of a digest of their key."""
    return rows.withColumn("_order", order_key(F.lit(run), F.col(key))).orderBy("_order", key).limit(n).drop("_order")


def positions(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Adds ``position`` (0, 1, …) in the given order: a range sort, written once, and an offset per partition."""
    path = scratch(rows.sparkSession, "positions")
    inside = F.monotonically_increasing_id()
    rows.orderBy(*order).withColumns({"_part": F.shiftright(inside, 33), "_inside": inside.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_base"))
    return placed.join(F.broadcast(base), "_part").withColumn("position", F.col("_base") + F.col("_inside")).drop("_part", "_inside", "_base")


def evenly_spaced(rows: DataFrame, order: str, count: int) -> DataFrame:
    """The rows at ``count`` evenly spaced positions from the first to the last, whatever their ids are.

    Positions are those of ``numpy.linspace`` cut to whole numbers; in fewer rows than ``count`` some repeat."""
    placed = positions(rows, order)
    n = placed.count()
    picked = np.linspace(0, n - 1, count, dtype=np.int64).tolist() if n else []
    at = rows.sparkSession.createDataFrame([(p,) for p in picked], "position long")
    return placed.join(F.broadcast(at), "position").drop("position")


def running_before(rows: DataFrame, lane: list[str], order: list[str | Column], value: str, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over the rows that stand before a row in its lane (0 for the first).

    Rows are range-sorted by lane and order and written once; sums inside a part are added to the totals of the
    parts before it, so a lane of any size is spread over tasks.  ``order`` should be unique in a lane."""
    path = scratch(rows.sparkSession, "running")
    inside = F.monotonically_increasing_id()
    rows.orderBy(*lane, *order).withColumns({"_part": F.shiftright(inside, 33), "_inside": inside}).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    within = W.partitionBy("_part", *lane).orderBy("_inside").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *lane).agg(F.sum(value).alias("_total"))
    upto = W.partitionBy(*lane).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each part and lane that meet: parts are few, and a lane spans neighbouring ones.
    base = totals.select(F.col("_part").alias("_at"), *(F.col(c).alias(f"_of_{c}") for c in lane), F.coalesce(F.sum("_total").over(upto), F.lit(0)).alias("_base"))
    met = F.col("_part") == F.col("_at")
    for c in lane:
        met = met & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = placed.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(base, met)
    return out.withColumn(name, F.col("_base") + F.col("_own")).select(*rows.columns, name)


def places(rows: DataFrame, lane: list[str], order: list[str | Column]) -> DataFrame:
    """Adds ``place``, 1, 2, … in each lane, by the range sort of ``running_before``: no lane is one task."""
    counted = running_before(rows.withColumn("_one", F.lit(1)), lane, order, "_one", "place")
    return counted.withColumn("place", F.col("place") + 1).drop("_one")


#: Rows that one task of a seeded shuffle sorts, about.
SHUFFLE_ROWS = 1_000_000


def shuffled(rows: DataFrame, key: str, run: str) -> DataFrame:
    """Adds ``place``, the row's place in a seeded permutation, without one task for all rows: a partitioning by the
    first hexadecimal digits of a digest, as many as the counted rows need, and a running offset per part."""
    digits = max(1, math.ceil(math.log(max(1, rows.count() / SHUFFLE_ROWS), 16)))
    keyed = rows.withColumn("_order", order_key(F.lit(run), F.col(key)))
    bucket = F.substring("_order", 1, digits)
    counts = keyed.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    base = counts.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_base"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy("_order", key))
    placed = keyed.withColumn("_bucket", bucket).withColumn("_inside", inside).join(base, "_bucket")
    return placed.withColumn("place", F.col("_base") + F.col("_inside")).drop("_order", "_bucket", "_inside", "_base")


def filter_reason(name: Column, substrings: tuple[str, ...] = ()) -> Column:
    """Why a display name cannot be used, or null."""
    out = F.when(F.contains(name, F.lit(",")), "comma").when(F.contains(name, F.lit("(")) | F.contains(name, F.lit(")")), "parenthesis")
    for term in substrings:
        out = out.when(F.contains(F.lower(name), F.lit(term.lower())), f"substring:{term}")
    return out


def screened(name: Column, patterns: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp_like(name, F.concat(F.lit("(?iu)"), p)))


def draw_cells(units: DataFrame, run: str, lengths: dict[str, float], styles: dict[str, float], masks: dict[str, float]) -> DataFrame:
    """``units(source, unit, share)`` → one row per planned cell, every axis drawn from its own digest."""
    cells = units.where("share > 0").select("source", "unit", F.explode(F.sequence(F.lit(0), F.col("share").cast("int") - 1)).alias("i"))
    cells = cells.withColumn("cell_id", F.format_string("%s-%s-%04d", "source", "unit", "i"))
    u = lambda axis: uniform(F.lit(run), F.col("cell_id"), F.lit(axis))
    return cells.select(
        "cell_id", "source", "unit", weighted_pick(u("length"), lengths).alias("length"), weighted_pick(u("style"), styles).alias("style"),
        weighted_pick(u("mask"), masks).alias("masking"), coin(F.lit(run), F.col("cell_id"), F.lit("pasted")).alias("pasted"),
    )


def draw_from_group(rows: DataFrame, group: str, key: str, k: Column, run: str) -> DataFrame:
    """k members of each group in seeded order (k may be a column)."""
    return places(rows, [group], [order_key(F.lit(run), F.col(group), F.col(key)), F.col(key)]).where(F.col("place") <= k)


def first_reason(*tests: tuple[Column, str]) -> Column:
    """The first failed test's reason, or null: an ordered chain."""
    out = None
    for failed, reason in tests:
        out = (F.when if out is None else out.when)(failed, reason)
    return out
