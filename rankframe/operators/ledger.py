"""Append-only ledgers: running totals, resume, terminal states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .planning import running_before

#: US dollars per million tokens where a call reports no cost (fixed values).
IN_PRICE, OUT_PRICE = 0.034, 0.168


def cost(reported: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return F.coalesce(reported, tokens_in / 1e6 * IN_PRICE + tokens_out / 1e6 * OUT_PRICE)


def running_spend(calls: DataFrame, lane: str | None, order: list[str], amount: str, warn: float, abort: float) -> DataFrame:
    """Running total per lane (None: of all calls together) and the state it puts the lane in."""
    out = running_before(calls, [lane] if lane else [], order, amount, "_before")
    out = out.withColumn("total", F.round(F.col("_before") + F.col(amount), 4)).drop("_before")
    return out.withColumn("state", F.when(F.col("total") >= abort, "abort").when(F.col("total") >= warn, "warn").otherwise("ok"))


def lane_spend(calls: DataFrame, lane: str, usd: str, tokens_in: str, tokens_out: str, estimated: str) -> DataFrame:
    """What each lane spent: dollars, tokens in and out, calls, and calls whose cost was estimated.  A null counts as 0."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return calls.groupBy(lane).agg(
        F.round(total(usd), 4).alias("usd"), total(tokens_in).alias("in_tok"), total(tokens_out).alias("out_tok"), F.count("*").alias("n"),
        F.count(F.when(F.col(estimated), 1)).alias("estimated_calls"),
    )


def crossings(calls: DataFrame, order: list[str], amount: str, warn: float, abort: float) -> DataFrame:
    """The first call of all lanes together at which the total reaches each limit: limit, the call's order, total.

    One row a limit that is reached; a limit of 0 is none."""
    running = running_spend(calls, None, order, amount, warn, abort)
    first = lambda name, limit: running.where(F.col("total") >= limit).agg(F.min(F.struct(*order, "total")).alias("c")).where("c IS NOT NULL").select(F.lit(name).alias("limit"), "c.*")
    limits = [(n, x) for n, x in (("warn", warn), ("abort", abort)) if x]
    if not limits:
        raise ValueError("no limit")
    return reduce(DataFrame.unionByName, (first(*x) for x in limits))


def total_deltas(calls: DataFrame, session: str, order: list[str], total: str) -> DataFrame:
    """What each call added to a session's running total; never negative."""
    before = F.lag(total, 1, 0.0).over(W.partitionBy(session).orderBy(*order))
    return calls.withColumn("delta", F.round(F.greatest(F.lit(0.0), F.col(total) - before), 4))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """``time  VERB  key='value' …`` → verb and a map of fields."""
    x = F.col(line)
    keys = F.regexp_extract_all(x, F.lit(r"(\w+)='([^']*)'"), F.lit(1))
    values = F.regexp_extract_all(x, F.lit(r"(\w+)='([^']*)'"), F.lit(2))
    return lines.select(F.get(F.split(F.trim(x), r"\s+"), F.lit(1)).alias("verb"), F.map_from_arrays(keys, values).alias("fields"))


def read_through(asked: DataFrame, cache: DataFrame, searched: DataFrame, key: str) -> DataFrame:
    """Cached answers, even empty ones, stand; only other keys take what the search found."""
    hit = asked.join(cache, key).withColumn("cached", F.lit(True))
    miss = asked.join(cache.select(key), key, "left_anti").join(searched, key, "left").withColumn("cached", F.lit(False))
    return hit.unionByName(miss)
