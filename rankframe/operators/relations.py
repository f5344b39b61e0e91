"""Joins, windows and set operations that the pipelines use again and again."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seeds import order_key
from .planning import places


def inner_lookup(rows: DataFrame, table: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows that the table knows, with its columns."""
    return rows.join(table.select(key, *columns), key)


def left_lookup(rows: DataFrame, table: DataFrame, key: str, **defaults) -> DataFrame:
    """Every row with the table's columns, or their defaults where it has none."""
    found = rows.join(table.select(key, *defaults), key, "left")
    return found.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def missing_pairs(wanted: DataFrame, have: DataFrame, *key: str) -> DataFrame:
    """Wanted keys that are not there yet."""
    return wanted.select(*key).join(have.select(*key), list(key), "left_anti")


def followed_by(turns: DataFrame, group: str, place: str, **columns: str) -> DataFrame:
    """Each turn with columns (new name = old name) of the turn one place on, null at the end: a composite-key join."""
    after = turns.select(group, (F.col(place) - 1).alias(place), *(F.col(old).alias(new) for new, old in columns.items()))
    return turns.select(group, place).join(after, [group, place], "left")


def zipped(rows: DataFrame, key: str, **arrays: Column) -> DataFrame:
    """Parallel arrays as rows (key, place from 1, one column an array); shorter arrays end in nulls."""
    together = F.posexplode(F.arrays_zip(*(a.alias(n) for n, a in arrays.items()))).alias("at", "z")
    return rows.select(key, together).select(key, (F.col("at") + 1).alias("place"), *(F.col(f"z.{n}").alias(n) for n in arrays))


def renamed_values(column: Column, names: Mapping[str, str]) -> Column:
    """Values under their new names; others stay."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[column], column) if pairs else column


def chosen_template(rows: DataFrame, templates: Mapping[tuple, str], *keys: str) -> DataFrame:
    """Rows with the template of their keys; rows of other keys are dropped."""
    table = rows.sparkSession.createDataFrame([(*k, v) for k, v in templates.items()], [*keys, "template"])
    return rows.join(F.broadcast(table), list(keys))


def distinct_texts(rows: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """Each text once; with ``key`` under the smallest of its keys."""
    return rows.select(text).distinct() if key is None else rows.groupBy(text).agg(F.min(key).alias(key))


def listed_once(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct values of each key as a sorted array."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("listed"))


def repeats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """How many values a key lists, and how many of them repeat another, by counts of distinct values."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    return counts.groupBy(key).agg(F.sum("c").alias("listed"), (F.sum("c") - F.count("*")).alias("repeats"))


def call_windows(rows: DataFrame, group: str, key: str, size: int, run: str) -> DataFrame:
    """Each group in seeded order, cut to windows of ``size`` rows: group, part, key.  A group is spread over tasks."""
    placed = places(rows.select(group, key), [group], [order_key(run, F.col(key)), F.col(key)])
    return placed.select(group, F.floor((F.col("place") - 1) / size).alias("part"), key)


def best_of(rows: DataFrame, group: str, value: str, *order: Column | str) -> DataFrame:
    """The value of each group's first row in the given order, without a sort."""
    return rows.groupBy(group).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_of(rows: DataFrame, group: str, place: str) -> DataFrame:
    """The last place of each group."""
    return rows.groupBy(group).agg(F.max(place).alias(place))


def first_n(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of an order: each task keeps its own n."""
    return rows.orderBy(*order).limit(n)


def role_counts(rows: DataFrame, group: str, column: str, value: str) -> DataFrame:
    """Rows of each group with a value, and with any other one."""
    other = F.count(F.when(F.col(column) != value, 1))
    return rows.groupBy(group).agg(F.count(F.when(F.col(column) == value, 1)).alias("with"), other.alias("others"))
