"""Deterministic draws: every choice is a function of a digest of its key, so reruns agree and no
generator state is shared between tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts) -> Column:
    return F.concat_ws("|", *(F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts))


def order_key(*parts) -> Column:
    """sha1 hex of the parts joined by a bar: sort by it for a seeded shuffle."""
    return F.sha1(_joined(*parts).cast("binary"))


def seed_int(*parts) -> Column:
    """The first 12 hex digits of the digest as a number."""
    return F.conv(F.substring(order_key(*parts), 1, 12), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A number in [0, 1)."""
    return seed_int(*parts) / F.lit(float(1 << 48))


def coin(*parts) -> Column:
    return F.pmod(seed_int(*parts), F.lit(2)) == 0


def weighted_pick(u: Column, weights: dict[str, float]) -> Column:
    """One uniform number and cumulative weights; the last key takes the rest."""
    total, below, out = sum(weights.values()), 0.0, None
    *head, last = weights
    for key in head:
        below += weights[key]
        out = (F.when if out is None else out.when)(u * total < below, key)
    return F.lit(last) if out is None else out.otherwise(last)
