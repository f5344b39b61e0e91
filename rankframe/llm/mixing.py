"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a fixed 60-bit hash.  A source that takes less than a whole pass of its documents
takes those whose hash lies under a threshold.  The threshold is found without sorting documents:
words are summed by source and hash bucket, a running sum over at most ``FAN`` buckets names the bucket
in which the budget ends, and only that bucket is cut finer, level by level, until it holds one hash.

Targets: the budget is shared by weight and no source exceeds ``cap`` times its size; the excess is
shared anew among the others.  That has a closed form: sort sources by cap over weight; those below the
common level are full.  Sources are ordered by code point, null last.

A source of target T and size S takes each document floor(T / S) times, and once more under the
threshold.  Defined results: null text has size 0; a null source is a source; a source of size 0 has
target 0 and takes none; an empty table gives no rows; rows of the same id and text share a hash and a
fate; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD_RE, maybe_broadcast, unused, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Hash bits, and bits by which a level narrows.
BITS = 60
STEP = 10


def hash_of(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of md5 of the id and the text (nulls: empty), so that rows of one id, or of none, are told apart."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RE)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, hash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash")
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target, rounds (whole passes) and rest (words of the partial pass).

    One row per source on the driver's side of the plan: sources are a catalogue, not data."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1))
    every = W.partitionBy(F.lit(1))
    ranked = by.withColumn("weight", weight.cast("long")).withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "full_size": F.coalesce(F.sum("source_size").over(order), F.lit(0)), "full_weight": F.coalesce(F.sum("weight").over(order), F.lit(0)),
        "all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every),
    })
    level = (share * F.col("all_size") - cap * F.col("full_size")) / (F.col("all_weight") - F.col("full_weight"))
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") < F.col("ratio"))
    shared = F.min(F.when(F.col("open"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(every)
    ranked = ranked.withColumn("shared", shared)
    target = F.when(F.col("ratio") < F.coalesce(F.col("shared.ratio"), F.lit(float("inf"))), cap * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.col("shared.level"))
    ranked = ranked.withColumn("target", F.coalesce(F.least(target, (cap * F.col("source_size")).cast("double")), F.lit(0.0)))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ranked = ranked.withColumn("rounds", rounds)
    return ranked.select("source", "source_size", "target", "rounds", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("rest"))


def thresholds(sized: DataFrame, aims: DataFrame, n_sources: int) -> DataFrame:
    """source, threshold: documents of a smaller hash are taken once more.

    ``low`` is the start of the bucket in which the budget ends and ``left`` what is left of it there."""
    edge = aims.select("source", F.lit(0).cast("long").alias("low"), F.col("rest").alias("left"))
    for level in range(1, BITS // STEP + 1):
        width = BITS - STEP * level
        inside = sized.join(maybe_broadcast(edge, n_sources), sized["source"].eqNullSafe(edge["source"]), "inner").drop(edge["source"])
        if level > 1:
            inside = inside.where((F.col("hash") >= F.col("low")) & (F.shiftright(F.col("hash"), width + STEP) == F.shiftright(F.col("low"), width + STEP)))
        sums = inside.groupBy("source", "low", "left", F.shiftright("hash", width).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last")
        )
        run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        over = sums.withColumn("sum", F.sum("words").over(run)).where(F.col("sum") > F.col("left"))
        found = over.groupBy("source").agg(F.min_by(F.struct("bucket", "words", "sum", "left", "first", "last"), "bucket").alias("b"))
        found = found.select("source", F.shiftleft("b.bucket", width).alias("low"), (F.col("b.left") - F.col("b.sum") + F.col("b.words")).alias("left"), (F.col("b.first") < F.col("b.last")).alias("mixed"))
        # A source whose documents all fit has no bucket in which the budget ends: its threshold is the top.
        old = edge.select("source", F.col("left").alias("had"))
        step = old.join(found, old["source"].eqNullSafe(found["source"]), "left").select(
            old["source"], F.coalesce("low", F.lit(1 << BITS)).alias("low"), F.coalesce("left", "had").alias("left"), F.coalesce("mixed", F.lit(False)).alias("mixed")
        )
        done = written(step, "mix-edge")
        edge = done.select("source", "low", "left")
        if done.where("mixed").isEmpty():
            break
    return edge.select("source", F.col("low").alias("threshold"))


def source_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, int]:
    """Per source its size, target, whole passes and threshold; and the number of sources."""
    aims = written(targets(sized, weights, share, cap), "mix-targets")
    n_sources = aims.count()
    cuts = thresholds(sized, aims, n_sources)
    plan = aims.join(cuts, aims["source"].eqNullSafe(cuts["source"])).select(
        aims["source"].alias("mix_source"), F.col("source_size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("rounds").alias("mix_rounds"), F.col("threshold").alias("mix_threshold")
    )
    return written(plan, "mix-plan"), n_sources


def with_copies(rows: DataFrame, plan: DataFrame, n_sources: int, hashed: Column) -> DataFrame:
    """``rows`` with their source's plan and, last, ``mix_copies``: how often the mix takes each row.  Names that
    ``rows`` has itself get underscores.  No row moves while the plan is small enough to be broadcast."""
    side = plan.toDF(*(unused(rows, c) for c in plan.columns))
    source, _, _, rounds, threshold = (side[c] for c in side.columns)
    joined = rows.join(maybe_broadcast(side, n_sources), rows["source"].cast("string").eqNullSafe(source))
    return joined.withColumn(unused(rows, "mix_copies"), rounds + F.when(hashed < threshold, 1).otherwise(0))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken."""
    sized = written(sizes(docs), "mix-sizes")
    plan, n_sources = source_plan(sized, weights, share, cap)
    return with_copies(sized, plan, n_sources, F.col("hash")).select(
        "doc_id", "source", "size", F.col("mix_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"),
        (F.col("size") * F.col("mix_copies")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Every row of ``docs``, all columns, as often as the mix takes it."""
    plan, n_sources = source_plan(written(sizes(docs), "mix-sizes"), weights, share, cap)
    taken = with_copies(docs, plan, n_sources, hash_of(docs["doc_id"], docs["text"]))
    copies = F.array_repeat(F.lit(1), F.col(taken.columns[-1]).cast("int"))
    return taken.withColumn(unused(taken, "mix_copy"), F.explode(copies)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s
), r AS (
  SELECT *, 2 * source_size / weight::DOUBLE AS ratio FROM w
), f AS (
  SELECT *, coalesce(sum(source_size) OVER o, 0)::BIGINT AS full_size, coalesce(sum(weight) OVER o, 0)::BIGINT AS full_weight,
         sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (1.5::DOUBLE * all_size - 2 * full_size) / (all_weight - full_weight) AS level FROM f
), m AS (
  SELECT min(ratio) AS open_ratio, arg_min(level, ratio) AS open_level FROM l WHERE level < ratio
), t AS (
  SELECT source, source_size,
         coalesce(least(CASE WHEN ratio < coalesce(open_ratio, 'infinity'::DOUBLE) THEN 2 * source_size::DOUBLE
                             ELSE weight * open_level END, 2 * source_size::DOUBLE), 0) AS target
  FROM l, m
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM t
), x AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.rounds, u.target - u.rounds * u.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target, (size * (rounds + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
