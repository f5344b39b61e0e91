"""Rank fusion and quota pooling with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reciprocal_rank_fusion(runs: DataFrame, keep: int = 300, constant: int = 60) -> DataFrame:
    """``runs(qid, retriever, did, rank)``: sum of 1 / (constant + rank), the best ``keep``; ties by the id as
    text.  Also each retriever's own rank, as a map."""
    fused = runs.groupBy("qid", "did").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("rrf"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("retriever", "rank")))).alias("ranks")
    )
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rrf"), F.col("did").cast("string")))
    return fused.withColumn("place", place).where(F.col("place") <= keep)


def retriever_lists(fused: DataFrame, quotas: DataFrame, aliases: dict[str, str] | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Each retriever's best by its own rank inside the fused list: ``quotas(retriever, quota)``.

    The rank of provenance is the position in this list.  Labels that are neither configured, an alias nor
    ignored come out with a null quota and rank 0, so they are counted and not lost."""
    label = F.col("retriever")
    for alias, name in (aliases or {}).items():
        label = F.when(F.col("retriever") == alias, name).otherwise(label)
    long = fused.select("qid", "did", F.explode("ranks").alias("retriever", "own_rank")).withColumn("retriever", label)
    long = long.where(~F.col("retriever").isin(*ignored)) if ignored else long
    known = long.join(quotas, "retriever", "left")
    rank = F.row_number().over(W.partitionBy("qid", "retriever").orderBy("own_rank", F.col("did").cast("string")))
    return known.withColumn("rank", F.when(F.col("quota").isNotNull(), rank).otherwise(0)).where("quota IS NULL OR rank <= quota")


def head(run: DataFrame, quota: int) -> DataFrame:
    return run.where(F.col("rank") <= quota)


def pool(entries: DataFrame) -> DataFrame:
    """``entries(qid, did, slot, retriever, rank)`` → one row per document with ordered provenance; no cap."""
    return entries.groupBy("qid", "did").agg(F.sort_array(F.collect_list(F.struct("slot", "retriever", "rank"))).alias("provenance"))


def shortfall(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(qid, retriever, quota)`` against what came: rows with fewer than the quota."""
    have = lists.groupBy("qid", "retriever").agg(F.count("*").alias("have"))
    out = asked.join(have, ["qid", "retriever"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return out.where("have < quota").select("qid", "retriever", "quota", "have")


def richest(rows: DataFrame, key: list[str], order: str, *columns: str) -> DataFrame:
    """Per key the first value of each column, in order, that is neither null nor empty."""
    first: list[Column] = [F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(order))).alias(c) for c in columns]
    return rows.groupBy(*key).agg(*first)


def expand_query(rows: DataFrame) -> DataFrame:
    """One row → question and up to two sketches, the empty ones left out: scan_id, slot, text."""
    texts = F.array(
        F.struct(F.col("qid").alias("scan_id"), F.lit("question").alias("slot"), F.col("text").alias("text")),
        F.struct(F.concat("qid", F.lit("#s1")).alias("scan_id"), F.lit("sketch_1").alias("slot"), F.get("sketches", F.lit(0)).alias("text")),
        F.struct(F.concat("qid", F.lit("#s2")).alias("scan_id"), F.lit("sketch_2").alias("slot"), F.get("sketches", F.lit(1)).alias("text")),
    )
    return rows.select("qid", F.inline(texts)).where("text <> ''")
