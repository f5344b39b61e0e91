"""Streams over append-only record files.  A checkpoint makes a rerun a no-op; keys are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: str) -> None:
    """Append records whose key is not yet written; what is already processed is not read again.

    The keys that were seen stay in the stream's state, without expiry, and the sink commits each batch once, so
    neither the source nor the output is read anew.  Records of one key are taken to be the same record."""
    stream = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


def running_totals(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, lane: str, amount: str) -> DataFrame:
    """Totals per lane held in streaming state; the last update of each lane."""

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/part{number}")

    totals = spark.readStream.schema(schema).parquet(source).groupBy(lane).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))
    query = totals.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    updates = spark.read.parquet(f"{out}/part*")
    return updates.groupBy(lane).agg(F.max_by("total", "batch").alias("total"), F.max_by("n", "batch").alias("n"))


def last_state(lines: DataFrame, key: str, verb: str, order: str) -> DataFrame:
    return lines.groupBy(key).agg(F.max_by(verb, order).alias(verb))
