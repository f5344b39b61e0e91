"""A budget that stops a stream: running spend per lane in keyed state, and a stop that outlives the run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STOP = "budget reached"


class BudgetReached(RuntimeError):
    """A lane's total has reached its limit; what was processed before is kept."""


class LaneSpend(StatefulProcessor):
    """A lane's total so far.  Calls are taken in order; the call that reaches ``abort`` is the last that is let through."""

    def __init__(self, order: str, amount: str, warn: float, abort: float):
        self.order, self.amount, self.warn, self.abort = order, amount, warn, abort

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "total double, calls long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, calls = self.spent.get() if self.spent.exists() else (0.0, 0)
        out = []
        # A lane's calls of one batch; batches bound how many they are.
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for at, amount in zip(batch[self.order].tolist(), batch[self.amount].fillna(0).tolist()):
            if total >= self.abort:
                break
            total, calls = total + amount, calls + 1
            out.append((*key, at, amount, total, calls, "abort" if total >= self.abort else "warn" if total >= self.warn else "ok"))
        self.spent.update((total, calls))
        yield pd.DataFrame(out, columns=["lane", "at", "amount", "total", "calls", "state"])

    def close(self) -> None:
        pass


def stopped(spark: SparkSession, out: str) -> DataFrame | None:
    """The crossings that stopped the stream whose output is ``out``: lane, at, total; None while it may run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/stopped/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{out}/stopped")


def guarded_spend(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, lane: str, order: str, amount: str, warn: float, abort: float, files_a_batch: int = 1) -> DataFrame:
    """Process calls from the files of ``source`` until a lane's total reaches ``abort``: lane, at, amount, total, calls, state.

    The batch with the first crossing is written, each lane up to its own crossing, then a stop marker with the crossings,
    and the stream ends; later batches are not read, now or by a later run, for a run that finds the marker does not start.
    A batch that is run again writes the same files anew, so a failure between the two writes repeats neither.  Null amounts
    count as 0; calls of a null lane are a lane.  A lane's spend is one row of state; ``lane`` may be a constant column, which
    makes one budget of all calls.  Raises ``BudgetReached`` never by itself: ``check`` does."""
    if stopped(spark, out) is None:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        processor = LaneSpend(order, amount, warn, abort)
        kinds = dict(spark.createDataFrame([], schema).dtypes)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source).select(lane, order, amount)
        through = stream.groupBy(lane).transformWithStateInPandas(processor, f"lane {kinds[lane]}, at {kinds[order]}, amount double, total double, calls long, state string", "append", "none")

        def store(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/calls/batch={number}")
            crossed = spark.read.parquet(f"{out}/calls/batch={number}").where("state = 'abort'")
            if crossed.limit(1).count():
                crossed.select("lane", "at", "total").coalesce(1).write.mode("overwrite").parquet(f"{out}/stopped")
                raise BudgetReached(_STOP)

        run = through.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        except PySparkException as failed:
            if _STOP not in str(failed) or stopped(spark, out) is None:
                raise
    return spark.read.parquet(f"{out}/calls").drop("batch")


def check(spark: SparkSession, out: str) -> None:
    """Raise where the stream of ``out`` was stopped by its budget."""
    if (crossed := stopped(spark, out)) is not None:
        first = crossed.orderBy("at", "lane").first()
        raise BudgetReached(f"lane {first['lane']} spent {first['total']:.2f} by call {first['at']}: stopped, what was processed before is kept")
