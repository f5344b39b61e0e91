"""A bounded, reproducible sample of labelled documents with their features, for fitting on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, map_arrow, maybe_broadcast, text_or_empty
from .stats import FEATURES, features

#: Labelled documents of each label that a fit reads at most.
SAMPLE_PER_LABEL = 4000
_OUT = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])


def labelled_features(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``per_label`` documents a label, those of the smallest id hash.

    Rows of the held-out fold, null labels and labels other than 0 and 1 are not read.  Of repeated ids
    one label counts (the smallest) and one text (that of the smallest features), so at most
    ``2 * per_label`` rows come to the driver.  Null texts count as empty; empty tables give no rows."""
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    ids = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy("order", "doc_id").limit(per_label)
        ids = part if ids is None else ids.unionByName(part)
    picked = maybe_broadcast(ids.select(F.col("doc_id").alias("picked_id"), "label"), 2 * per_label)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = texts.join(picked, F.col("doc_id") == F.col("picked_id")).select("picked_id", "label", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_buffer().to_pybytes()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, _OUT.field(2).type)], schema=_OUT)

    measured = map_arrow(rows, measure, "id long, label int, x array<double>")
    found = measured.groupBy("id").agg(F.min(F.struct("x", "label")).alias("s")).select("s.*").toPandas()
    if not len(found):
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64)
    order = np.lexsort(np.vstack([*np.stack(found["x"]).T, found["label"]]))
    return np.stack(found["x"])[order], found["label"].to_numpy(np.int64)[order]
