"""Packing: concatenate all documents and cut into fixed windows.

Pass 1 encodes each partition once and keeps, per document, its ids and its offset within the
partition.  The partition totals (one row a partition) are summed into bases, so every document gets a
global offset without moving any text.  Pass 2 cuts documents at multiples of the window length and
writes one boundary record per piece.

Defined results: a null or empty text is the end-of-document id alone; repeated rows are packed each;
an empty table gives no pieces; only the last sequence can be short.  Order is the order of the scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, maybe_broadcast, text_or_empty, written
from .tokens import word_encoder

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of ids in one batch between Python and the JVM.
BATCH_BYTES = 4 << 20

_IDS = pa.schema([("part", pa.int64()), ("local", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """part, local (tokens before the document in its partition), doc_id, n, ids (16-bit, little-endian)."""
    end = int(end_id).to_bytes(2, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, local = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                rows.append((part, local, doc_id, len(ids) // 2, ids))
                local += len(ids) // 2
                held += len(ids)
                if held > BATCH_BYTES:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _IDS)], schema=_IDS)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _IDS)], schema=_IDS)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(source, encode, "part long, local long, doc_id long, n long, ids binary")


def with_offsets(encoded: DataFrame) -> DataFrame:
    """Global offset of each document.  The bases are sums over partitions: one small row for each."""
    spark = encoded.sparkSession
    totals = sorted(tuple(r) for r in encoded.groupBy("part").agg(F.max(F.col("local") + F.col("n")).alias("total")).collect())
    bases = accumulate((n for _, n in totals), initial=0)
    rows = [(part, base) for (part, _), base in zip(totals, bases)]
    frame = spark.createDataFrame(rows, "part long, base long")
    joined = encoded.join(maybe_broadcast(frame, len(rows)), "part")
    return joined.select("doc_id", (F.col("base") + F.col("local")).alias("at"), "n", "ids")


def cut(placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per piece: the document's part in one window."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, at, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                wide = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                start = 0
                while start < n:
                    offset = (at + start) % window
                    length = min(n - start, window - offset)
                    rows.append((doc_id, start, length, zlib.crc32(wide[start : start + length]), n, (at + start) // window, offset))
                    start += length
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return map_arrow(placed, pieces, ", ".join(f"{f.name} long" for f in _PIECES))


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    return cut(with_offsets(written(encode_documents(docs, tokenizer, end_id), "pack-ids")), window)
