"""Token counts through a digest cache.

Documents are joined by (content digest, tokenizer digest) to stored counts; only one document of each
missing content is encoded, and its count is appended to the cache before the final join.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; an
empty table gives no rows.  The cache is a Parquet table; records of other tokenizers are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_dir, map_arrow, maybe_broadcast, text_or_empty, written
from .tokens import byte_counter, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
LIMIT = 512
CACHE_SCHEMA = "version string, digest binary, n_tokens long"
_OUT = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


def tokenizer_version(tokenizer: str) -> str:
    """Digest of the tokenizer's file: counts of another version are never hits."""
    with open(tokenizer_path(tokenizer), "rb") as source:
        return hashlib.sha256(source.read()).hexdigest()


def content_digest(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _encoded(docs: DataFrame, tokenizer: str, ranks: str | None) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = byte_counter(tokenizer, ranks)
        for batch in batches:
            counts = [counter.count(text.as_py()) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], schema=_OUT)

    return map_arrow(docs.select("digest", "text"), count, "digest binary, n_tokens long")


def missing_counts(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """Of each content that is not stored: digest and first_id, the smallest doc_id that has it."""
    first = keys.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    return first.join(stored.select("digest"), "digest", "left_anti")


def _to_encode(text: DataFrame, keys: DataFrame, missing: DataFrame) -> DataFrame:
    """The rows (digest, text) to encode: one document of each missing content, found by id and digest.

    The shorter list is looked up by broadcast: the rows to take (few hits are new), or the rows to leave (few are
    copies).  Only where both are beyond the bound are texts shuffled, by id and digest, so no content is a hot key."""
    n_take, n_rows = missing.count(), keys.count()
    same = lambda side: text["doc_id"].eqNullSafe(side["first_id"]) & (text["digest"] == side["of_digest"])
    take = missing.withColumnRenamed("digest", "of_digest")
    if n_take <= n_rows - n_take:
        return text.join(maybe_broadcast(take, n_take, longs=6), same(take), "left_semi")
    leave = keys.join(take.hint("merge"), keys["doc_id"].eqNullSafe(take["first_id"]) & (keys["digest"] == take["of_digest"]), "left_anti")
    leave = written(leave.select(F.col("doc_id").alias("first_id"), F.col("digest").alias("of_digest")).distinct(), "token-leave")
    return text.join(maybe_broadcast(leave, leave.count(), longs=6), same(leave), "left_anti")


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit.  ``cache``: path of the stored counts; a new one if None.

    Where all contents are stored no text is encoded, and none moves: only ids and digests are joined."""
    spark = docs.sparkSession
    cache = cache or fresh_dir(spark, "token-cache")
    version = tokenizer_version(tokenizer)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keys = written(text.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest")), "token-keys")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    missing = written(missing_counts(keys, stored()), "token-missing")
    todo = _to_encode(text.withColumn("digest", content_digest(F.col("text"))), keys, missing)
    counts = _encoded(todo, tokenizer, ranks).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)

    # A table, so that a content of very many copies can be split over tasks; broadcast while small, so it is not dealt at all.
    known = written(stored(), "token-stored")
    counted = keys.join(maybe_broadcast(known, known.count(), longs=6), "digest", "left")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
