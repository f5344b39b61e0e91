"""Exact deduplication by stateful streaming, with DataFrame functions only.

A stream of (digest, doc_id, content locator) records feeds a keyed state on disk (the session's state store)
without a watermark, so no key ever expires: per digest it retains the smallest doc_id, the file that holds that
text and the number of rows.  With ``state`` the state outlives the call, and the documents of a later call meet
those of all earlier ones.

On a hit (a digest of several rows) the content locators of the new rows and of the row that stays lead to their
texts, and only those are read again and compared byte by byte; texts that only share a digest are regrouped by
their bytes.

Defined results: a null text counts as empty; white space runs are one space before comparison; of equal texts the
smallest doc_id is ``keep_id`` and every row that has it is ``kept`` (repeated rows each); a null id is larger than
any other, and is kept only where all ids of its group are null; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_dir, maybe_broadcast, text_or_empty, written

#: The state lives on disk.  Stores share a bounded cache, reserve no disk, commit changes only, and are closed when a
#: task is done: an executor holds no store between batches.
_STORE = "spark.sql.streaming.stateStore."
STATE_STORE = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}unloadOnCommit": "true",
    f"{_STORE}rocksdb.allowFAllocate": "false",
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}rocksdb.maxMemoryUsageMB": "64",
}
#: Record files that one batch of the stream takes at most.
FILES_PER_BATCH = 10_000
_RECORD = "doc_id long, sha binary, locator string, mark binary"
_UPDATE = "digest binary, keep_id long, group_size long, locator string, batch int"
_LAST_ID = 2**63 - 1


def normalised(text: Column) -> Column:
    """Runs of white space as one space.  A single space is one already, so only other runs are replaced."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def whole(sha: Column) -> Column:
    return sha


def _children(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def digest_state(spark: SparkSession, home: str, digest: Callable[[Column], Column] = whole, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Stream what is new under ``home/records`` through the keyed state kept in ``home/checkpoint``.

    A batch that is run again after a failure overwrites its own updates."""
    out = f"{home}/updates"
    stream = spark.readStream.schema(_RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/records/*")
    keyed = stream.groupBy(digest(F.col("sha")).alias("digest")).agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min_by("locator", F.coalesce("doc_id", F.lit(_LAST_ID))).alias("locator")
    )

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")

    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        start = keyed.writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
        start.foreachBatch(store).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def state_of(spark: SparkSession, home: str, below: int = 1 << 62) -> DataFrame:
    """digest, keep_id, group_size, locator as of the last update, of a batch before ``below``, of each digest."""
    numbers = [n for n in _batches(spark, home) if n < below]
    updates = spark.read.schema(_UPDATE).parquet(*(f"{home}/updates/number={n}" for n in numbers)) if numbers else spark.createDataFrame([], _UPDATE)
    latest = updates.groupBy("digest").agg(F.max_by(F.struct("keep_id", "group_size", "locator"), "batch").alias("s"))
    return latest.select("digest", "s.keep_id", "s.group_size", "s.locator")


def _batches(spark: SparkSession, home: str) -> list[int]:
    return [int(name.split("=")[1]) for name in _children(spark, f"{home}/updates")]


def _first_batch(spark: SparkSession, home: str, name: str) -> int:
    """The first batch of the stream that can hold the rows of increment ``name``; a repeated call finds it written."""
    path = f"{home}/calls/{name}"
    if "_SUCCESS" not in _children(spark, path):
        first = max(_batches(spark, home), default=-1) + 1
        spark.createDataFrame([(first,)], "first long").write.mode("overwrite").parquet(path)
    return spark.read.schema("first long").parquet(path).first()["first"]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, the text as it is, locator (the file that a row is read from)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.input_file_name().alias("locator"))


def _contents(rows: DataFrame, listed: DataFrame, n_listed: int) -> DataFrame:
    """digest, doc_id, raw and normalised text of those of ``rows`` that are listed (doc_id, locator, digest); other
    texts are neither normalised nor hashed again nor moved, while the list is small enough to be broadcast."""
    side = listed.select(F.col("doc_id").alias("of_id"), F.xxhash64("locator").alias("of_file"), "digest").distinct()
    met = rows.join(maybe_broadcast(side, n_listed, longs=6), rows["doc_id"].eqNullSafe(F.col("of_id")) & (F.xxhash64(rows["locator"]) == F.col("of_file")))
    return met.select("digest", "doc_id", F.col("text").alias("raw"), normalised(F.col("text")).alias("text"))


def _elsewhere(spark: SparkSession, listed: DataFrame) -> DataFrame | None:
    """Rows of the files that the locators of earlier calls name.  The driver sees file names, no rows."""
    files = [unquote(r[0]) for r in listed.select("locator").distinct().toLocalIterator()]
    return _rows(spark.read.parquet(*files)) if files else None


def exact_duplicates(
    docs: DataFrame, digest: Callable[[Column], Column] = whole, carry: Column | None = None, state: str | None = None, increment: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, the normalised text's sha256 and the carried binary ``mark``, one row per
    document of ``docs``.

    ``digest`` narrows the sha256 to the state's key.  ``state``: a shared folder that keeps the state from call to
    call; documents are then compared with those of all earlier calls, and keep_id and group_size are as of now.
    Their ids and texts are kept there too, as the caller passed them, so that full bytes can be compared.  ``increment`` names this call's documents: a call that is repeated with the same
    name counts them once.  ``carry``: a column of the text."""
    spark = docs.sparkSession
    home = state or fresh_dir(spark, "dedup")
    name = increment or uuid.uuid4().hex
    own_path = f"{home}/records/{name}"
    if state:
        docs = _kept_content(docs.select("doc_id", "text"), f"{home}/content/{name}")
    rows, of_key = _rows(docs), lambda df: df.where(digest(sha256_digest(F.col("text"))) == F.col("digest"))
    mark = F.lit(None).cast("binary") if carry is None else carry
    if "_SUCCESS" not in _children(spark, own_path):
        told = rows.select("doc_id", sha256_digest(normalised(F.col("text"))).alias("sha"), "locator", mark.alias("mark"))
        told.write.mode("overwrite").option("compression", "zstd").parquet(own_path)
    records = spark.read.schema(_RECORD).parquet(own_path).withColumn("digest", digest(F.col("sha")))
    first = _first_batch(spark, home, name) if state else 0
    digest_state(spark, home, digest, files_per_batch)
    latest = written(state_of(spark, home), "dedup-latest")

    # Full bytes on hits: the new rows of repeated digests, and the row that stood for the digest before them.
    hit = latest.where("group_size > 1").select("digest")
    hits = written(records.join(hit, "digest").select("doc_id", "locator", "digest"), "dedup-hits")
    texts = [of_key(_contents(rows, hits, hits.count()))]
    if state:
        away = hits.select("digest").distinct().join(state_of(spark, home, first), "digest")
        away = written(away.select("digest", F.col("keep_id").alias("doc_id"), "locator"), "dedup-away")
        former = _elsewhere(spark, away)
        if former is not None:
            texts.append(of_key(_contents(former, away, away.count())))
    bodies = reduce(DataFrame.unionByName, texts).groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    # A digest once found to be shared by different texts stays so for later calls.
    bodies.where("least <> most").select("digest").write.mode("overwrite").parquet(f"{home}/collided/{name}")
    collided = spark.read.schema("digest binary").parquet(f"{home}/collided/*").join(hit, "digest", "left_semi").distinct()
    groups = records.join(latest.select("digest", "keep_id", "group_size"), "digest")
    if not collided.isEmpty():
        plain = groups.join(collided, "digest", "left_anti")
        groups = plain.select("doc_id", "sha", "mark", "keep_id", "group_size").unionByName(_regrouped(spark, home, records, rows, collided, digest, mark))
    return groups.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "mark"
    )


def _kept_content(docs: DataFrame, path: str) -> DataFrame:
    """The rows as the caller made them, written so that later calls find them by their locator."""
    spark = docs.sparkSession
    if "_SUCCESS" not in _children(spark, path):
        docs.write.mode("overwrite").parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def _regrouped(spark: SparkSession, home: str, records: DataFrame, rows: DataFrame, collided: DataFrame, digest: Callable[[Column], Column], mark: Column) -> DataFrame:
    """Digests under which different texts met: all their rows, of every call, are grouped by the text itself."""
    of_key = lambda df: df.where(digest(sha256_digest(F.col("text"))) == F.col("digest"))
    listed = records.join(collided, "digest", "left_semi")
    own = written(of_key(_contents(rows, listed, listed.count())).select("doc_id", "raw", "text"), "dedup-own")
    past = spark.read.schema(_RECORD).parquet(f"{home}/records/*").withColumn("digest", digest(F.col("sha"))).join(collided, "digest", "left_semi")
    past = past.join(records.select("locator").distinct(), "locator", "left_anti")
    every = own.select("text", "doc_id")
    former = _elsewhere(spark, past)
    if former is not None:
        every = every.unionByName(of_key(_contents(former, past, past.count())).select("text", "doc_id"))
    by_text = every.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = own.join(by_text, "text").withColumn("sha", sha256_digest(F.col("text")))
    return found.withColumn("text", F.col("raw")).withColumn("mark", mark).select("doc_id", "sha", "mark", "keep_id", "group_size")


def op8_exact_dedup(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs).drop("mark")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM t
"""
