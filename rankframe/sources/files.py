"""File sources and sinks.  Paths are whatever Spark's file systems open."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rankframe-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/rankframe-io/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to scratch: what several branches of a plan read is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, tolerant: bool = False) -> DataFrame:
    """One record per line; ``tolerant`` skips malformed lines instead of failing."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(paths)


def aliased(df: DataFrame, **names: tuple[str, ...]) -> DataFrame:
    """Columns under one name whichever of their alternate names a file uses; missing ones are null."""
    pick = lambda options: F.coalesce(*(F.col(f"`{o}`") for o in options if o in df.columns)) if set(options) & set(df.columns) else F.lit(None)
    return df.select(*(pick(options).alias(name) for name, options in names.items()))


def lookup(table: DataFrame, columns: Iterable[str], ids: DataFrame, key: str) -> DataFrame:
    """Chosen columns of the rows whose key is in ``ids``; Catalyst prunes the scan and picks the join."""
    return table.select(key, *(c for c in columns if c != key)).join(ids.select(key).distinct(), key, "left_semi")


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header, quote="")


def write_run(run: DataFrame, path: str) -> None:
    """query_id, rank, doc_id, score with seven decimals, tab-separated."""
    out = run.select("qid", "rank", "did", F.printf(F.lit("%.7f"), F.col("score")).alias("score"))
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def replace_table(df: DataFrame, path: str) -> str:
    """Put ``df`` in the place of the table at ``path`` at one instant: rows are written aside as a version of their
    own, then a pointer file is renamed over the former one.  A write that fails leaves the former table."""
    spark = df.sparkSession
    version = f"v{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    aside, pointer = hadoop(f"{path}/next-{version}"), hadoop(f"{path}/current")
    system = aside.getFileSystem(conf)
    out = system.create(aside, True)
    out.write(bytearray(version, "ascii"))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    modes = spark.sparkContext._gateway.new_array(rename, 1)
    modes[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, pointer, modes)
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table that was last put at ``path``; a reader keeps its version while others are put in its place."""
    version = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/{version}")


def shard_completeness(names: DataFrame, column: str = "name") -> DataFrame:
    """``<family>.<n>_of_<total>`` → per family whether every part is there exactly once."""
    pattern = r"^(.*)\.([0-9]+)_of_([0-9]+)$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    parts = names.where(F.col(column).rlike(pattern)).select(part(1).alias("family"), part(3).cast("int").alias("total"), part(2).cast("int").alias("n"))
    return parts.groupBy("family", "total").agg(F.countDistinct("n").alias("have")).withColumn("complete", F.col("have") == F.col("total"))


def inconsistent(meta: DataFrame, **expected) -> DataFrame:
    """How many shards disagree with what is expected, per field."""
    checks = [F.count(F.when(~F.col(k).eqNullSafe(F.lit(v)), 1)).alias(k) for k, v in expected.items()]
    return meta.agg(*checks)


def papers(df: DataFrame) -> DataFrame:
    """Defaults of the papers table: pmid '', type article, year as text, a stand-in for no abstract."""
    empty = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return df.select(
        "work_id", F.coalesce("pmid", F.lit("")).alias("pmid"), empty("type", "article").alias("type"), "title",
        F.col("publication_year").cast("string").alias("year"), empty("abstract", "No abstract").alias("abstract"),
    )


def assemble_index(index: DataFrame, selected: DataFrame, shard: str) -> DataFrame:
    """Selected rows (shard, row_index) of an index as one new shard, numbered anew in their old order."""
    from ..operators.planning import positions

    rows = index.join(selected.select("shard", "row_index").distinct(), ["shard", "row_index"], "left_semi")
    placed = positions(rows.select(F.col("shard").alias("old_shard"), F.col("row_index").alias("old_row"), "id"), "old_shard", "old_row")
    return placed.select(F.lit(shard).alias("shard"), F.col("position").alias("row_index"), "id")


def union_lanes(lanes: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in lanes.items():
        df = df.withColumn("lane", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no lanes")
    return out


def report(df: DataFrame, row: str, column: str, value: Column, columns: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, columns).agg(value)


def manifest(df: DataFrame, *columns: str) -> DataFrame:
    """One digest of a table's content, independent of row order: the sum of row digests."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(digest).cast("string").alias("digest"))


def expect(df: DataFrame, **counts: int) -> DataFrame:
    """``df`` has one row; fail unless its columns equal the expected counts."""
    for name, value in counts.items():
        message = F.concat(F.lit(f"{name}: expected {value}, found "), F.col(name).cast("string"))
        df = df.withColumn(name, F.when(F.col(name) == value, F.col(name)).otherwise(F.raise_error(message)))
    return df


def refuse(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """``df``, which fails when it is read if ``bad`` holds for a row of it: the guard before a step that must not run."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message))).otherwise(F.col(first)))


def same_manifest(found: DataFrame, rows: int, digest: str) -> DataFrame:
    """``found``, a manifest, if it is that of the table that was pinned."""
    return refuse(found, ~F.col("rows").eqNullSafe(F.lit(rows)) | ~F.col("digest").eqNullSafe(F.lit(digest)), "the table is not the one that was pinned")


def no_blanks(docs: DataFrame, column: str, most: float = 0.0) -> DataFrame:
    """n and blank, the texts that are null or white space; fails if their share is above ``most``."""
    found = docs.agg(F.count("*").alias("n"), F.count(F.when(F.trim(F.coalesce(column, F.lit(""))) == "", 1)).alias("blank"))
    return refuse(found, F.col("blank") > F.col("n") * most, f"more than {most:.0%} of the texts are blank")


def even_groups(rows: DataFrame, key: str) -> DataFrame:
    """groups, least and most rows of a group; fails unless all are of one size."""
    found = rows.groupBy(key).count().agg(F.count("*").alias("groups"), F.min("count").alias("least"), F.max("count").alias("most"))
    return refuse(found, F.col("least") != F.col("most"), f"groups by {key} differ in size")


def all_settled(units: DataFrame, settled: Column) -> DataFrame:
    """units and open, those not settled; fails while any is open: the next round is not planned on half a round."""
    found = units.agg(F.count("*").alias("units"), F.count(F.when(~F.coalesce(settled, F.lit(False)), 1)).alias("open"))
    return refuse(found, F.col("open") > 0, "units of the round are not settled")
