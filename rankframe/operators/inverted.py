"""BM25 over an inverted index that is kept on disk, appended to and pruned.

An index is a folder.  ``postings`` holds blocks, in folders by the hash of their term: a block is what one term has in one
group of documents of one field, with the greatest term frequency and the least document length in it.  Documents are
dealt to groups by the hash of their id, so a block is of bounded size whatever the term, and very common terms lie in as
many tasks as there are groups.  ``fields`` holds documents and lengths of each field and append.

Document frequencies and mean lengths are summed when a query set is asked, so appends leave nothing to rewrite.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import scratch

#: Documents of a group, about; folders of the postings by the term's hash; groups that a query's threshold is taken from.
GROUP_DOCS, BUCKETS, FIRST_GROUPS = 4096, 16, 2
#: Scores are rounded to six digits, so a bound may lie below the score it bounds by half of the last.
_SLACK = 1e-6


def terms(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; none of a null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def append_index(docs: DataFrame, path: str, fields: tuple[str, ...] = ("text",), group_docs: int = GROUP_DOCS, buckets: int = BUCKETS) -> None:
    """Add ``docs(did, *fields)`` to the index at ``path``, which may not exist yet.

    Ids must be new to the index.  Only what is added is read; groups are numbered by append, so no block is touched twice.
    All appends must give the same fields and buckets."""
    spark = docs.sparkSession
    long = docs.select("did", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("terms")) for f in fields))).alias("f")).select("did", "f.*")
    measured = long.withColumn("len", F.size("terms").cast("long"))
    n = docs.count()
    groups = max(1, math.ceil(n / group_docs))
    segment = F.lit(scratch(spark, "segment").rsplit("-", 1)[1])
    counts = measured.select("did", "field", "len", F.explode("terms").alias("term")).groupBy("did", "field", "len", "term").agg(F.count("*").alias("tf"))
    group = F.concat_ws("-", segment, F.pmod(F.xxhash64("did"), F.lit(groups)).cast("string"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    blocks = counts.groupBy(bucket.alias("bucket"), "term", "field", group.alias("group")).agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.sort_array(F.collect_list(F.struct("did", "tf", "len"))).alias("docs"),
    )
    blocks.repartition("bucket", F.pmod(F.xxhash64("term", F.lit(3)), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    measured.groupBy("field").agg(F.count("*").alias("docs"), F.sum("len").alias("total")).coalesce(1).write.mode("append").parquet(f"{path}/fields")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, k1: float = 0.9, b: float = 0.4, prune: bool = True) -> DataFrame:
    """``queries(qid, text)`` → qid, did, score, rank: the k best documents, fields' scores added.

    Two passes over the query terms' blocks, none over documents.  A block's maxima bound what its term can add to a
    document; summed over terms they bound every score in a group.  The groups of the highest bounds are scored first; a
    further group is read only if its bound reaches the k-th score found there, so the result is that of all groups.
    A document of which no query term is known has no row; a query without known terms has none."""
    asked = queries.select("qid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    wanted = asked.select("term").distinct()
    postings = spark.read.parquet(f"{path}/postings")
    heads = postings.select("term", "field", "group", "n", "max_tf", "min_len").join(wanted, "term", "left_semi")
    whole = spark.read.parquet(f"{path}/fields").groupBy("field").agg(F.sum("docs").alias("all"), (F.sum("total") / F.sum("docs")).alias("mean"))
    met = heads.groupBy("term", "field").agg(F.sum("n").alias("df")).join(F.broadcast(whole), "field")  # a row a field
    idf = F.ln(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = lambda tf, length: F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("mean")))
    weights = scratch(spark, "weights")
    met.select("term", "field", idf.alias("idf"), "mean").write.parquet(weights)
    weighted = spark.read.parquet(weights)
    bounds = scratch(spark, "bounds")
    bound = heads.join(weighted, ["term", "field"]).withColumn("most", part(F.col("max_tf"), F.col("min_len"))).join(asked, "term").groupBy("qid", "group").agg(F.sum("most").alias("most"))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("most"), "group"))
    bound.withColumn("place", place).write.parquet(bounds)
    bound = spark.read.parquet(bounds)

    def scored(groups: DataFrame) -> DataFrame:
        """Scores of all documents of (qid, group) that hold a term of the query."""
        hits = asked.join(groups.select("qid", "group"), "qid").join(postings.select("term", "field", "group", "docs"), ["term", "group"])
        each = hits.join(weighted, ["term", "field"]).select("qid", "idf", "mean", F.explode("docs").alias("d"))
        return each.groupBy("qid", F.col("d.did").alias("did")).agg(F.round(F.sum(part(F.col("d.tf"), F.col("d.len"))), 6).alias("score"))

    best = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "did"))
    if not prune:
        return scored(bound).withColumn("rank", best).where(F.col("rank") <= k)
    first = scratch(spark, "first")
    scored(bound.where(F.col("place") <= FIRST_GROUPS)).withColumn("rank", best).where(F.col("rank") <= k).write.parquet(first)
    first = spark.read.parquet(first).drop("rank")
    floor = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    open_ = bound.where(F.col("place") > FIRST_GROUPS).join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - _SLACK))
    return first.unionByName(scored(open_)).withColumn("rank", best).where(F.col("rank") <= k)
