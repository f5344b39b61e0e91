"""The corpus pipeline: quality filter, exact dedup, near dedup, source mix, packing.

Every stage reads the whole of what its predecessor kept.  All but the last return the columns of
``documents``, extra ones with any names included; an empty table gives an empty one.  Stages call the operators of
``rankframe.llm`` and are not expressible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm import exact_dedup, mixing, packing, quality, simhash
from rankframe.llm.shared import maybe_broadcast, table, text_or_empty, unused, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking model accepts; the model is fitted to the labelled rows outside the held-out fold.

    Null texts score as empty ones; repeated rows are judged each; without both labels every document scores 0.5 and stays."""
    model = quality.train(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return quality.accepted(docs, model)


def _keep(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``marks`` (doc_id, mark, kept) keeps, each once.

    Rows to drop are looked up by id and content, so texts are not shuffled while those are few enough to
    be broadcast; only rows that occur twice with the same id and content are brought together."""
    mark, id_, of = unused(docs, "mark"), unused(docs, "marked_id"), unused(docs, "marked_as")
    keyed = docs.withColumn(mark, exact_dedup.sha256_digest(text_or_empty(docs["text"])))
    named = marks.select(F.col("doc_id").alias(id_), F.col("mark").alias(of), F.col("kept").alias("kept"))
    dropped = written(named.where("NOT kept").select(id_, of).distinct(), "pipeline-dropped")
    twice = named.where("kept").groupBy(id_, of).agg(F.count("*").alias("rows")).where("rows > 1").select(id_, of)
    twice = written(twice, "pipeline-twice")
    on = lambda side: keyed["doc_id"].eqNullSafe(side[id_]) & (keyed[mark] == side[of])
    out = keyed.join(maybe_broadcast(dropped, dropped.count(), longs=6), on(dropped), "left_anti")
    n_twice = twice.count()
    if n_twice:
        side = maybe_broadcast(twice, n_twice, longs=6)
        once = out.join(side, on(side), "left_semi").dropDuplicates(["doc_id", mark])
        out = out.join(side, on(side), "left_anti").unionByName(once)
    return out.drop(mark)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the row with the smallest doc_id stays; of rows of that id and text one.

    A null text is an empty one; a null id stays only where all ids of its group are null."""
    marks = written(exact_dedup.exact_duplicates(docs, carry=exact_dedup.sha256_digest(text_or_empty())).select("doc_id", "mark", "kept"), "pipeline-exact")
    return _keep(docs, marks)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more, and all that such links reach) one
    row stays, of the smallest doc_id.

    Empty and null texts are one group; ties on doc_id go to the smaller content digest; a null id stays only where all
    ids of its group are null."""
    found = written(simhash.similar_documents(docs, carry=exact_dedup.sha256_digest(text_or_empty())), "pipeline-near")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    best = written(found.groupBy("root").agg(F.min(order).alias("best")), "pipeline-best")
    marks = found.join(best, "root").select(
        "doc_id", "mark", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark"))).alias("kept")
    )
    return _keep(docs, written(marks, "pipeline-near-marks"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: none, once or twice.  A null source is a source; rows without a word are not taken beyond whole passes."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows of all documents, in the order of the scan; a null text is its end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
