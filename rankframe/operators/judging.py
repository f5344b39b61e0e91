"""What a judge is shown: two lists of sources a question, cut alike and rendered into one prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fill
from .evaluation import judge_order


def judge_inputs(
    questions: DataFrame, sources: DataFrame, records: DataFrame, prompt: str, record_line: str, other_line: str, run: str,
    keep: int = 0, records_only: bool = False, same_length: bool = False, flip: bool = False,
) -> DataFrame:
    """``questions(qid, question)`` and ``sources(qid, side, place, work_id, title, venue, year)``, side ``ours`` or
    ``other``; ``records(work_id, title, venue, year, abstract)``, one row an id → qid, ours_is, n_ours, n_other, prompt.

    Each list is cut to its first ``keep`` (0: all); with ``records_only`` sources without a work_id are left out then, and
    with ``same_length`` both are cut to the shorter.  A source with a work_id is shown by its record and ``record_line``,
    another as it is by ``other_line``; ``{{n}}`` is its number in what is shown, from 1.  A seeded coin for each question
    says which list is A; ``flip`` turns it over.  ``prompt`` takes ``{{question}}``, ``{{list_a}}`` and ``{{list_b}}``.

    Sources of one place go by title and work_id.  A work_id without a record is shown with empty fields.  A question
    without sources has empty lists; sources of no question are not read.  Only what is shown is joined with records."""
    by = W.partitionBy("qid", "side").orderBy("place", "title", "work_id")
    shown = sources.join(questions.select("qid"), "qid", "left_semi").withColumn("n", F.row_number().over(by))
    if keep:
        shown = shown.where(F.col("n") <= keep)
    if records_only:
        shown = shown.where("work_id IS NOT NULL").withColumn("n", F.row_number().over(by))
    sizes = shown.groupBy("qid").agg(*(F.count(F.when(F.col("side") == side, 1)).alias(f"n_{side}") for side in ("ours", "other")))
    if same_length:
        both = F.least("n_ours", "n_other")
        sizes = sizes.select("qid", both.alias("n_ours"), both.alias("n_other"))
        shown = shown.join(sizes.select("qid", F.col("n_ours").alias("most")), "qid").where(F.col("n") <= F.col("most")).drop("most")
    named = ("title", "venue", "year", "abstract")
    known = records.select(F.col("work_id").alias("of_id"), *(F.col(c).alias(f"record_{c}") for c in named))
    met = shown.join(known, F.col("work_id") == F.col("of_id"), "left")
    from_record = fill(record_line, n=F.col("n"), **{c: F.col(f"record_{c}") for c in named})
    from_source = fill(other_line, n=F.col("n"), **{c: F.col(c) for c in named[:3]}, abstract=F.lit(""))
    line = F.when(F.col("work_id").isNotNull(), from_record).otherwise(from_source)
    # A list is of one question and side; lines come in any order and are sorted by their number.
    of_side = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("n", "line")))
    lists = met.withColumn("line", line).groupBy("qid").agg(of_side("ours").alias("ours"), of_side("other").alias("other"))
    text = lambda c: F.coalesce(F.array_join(F.transform(F.sort_array(c), lambda x: x["line"]), "\n"), F.lit(""))
    out = questions.select("qid", "question").join(sizes, "qid", "left").join(lists, "qid", "left").withColumn("first", judge_order(F.col("qid"), F.lit(flip), run))
    ours, other = text("ours"), text("other")
    filled = fill(prompt, question=F.col("question"), list_a=F.when(F.col("first"), ours).otherwise(other), list_b=F.when(F.col("first"), other).otherwise(ours))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("qid", F.when(F.col("first"), "A").otherwise("B").alias("ours_is"), count("n_ours"), count("n_other"), filled.alias("prompt"))
