"""Steps made of several operators: taxonomy, imports, grades, lanes, search rounds, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import has_abstract
from . import assembly, evaluation, grading, planning
from .metrics import unretrieved_of_classes


def drawable_subclasses(taxonomy: DataFrame, side_asks: DataFrame, tracks: dict[str, str], drop_types=(), drop_subtypes=()) -> DataFrame:
    """``taxonomy(id, subtypes array<struct<id, anchors, ask>>)`` → (id, type_id, ask, tracks).

    Anchors are replaced by their tracks; a subtype that only has the anchor ``none`` is not drawable.  An
    ask of ``side_asks(type_id, subtype_id, side_ask)`` goes before the subtype's own.  An unknown anchor
    and a drawable subtype without an ask are errors."""
    each = taxonomy.where(~F.col("id").isin(list(drop_types))).select(F.col("id").alias("type_id"), F.explode("subtypes").alias("s"))
    each = each.select("type_id", F.col("s.id").alias("subtype_id"), F.concat_ws(".", "type_id", "s.id").alias("id"), F.coalesce("s.anchors", F.array().cast("array<string>")).alias("anchors"), F.col("s.ask").alias("ask"))
    of = F.create_map(*(F.lit(x) for pair in tracks.items() for x in pair))
    track = lambda a: F.coalesce(of[a], F.raise_error(F.concat(F.lit("unknown anchor "), a)).cast("string"))
    named = each.where(~F.col("id").isin(list(drop_subtypes))).withColumn("tracks", F.transform(F.filter("anchors", lambda a: a != "none"), track))
    with_ask = named.where(F.size("tracks") > 0).join(side_asks, ["type_id", "subtype_id"], "left")
    ask = F.coalesce("side_ask", F.nullif(F.col("ask"), F.lit("")), F.raise_error(F.concat(F.lit("no ask for "), F.col("id"))).cast("string"))
    return with_ask.select("id", "type_id", ask.alias("ask"), "tracks")


def only_lanes(lanes: dict[str, DataFrame], wanted: list[str]) -> dict[str, DataFrame]:
    """The wanted lanes; a name that is no lane is an error."""
    missing = sorted(set(wanted) - set(lanes))
    if missing:
        raise ValueError(f"no lanes {missing} among {sorted(lanes)}")
    return {name: df for name, df in lanes.items() if name in set(wanted)}


def deep_enough(items: DataFrame, group: str, k_docs: int) -> DataFrame:
    """Groups of at least max(4, k_docs // 2) items, with their number."""
    return items.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= max(4, k_docs // 2))


def restrict_lists(lists: DataFrame, a: str, b: str, keep: int = 0, records_only: bool = False, equal: bool = False) -> DataFrame:
    """Two lists of structs with a ``work_id``: the first ``keep`` (0: all), of these those with a record,
    of these as many as the shorter list has."""
    for name in (a, b):
        column = F.slice(name, 1, keep) if keep else F.col(name)
        lists = lists.withColumn(name, F.filter(column, lambda x: x["work_id"].isNotNull()) if records_only else column)
    return evaluation.equal_length(lists, a, b) if equal else lists


def adapter_parameters(r: int) -> Column:
    """Trainable parameters of rank-``r`` adapters on all seven projections of a decoder, from its
    ``hidden, heads, kv_heads, head_dim, inter, layers``."""
    c = F.col
    wide, narrow = c("heads") * c("head_dim"), c("kv_heads") * c("head_dim")
    per_layer = 2 * (c("hidden") + wide) + 2 * (c("hidden") + narrow) + 3 * (c("hidden") + c("inter"))
    return (F.lit(r) * per_layer * c("layers")).cast("long")


def coverage_gaps(cells: DataFrame, sample: DataFrame, key: str, cell: str) -> DataFrame:
    """Cells that do not cover the sample: their distinct keys against the number expected."""
    expected = sample.agg(F.countDistinct(key).alias("expected"))
    have = cells.groupBy(cell).agg(F.countDistinct(key).alias("n"))
    return have.join(F.broadcast(expected), F.col("n") != F.col("expected"))  # one row


def first_usable(attempts: DataFrame, min_hits: int = 5, max_redraws: int = 5) -> DataFrame:
    """``attempts(cell, attempt from 0, hits)``: the first with enough hits, else none of the redraws."""
    tried = attempts.where(F.col("attempt") <= max_redraws)
    good = F.when(F.col("hits") >= min_hits, F.col("attempt"))
    out = tried.groupBy("cell").agg(F.min(good).alias("attempt"), F.min_by("hits", good).alias("good_hits"), F.max_by("hits", "attempt").alias("last_hits"), F.max("attempt").alias("last"))
    return out.select("cell", "attempt", F.coalesce("good_hits", "last_hits").alias("hits"), F.coalesce("attempt", "last").alias("redraws"))


def partition_check(every: DataFrame, kept: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """One row: keys in all, kept, dropped, in both and in neither; a partition has none of the last two."""
    marked = None
    for name, df in (("every", every), ("kept", kept), ("dropped", dropped)):
        part = df.select(key, F.lit(name).alias("side"))
        marked = part if marked is None else marked.unionByName(part)
    has = lambda name: F.max((F.col("side") == name).cast("int")).alias(name)
    by = marked.groupBy(key).agg(has("every"), has("kept"), has("dropped"))
    count = lambda test, name: F.count(F.when(F.expr(test), 1)).alias(name)
    return by.agg(count("every = 1", "n"), count("kept = 1", "kept"), count("dropped = 1", "dropped"), count("kept = 1 AND dropped = 1", "twice"), count("kept + dropped = 0 OR every = 0", "stray"))


def plan_summary(cells: DataFrame, run: str, *axes: str) -> DataFrame:
    """Cells in seeded order, counted by axes, with the place of each group's first cell."""
    return planning.shuffled(cells, "cell_id", run).groupBy(*axes).agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def import_rows(rows: DataFrame, lane: str, key: str, *tests: tuple[Column, str]) -> DataFrame:
    """Rows with the reason that rejects them (null: none) and, for the others, a cell name numbered per lane."""
    judged = rows.withColumn("reason", planning.first_reason(*tests))
    numbered = planning.running_before(judged.where("reason IS NULL").withColumn("_one", F.lit(1)), [lane], [key], "_one", "_number")
    kept = numbered.withColumn("cell", F.format_string("%s-%04d", F.col(lane), F.col("_number") + 1)).drop("_one", "_number")
    return kept.unionByName(judged.where("reason IS NOT NULL").withColumn("cell", F.lit(None).cast("string")))


def clean_grades(pool: DataFrame, replies: DataFrame) -> DataFrame:
    """``pool(qid, did)``, ``replies(qid, raw_id, raw_grade, seq)`` → (qid, did, grade, imputed).

    Ids and grades are parsed and clamped, the later reply wins, what no reply names gets the floor."""
    parsed = replies.select("qid", grading.parse_grade_id(F.col("raw_id")).alias("did"), grading.clean_grade(F.col("raw_grade")).alias("grade"), "seq").where("did IS NOT NULL AND grade IS NOT NULL")
    return grading.impute_omitted(pool, grading.later_wins(parsed, ["qid", "did"], "grade", "seq"))


def convert_lane(questions: DataFrame, grades: DataFrame, min_pool: int, target: int, fraction: float, run: str) -> DataFrame:
    """``questions(qid, lane)``, ``grades(qid, did, grade)`` → (qid, lane, n_docs, split) of the rows that stay:
    usable pools, at most ``target`` a lane in seeded order, split by question."""
    real = grades.where(~F.col("did").cast("string").startswith("synth:"))
    usable = real.groupBy("qid").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_pool)
    rows = questions.join(usable, "qid").withColumn("target", F.lit(target))
    rows = planning.sample_to_target(rows, ["lane"], "qid", "target", run).where("selected").select("qid", "lane", "n_docs")
    return rows.join(assembly.group_split(rows, "lane", "qid", fraction, run).select("lane", "qid", "split"), ["lane", "qid"])


def search_rounds(asked: list[DataFrame], search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One search per hop over that hop's queries; a document is shown where it first appears."""
    hits = None
    for hop, queries in enumerate(asked, 1):
        found = search(queries).select("qid", F.lit(hop).alias("hop"), "rank", "did")
        hits = found if hits is None else hits.unionByName(found)
    return evaluation.unseen(hits)


def lacking_abstracts(cited: DataFrame, papers: DataFrame) -> DataFrame:
    """``cited(key, work_id)`` whose paper is unknown or has no abstract (``papers(work_id, abstract)``)."""
    found = cited.select("key", "work_id").distinct().join(papers.select("work_id", F.col("abstract").alias("a"), F.lit(True).alias("known")), "work_id", "left")
    return found.where(F.col("known").isNull() | ~has_abstract(F.col("a"))).select("key", "work_id", F.col("known").isNotNull().alias("has_record"))


def unretrieved_report(positives: DataFrame, run: DataFrame, by: str) -> DataFrame:
    """Positives that the run misses: overall and per class, with the number of questions; rate in percent."""
    hits = run.select("qid", "did", F.lit(1).alias("hit")).distinct()
    joined = positives.select("qid", "did", by).join(hits, ["qid", "did"], "left")
    out = joined.groupingSets([[by], []], by).agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("positives"), F.count(F.when(F.col("hit").isNull(), 1)).alias("unretrieved"), F.grouping(by).alias("overall"))
    return out.select(F.when(F.col("overall") == 1, "overall").otherwise(F.col(by).cast("string")).alias("class"), "queries", "positives", "unretrieved", F.round(100.0 * F.col("unretrieved") / F.col("positives"), 1).alias("rate"))


def unretrieved_report_of_classes(run: DataFrame, classes: DataFrame) -> DataFrame:
    """``unretrieved_report`` where a query's positives are the others of its class (``classes(id, cls)``)."""
    found = unretrieved_of_classes(run, classes, "cls").select("cls", "queries", "n_pos", "n_missed")
    out = found.groupingSets([[F.col("cls")], []], F.col("cls")).agg(F.grouping("cls").alias("overall"), *(F.sum(c).alias(c) for c in ("queries", "n_pos", "n_missed")))
    return out.select(
        F.when(F.col("overall") == 1, "overall").otherwise(F.col("cls").cast("string")).alias("class"), "queries", F.col("n_pos").alias("positives"), F.col("n_missed").alias("unretrieved"),
        F.round(100.0 * F.col("n_missed") / F.col("n_pos"), 1).alias("rate"),
    )


def grounding(searches: list[DataFrame], picks: DataFrame, keep: int = 3) -> DataFrame:
    """``searches`` in order of preference, each (qid, rank, did); ``picks(qid, rank, seq)``: the picked places.

    A question takes the first search of which something is picked, and at most ``keep`` of its picks."""
    hits = None
    for i, found in enumerate(searches):
        part = found.select("qid", F.lit(i).alias("attempt"), "rank", "did")
        hits = part if hits is None else hits.unionByName(part)
    chosen = hits.join(picks, ["qid", "rank"]).withColumn("used", F.min("attempt").over(W.partitionBy("qid"))).where("attempt = used")
    return chosen.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("seq", "rank"))).where(F.col("place") <= keep).select("qid", "attempt", "did", "place")
