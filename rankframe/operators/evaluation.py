"""Agent evaluation: what is shown, lists, judgments, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seeds import uniform
from ..functions.text import edits, normalise_title, title_edits


def unseen(hits: DataFrame) -> DataFrame:
    """``hits(qid, hop, rank, did)``: each id once per question, where it first appears."""
    place = F.row_number().over(W.partitionBy("qid", "did").orderBy("hop", "rank"))
    return hits.withColumn("_n", place).where("_n = 1").drop("_n")


def ranking_list(sources: DataFrame) -> DataFrame:
    """``sources(qid, place, id, pmid)`` → ranked PMIDs without repeats; one without keeps its slot."""
    named = sources.withColumn("did", F.coalesce(F.nullif(F.col("pmid"), F.lit("")), F.concat(F.lit("UNMAPPED_"), F.col("id").cast("string"))))
    first = named.groupBy("qid", "did").agg(F.min("place").alias("place"))
    by = W.partitionBy("qid")
    return first.withColumn("rank", F.row_number().over(by.orderBy("place"))).withColumn("score", (F.count("*").over(by) - F.col("rank") + 1).cast("double")).drop("place")


def hop_rankings(sources: DataFrame) -> DataFrame:
    """``sources(qid, hop, place, did)``, what each hop of a search adds → (qid, hop, did, rank), the ranking after each hop.

    A ranking holds what the hops so far have found, each id once, in the order of its first appearance; so one order serves
    all hops of a question, and a hop's ranking is its head.  ``hop`` is text: hops of digits come first, in the order
    of their numbers, then the others by name.  A place that repeats goes by did; null ids and hops are left out."""
    key = F.struct((~F.col("hop").rlike("^[0-9]+$")).alias("named"), F.when(F.col("hop").rlike("^[0-9]+$"), F.col("hop").cast("decimal(38,0)")).alias("number"), "hop")
    usable = sources.where("hop IS NOT NULL AND did IS NOT NULL").withColumn("at", key)
    first = usable.groupBy("qid", "did").agg(F.min(F.struct("at", "place", "did")).alias("first"))
    ranked = first.select("qid", "did", F.col("first.at").alias("since"), F.row_number().over(W.partitionBy("qid").orderBy("first")).alias("rank"))
    hops = usable.select(F.col("qid").alias("of"), "hop", "at").distinct()
    return hops.join(ranked, F.col("of").eqNullSafe(F.col("qid")) & (F.col("since") <= F.col("at"))).select("qid", "hop", "did", "rank")


#: Bytes of variants of listed titles that are broadcast to the papers.
LISTED_BYTES = 64 << 20


def resolve_titles(listed: DataFrame, papers: DataFrame, limit: int = 3) -> DataFrame:
    """``listed(lid, title)`` against ``papers(did, title, cited[, pmid])``: the closest title within ``limit`` edits;
    of equally close ones the record with a PMID, then the most cited, then the smallest did.

    Titles are compared normalised, each distinct one once.  With at most ``limit`` edits one of limit + 1 pieces of
    the paper's title stands whole in the listed one, near its own place.  So papers, the large side, give their
    pieces (limit + 1 rows a title), and the listed titles, the small side, every substring that can be one, for every
    length and place within the limit; these are an equality key, and the edit distance then decides."""
    spelt = listed.select("lid", normalise_title(F.col("title")).alias("a"))
    wanted = spelt.where("a <> ''").select("a").distinct()
    pmid = F.coalesce("pmid", F.lit("")) if "pmid" in papers.columns else F.lit("")
    rank = F.struct((pmid == "").alias("no_pmid"), (-F.coalesce("cited", F.lit(0))).alias("less_cited"), "did")
    titles = papers.select(normalise_title(F.col("title")).alias("b"), rank.alias("rank")).where("b <> ''").groupBy("b").agg(F.min("rank").alias("rank"))
    pieces = limit + 1
    from_, to = (lambda i: F.floor(F.col("m") * i / pieces).cast("int")), (lambda i: F.floor(F.col("m") * (i + 1) / pieces).cast("int"))
    number = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("i")
    cut = titles.withColumn("m", F.length("b")).select("b", "rank", "m", number)
    cut = cut.select("b", "rank", "m", "i", F.substring(F.col("b"), from_(F.col("i")) + 1, to(F.col("i")) - from_(F.col("i"))).alias("key"))
    n = F.length("a")
    sized = wanted.select("a", F.explode(F.sequence(F.greatest(F.lit(1), n - limit), n + limit)).alias("m")).select("a", "m", number)
    low, high = from_(F.col("i")), to(F.col("i"))
    placed = sized.select("a", "m", "i", (high - low).alias("size"), F.explode(F.sequence(F.greatest(F.lit(0), low - limit), low + limit)).alias("place"))
    variants = placed.select("a", "m", "i", F.substring(F.col("a"), F.col("place") + 1, F.col("size")).alias("key")).where(F.length("key") == F.col("size")).distinct()
    # A title of n characters has at most (2 limit + 1)^2 pieces times its variants, each a row with the title and a piece.
    rows = (limit + 1) * (2 * limit + 1) ** 2
    size = wanted.agg(F.sum((F.octet_length("a") * (1 + 1 / (limit + 1)) + 32) * rows)).first()[0] or 0
    if size <= LISTED_BYTES:
        variants = F.broadcast(variants)
    met = cut.join(variants, ["m", "i", "key"]).select("a", "b", "rank").distinct()
    scored = met.where(F.levenshtein("a", "b", limit) >= 0).withColumn("edits", edits(F.col("a"), F.col("b"))).where(F.col("edits") <= limit)
    best = scored.groupBy("a").agg(F.min(F.struct("edits", "rank")).alias("best")).select("a", F.col("best.rank.did").alias("did"), F.col("best.edits").alias("edits"))
    return spelt.join(best, "a", "left").select("lid", "did", "edits")


def zero_shot(lists: DataFrame, papers: DataFrame, keep: int, limit: int = 3) -> DataFrame:
    """``lists(qid, place, title)``, titles that a model named from memory: each question's distinct ones, trimmed, and
    the paper that each resolves to (null: it does not exist).  ``kept`` is the place of the first ``keep`` papers of a
    question, each counted once; null for the others."""
    trimmed = lists.select("qid", "place", F.trim("title").alias("title")).where("title <> ''")
    once = trimmed.groupBy("qid", "title").agg(F.min("place").alias("place"))
    keyed = once.withColumn("lid", F.struct("qid", "place"))
    found = once.join(resolve_titles(keyed.select("lid", "title"), papers, limit).select("lid.qid", "lid.place", "did", "edits"), ["qid", "place"])
    first = found.where("did IS NOT NULL").groupBy("qid", "did").agg(F.min("place").alias("place"))
    first = first.withColumn("kept", F.row_number().over(W.partitionBy("qid").orderBy("place"))).where(F.col("kept") <= keep)
    return found.join(first, ["qid", "place", "did"], "left")


def hallucination_rate(resolved: DataFrame, *by: str) -> DataFrame:
    """Of the titles listed (``did`` null where none exists): listed, unresolved and their share; null without any."""
    out = resolved.groupBy(*by).agg(F.count("*").alias("listed"), F.count(F.when(F.col("did").isNull(), 1)).alias("unresolved"))
    return out.withColumn("rate", F.round(F.col("unresolved") / F.nullif(F.col("listed"), F.lit(0)), 4))


def best_match(cited: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """``cited(key, title, year, author)`` and the records a search found for each, ``records(key, place, did, title,
    year, author)``: the best of them, accepted ones first, then the closest title, then the first; did, edits and
    accepted are null where none was found."""
    named = records.select(key, "place", "did", F.col("title").alias("record_title"), F.col("year").alias("record_year"), F.col("author").alias("record_author"))
    both = cited.join(named, key).withColumn("edits", title_edits(F.regexp_replace(F.trim("title"), r"\.+$", ""), F.col("record_title")))
    both = both.withColumn("accepted", accepted(F.col("year"), F.col("record_year"), F.col("author"), F.col("record_author"), F.col("edits")))
    best = both.groupBy(key).agg(F.min(F.struct((~F.col("accepted")).alias("refused"), "edits", "place", "did")).alias("b"))
    return cited.join(best, key, "left").select(*cited.columns, "b.did", "b.edits", (~F.col("b.refused")).alias("accepted"))


def accepted(year: Column, record_year: Column, author: Column, record_author: Column, edits: Column) -> Column:
    y = F.abs(record_year.try_cast("int") - year.try_cast("int")) <= 1
    a = (F.coalesce(author, F.lit("")) == "") | ((record_author != "") & F.contains(F.lower(author), F.lower(record_author)))
    return F.coalesce((edits <= 3) & y & a, F.lit(False))


def judge_order(key: Column, flip: Column, run: str) -> Column:
    """Whether the first list is shown as A: a seeded coin, turned over on the second round."""
    return (uniform(F.lit(run), key) < 0.5) != flip


def judge_counts(judged: DataFrame) -> DataFrame:
    """``judged(pair, winner, first_is_a, round)`` → wins per side, wins of list A, share of round 1."""
    return judged.groupBy("pair").agg(
        F.count(F.when(F.col("winner") == 1, 1)).alias("wins_1"), F.count(F.when(F.col("winner") == 2, 1)).alias("wins_2"),
        F.count(F.when((F.col("winner") == 1) == F.col("first_is_a"), 1)).alias("wins_shown_a"),
        F.round(100.0 * F.count(F.when((F.col("round") == 1) & (F.col("winner") == 1), 1)) / F.nullif(F.count(F.when(F.col("round") == 1, 1)), F.lit(0)), 1).alias("pct_1_round_1"),
    )


def equal_length(lists: DataFrame, a: str, b: str, keep: int = 0) -> DataFrame:
    """Both lists cut to ``keep`` (0: all), then to the length of the shorter."""
    cut = lambda c: F.slice(c, 1, keep) if keep else F.col(c)
    out = lists.withColumn(a, cut(a)).withColumn(b, cut(b))
    n = F.least(F.size(a), F.size(b))
    return out.withColumn("_n", n).withColumn(a, F.slice(a, 1, F.col("_n"))).withColumn(b, F.slice(b, 1, F.col("_n"))).drop("_n")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """``docs(did, text)``, ``queries(qid, text)``: an inverted index as a table, scored by joins on terms.

    Only terms of the query set are indexed; very common terms are split over partitions by AQE."""
    terms = lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    asked = queries.select("qid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    tokens = docs.select("did", terms(F.col("text")).alias("terms")).withColumn("len", F.size("terms"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    index = tokens.select("did", "len", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    index = index.groupBy("term", "did").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    scored = asked.join(index, "term").join(df, "term").crossJoin(F.broadcast(stats)).groupBy("qid", "did").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "did"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
