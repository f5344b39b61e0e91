"""Web sources as snapshot tables: the engine makes no calls, it reads what was fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_SCHEMA = "openfda struct<generic_name: array<string>, brand_name: array<string>>, indications_and_usage array<string>"
ARTICLE_SCHEMA = (
    "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>,"
    " Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>>>"
)


def search_labels(snapshot: DataFrame, term: str, limit: int = 0) -> DataFrame:
    """``snapshot(id, body)`` of drug labels as JSON: those with ``term`` in a name; none is an empty result."""
    label = F.from_json("body", LABEL_SCHEMA)
    names = F.concat(F.coalesce("label.openfda.generic_name", F.array().cast("array<string>")), F.coalesce("label.openfda.brand_name", F.array().cast("array<string>")))
    found = snapshot.withColumn("label", label).where(F.exists(names, lambda n: F.contains(F.lower(n), F.lit(term.lower())))).select("id", "label")
    return found.orderBy("id").limit(limit) if limit else found


def articles(snapshot: DataFrame, asked: DataFrame) -> DataFrame:
    """``snapshot(body)``, one article's XML a row, and ``asked(pmid)`` → pmid, title, abstract, journal, year.

    The year falls back to the first four digits of a free date; an id without a record has a stand-in title."""
    c = F.from_xml("body", ARTICLE_SCHEMA)["MedlineCitation"]
    rows = snapshot.select(c.alias("c")).select(F.col("c.PMID").alias("pmid"), F.col("c.Article").alias("a"))
    date, text = F.col("a.Journal.JournalIssue.PubDate"), lambda x: F.trim(F.coalesce(x, F.lit("")))
    year = F.when(text(date["Year"]) != "", text(date["Year"])).otherwise(F.regexp_extract(text(date["MedlineDate"]), r"[0-9]{4}", 0))
    abstract = F.trim(F.array_join(F.transform(F.coalesce("a.Abstract.AbstractText", F.array().cast("array<string>")), lambda x: F.trim(x)), " "))
    parsed = rows.select("pmid", text(F.col("a.ArticleTitle")).alias("title"), abstract.alias("abstract"), text(F.col("a.Journal.Title")).alias("journal"), year.alias("year")).dropDuplicates(["pmid"])
    found = asked.select("pmid").distinct().join(parsed, "pmid", "left")
    return found.select("pmid", F.coalesce("title", F.lit("(title unavailable)")).alias("title"), *(F.coalesce(x, F.lit("")).alias(x) for x in ("abstract", "journal", "year")))
