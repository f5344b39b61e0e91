"""The label that stands for a drug name, of the many that name it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of original applications (fixed values); words that a name is compared on at most when it is part of another.
ORIGINAL, MOST_WORDS = r"^(NDA|BLA)(\d+)$", 12
#: Match tiers, best first.
TIERS = ("brand", "generic", "in brand", "in generic")


def _words(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _phrases(name: Column) -> Column:
    """All runs of 1 to ``MOST_WORDS`` neighbouring words of a name."""
    words = _words(name)
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    run = lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i + 1, F.lit(MOST_WORDS))), lambda size: F.array_join(F.slice(words, i, size), " "))
    return F.array_distinct(F.flatten(F.transform(starts, run)))


def label_keys(labels: DataFrame, *carried: str) -> DataFrame:
    """(key, tier, label_id) of ``labels(label_id, brand_names, generic_names)``, and what is carried: whole names, and the phrases in them."""
    whole = lambda names: F.transform(names, lambda n: F.concat(F.lit("="), F.lower(n)))
    inside = lambda names: F.transform(F.array_distinct(F.flatten(F.transform(names, _phrases))), lambda p: F.concat(F.lit("~"), p))
    of = [(0, whole("brand_names")), (1, whole("generic_names")), (2, inside("brand_names")), (3, inside("generic_names"))]
    tiered = lambda tier, keys: F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(k.alias("key"), F.lit(tier).alias("tier")))
    keyed = F.flatten(F.array(*(tiered(tier, keys) for tier, keys in of)))
    return labels.select("label_id", *carried, F.explode(F.array_distinct(keyed)).alias("k")).select("k.key", "k.tier", "label_id", *carried)


def _newest(rows: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """Adds ``newest`` a group: (effective_time, label_id) of the latest time (nulls last), then of the smallest label."""
    first = rows.groupBy(*by, "effective_time").agg(F.min("label_id").alias("label_id"), *(f.alias(n) for n, f in sums.items()))
    return first.groupBy(*by).agg(F.max(F.struct("effective_time", "label_id")).alias("newest"), *(f.alias(n) for n, f in sums.items()))


def _by_key(labels: DataFrame) -> DataFrame:
    """(key, tier) with what a choice needs of the labels that have the key: whether one is ``filed``, the best original
    application ``o`` and the ``newest`` label.  Labels are summed up by key where they lie, before names meet them: no row
    stands for a match of a name with a label, of which one name can have as many as there are labels."""
    number = lambda a: F.ltrim(F.regexp_extract(a, ORIGINAL, 2), F.lit("0"))
    original = F.transform(F.filter("applications", lambda a: F.coalesce(a.rlike(ORIGINAL), F.lit(False))), lambda a: F.struct(F.length(number(a)).alias("size"), number(a).alias("number"), a.alias("application")))
    facts = labels.select("label_id", "brand_names", "generic_names", "effective_time", (F.size("applications") > 0).alias("filed"), F.array_min(original).alias("o"))
    return _newest(label_keys(facts, "effective_time", "filed", "o"), ["key", "tier"], filed=F.max("filed"), o=F.min("o"))


def choose_label(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """For each distinct ``asked(name)`` one of ``labels(label_id, brand_names, generic_names, applications, effective_time)``.

    The best tier in which a label with an application matches wins: brand equal, generic equal, brand containing the name
    as whole words, generic containing it (case is ignored).  Of the applications of that tier's labels the NDA or BLA of the
    lowest number is the original maker's; the newest label filed under it is chosen, also one that the name does not match.
    Without such an application the newest matching label is chosen.  Equally new ones: the smallest label_id.

    Gives name, tier, application and label_id; a name that nothing matches, or a null, has nulls.  Names join by equal keys
    in one pass over all tiers; an asked name of more than ``MOST_WORDS`` words matches whole names only."""
    names = asked.select("name").distinct()
    text = F.trim(F.translate("name", '"/', "  "))
    phrase = F.concat(F.lit("~"), F.array_join(_words(text), " "))
    keys = names.select("name", F.explode(F.array(F.concat(F.lit("="), F.lower(text)), phrase)).alias("key")).where("key NOT IN ('=', '~')")
    facts = labels.withColumn("applications", F.coalesce("applications", F.array().cast("array<string>")))
    # A name has one key a tier.  Joins go by shuffle: sizes of exploded names cannot be estimated, and what is too large must not be sent.
    # A label counts in every tier in which it matches, so one of a better tier without applications does not hide others.
    best = F.min(F.when(F.col("filed"), F.col("tier"))).over(W.partitionBy("name"))
    hits = keys.join(_by_key(facts).hint("merge"), "key").withColumn("best", best).where("tier = best").select("name", "tier", F.col("o.application").alias("application"), "newest")
    under = _newest(facts.select("label_id", "effective_time", F.explode("applications").alias("application")), ["application"]).withColumnRenamed("newest", "filed_newest")
    both = hits.join(under.hint("merge"), "application", "left")
    chosen = both.withColumn("label_id", F.when(F.col("application").isNull(), F.col("newest.label_id")).otherwise(F.col("filed_newest.label_id")))
    named = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1)
    return names.join(chosen.select("name", named.alias("tier"), "application", "label_id").hint("merge"), "name", "left")
