"""String functions of the retrieval pipelines, as Spark columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def norm_ws(x: Column) -> Column:
    """White space runs become one space; trimmed; lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))


def normalise_title(x: Column) -> Column:
    """Lower case; everything but a-z and 0-9 becomes a space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def title_text(title: Column, text: Column) -> Column:
    """Title and text joined by a space, trimmed; nulls are empty."""
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))


def has_abstract(x: Column, least: int = 50) -> Column:
    return F.length(F.trim(F.coalesce(x, F.lit("")))) >= least


def strip_comments(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)<!--.*?-->\n?", "")


def strip_suffix(x: Column, suffix: str) -> Column:
    return F.when(F.endswith(x, F.lit(suffix)), F.substring(x, F.lit(1), F.length(x) - len(suffix))).otherwise(x)


#: Shorter terms are not looked for; all-capital terms up to this length match case-sensitively.
SHORTEST_TERM, LONGEST_ACRONYM = 3, 8


def is_acronym(term: Column, longest: int = LONGEST_ACRONYM) -> Column:
    """All capitals and short: such terms match case-sensitively."""
    return (term == F.upper(term)) & (term != F.lower(term)) & (F.length(term) <= longest)


def leak_hit(text: Column, terms: Column) -> Column:
    """The first of ``terms`` (an array) that occurs in ``text`` on word boundaries, or null.

    Terms under three characters are ignored; short all-capital terms match case-sensitively."""
    trimmed = F.transform(terms, lambda t: F.trim(F.coalesce(t, F.lit(""))))

    def hit(t: Column) -> Column:
        quoted = F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\b"))
        return F.when(is_acronym(t), F.regexp_like(text, quoted)).otherwise(F.regexp_like(text, F.concat(F.lit("(?iu)"), quoted)))

    return F.try_element_at(F.filter(trimmed, lambda t: (F.length(t) >= SHORTEST_TERM) & hit(t)), F.lit(1))


def names_found(hay: Column, names: Column) -> Column:
    """Whether any name is a substring, after white space and case are levelled."""
    return F.exists(names, lambda n: F.contains(norm_ws(hay), norm_ws(n)) & (norm_ws(n) != ""))


def either_contains(answer: Column, names: Column) -> Column:
    a = norm_ws(answer)
    return F.exists(names, lambda n: (norm_ws(n) != "") & (a != "") & (F.contains(a, norm_ws(n)) | F.contains(norm_ws(n), a)))


def boolean_query(title: Column, stop: tuple[str, ...]) -> Column:
    words = F.filter(F.split(normalise_title(title), " "), lambda w: (w != "") & ~w.isin(*stop))
    return F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("[Title]"))), " AND ")


def fill(template: str, **slots: Column) -> Column:
    """Fill ``{{name}}`` slots in one pass: text that a value brings in is never filled again."""
    import re

    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{(\w+)\}\}", template):
        if m[1] not in slots:
            raise ValueError(f"slot {m[1]} has no value")
        parts += [F.lit(template[at : m.start()]), F.coalesce(slots[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def clean_citation(c: Column) -> Column:
    """Brackets go; ``FDA:`` names are lower case; ``PMID 123`` and ``123`` are ``PMID:123``."""
    c = F.trim(F.regexp_replace(c, r"^[\[\] ]+|[\[\] ]+$", ""))
    return F.when(F.lower(c).startswith("fda:"), F.concat(F.lit("FDA:"), F.lower(F.trim(F.substring(c, 5, 1 << 20))))).otherwise(
        F.regexp_replace(c, r"(?i)^(?:PMID)?[:\s]*([0-9]+)$", "PMID:$1")
    )


def clean_citations(asked: Column, shown: Column, keep: int) -> Column:
    """Only what was shown, no repeats, in order, at most ``keep``."""
    return F.slice(F.array_distinct(F.filter(F.transform(asked, clean_citation), lambda c: F.array_contains(shown, c))), 1, keep)


def text_of_positions(index: Column) -> Column:
    """The text of a ``{word: [positions]}`` map, in order of position."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda e: e["w"]), " ")


def year_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"[0-9]{4}", 0), F.lit(""))


def lenient_json(x: Column) -> Column:
    """Strict JSON, else a fenced block, else the outermost braces or brackets; a VARIANT or null."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    outer = F.regexp_extract(x, r"(?s)([{\[].*[}\]])", 1)
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(outer, F.lit(""))))


def indel(a: str, b: str) -> int:
    """Insertions and deletions that turn one title into the other; a million where one is empty.

    The longest common subsequence row by row, a whole row in one number: a zero bit for each step of it."""
    if not a or not b:
        return 1_000_000
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & full
    return len(b) - len(a) + 2 * row.bit_count()


@F.pandas_udf(IntegerType())
def _indel_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x or "", y or "") for x, y in zip(a, b)])


def edits(a: Column, b: Column) -> Column:
    """Insertions and deletions between two titles that are normalised already (a substitution counts two)."""
    return _indel_udf(a, b)


def title_edits(a: Column, b: Column) -> Column:
    """``edits`` of two titles as they are."""
    return edits(normalise_title(a), normalise_title(b))
