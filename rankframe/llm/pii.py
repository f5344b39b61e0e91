"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, digits, schemes and identifier cues) in one pass;
deterministic local parsers then expand from each anchor to the exact boundaries and validate them.
A parser only ever looks at the run of characters around its anchor, so the cost follows the number
of anchors, not the number of patterns.

Defined results: a null or empty text has no spans.  Spans are in code points, end exclusive.  Every
row gives one row, repeated rows included; other columns are not read.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, text_or_empty

#: The base kinds, in the order of the contract, then those that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")
_RANK = {kind: i for i, kind in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_REGION = re.compile(r"[0-9 ().+-]*")
#: A match starts where a run of digits does: from inside the run it would end as the run's own match does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+.-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_HEX_RUN = re.compile(r"[0-9A-Fa-f:]*")
_SPELT = re.compile(r"([A-Za-z0-9._%+-]++) ?[\[(]?(?<=[ \[(])(?:at|AT|@)[\])]? ?([A-Za-z0-9-]+(?: ?[\[( ]? ?(?:dot|DOT)[\])]? ?[A-Za-z0-9-]+)+)")
#: Endings that a wholly spelt address ("a at b dot com") must have; bracketed forms need none.
_ENDINGS = frozenset("com org net edu gov info biz io co eu de fr es it uk us ca ch at nl".split())
_STREET = re.compile(
    r"[0-9]{1,5}[A-Za-z]? (?:[A-Z][A-Za-z'.-]+ ){1,4}"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq)\b\.?"
)
_FRACTION = re.compile(r"[0-9]\.")
_GROUP = re.compile(r"[0-9]+")
#: A labelled number goes on, whatever its length, while words hold digits or are letter groups before digits.
_LABELLED = re.compile(r"(?:[ :#=._-]|(?i:no|number|nr|num|id|code|is)(?![A-Za-z])){0,6}([A-Z]{0,2}[0-9][0-9A-Z-]*(?: (?:[A-Z]{1,4} (?=[0-9]))?(?=[A-Z-]*[0-9])[0-9A-Z-]+)*)")
_LABELLED_IBAN = re.compile(r"(?:[ :#=._-]|(?i:no|number|nr|code|is)(?![A-Za-z])){0,6}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])")
_CUES = ("ssn", "iban", "passport", "account", "acct", "tax id", "social security", "licence", "license no", "national id")
#: Cues of the credentials of an account, and what may stand between them and the value.
_SECRETS = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "access_key", "private key", "private_key", "credential")
_CREDENTIAL = re.compile(r"[\"']?[ ]{0,3}(?:=>|:=|[:=])[ ]{0,3}[\"']?([A-Za-z0-9+/_.~=-]{12,})")
#: The same at the start of a word, so that a long word is read once.
_SPELT_WORD = re.compile(r"(?<![A-Za-z0-9._%+-])" + _SPELT.pattern)
#: What spelt addresses are made of, in a row.
_SPELT_CHARS = _LOCAL | frozenset("@[]() ")
_SPELT_RUN = re.compile(r"[A-Za-z0-9._%+@\[\]() -]*")
_SPELT_ANCHORS = ("[at]", "(at)", " dot ", "[dot]", "(dot)", " DOT ", "[AT]", "(AT)")


def _forms(cue: str) -> set[str]:
    """A cue with each of its words in lower case, in capitals, or with a capital first."""
    parts = re.split(r"([ _])", cue)
    return {"".join(x) for x in product(*({p, p.upper(), p.capitalize()} for p in parts))}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word(":", ("colons", 1))
    for word in _SPELT_ANCHORS:
        found.add_word(word, ("spelt", len(word)))
    for scheme in ("mailto:", "://"):
        found.add_word(scheme, ("scheme", len(scheme)))
    for kind, cues in (("cue", _CUES), ("secret", _SECRETS)):
        for cue in cues:
            for form in _forms(cue):
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if i % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expand an at-sign: local part to the left, not beyond ``floor``, and a dotted domain to the right."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Base kinds made of digits in one run of the characters they are made of."""
    for m in _IP.finditer(text, start, end):
        if all(map(_octet, m.group().split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text, start, end):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text, start, end):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield "phone", m.start(), m.end()


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    if not 15 <= len(value) <= 34:
        return False
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _more_numbers(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """What the method adds around a run of digits: accounts, national telephone numbers, street addresses."""
    for m in _SSN.finditer(text, start, end):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "account", m.start(), m.end()
    for m in _NATIONAL.finditer(text, start, end):
        yield "phone", m.start(), m.end()
    if start >= 2 and text[start - 2 : start].isalpha() and text[start - 2 : start].isupper() and not text[start - 3 : start - 2].isalnum():
        m = _IBAN.match(text, start - 2)
        while m:
            if _iban(m.group()):
                yield "account", m.start(), m.end()
                break
            cut = m.group().rfind(" ")
            m = _IBAN.match(text, start - 2, start - 2 + cut) if cut > 0 else None
    for group in _GROUP.finditer(text, start, end):
        m = _STREET.match(text, group.start())
        # Not inside a word, and not the fraction of a number.
        if m and not text[max(0, group.start() - 1) : group.start()].isalnum() and not _FRACTION.match(text, max(0, group.start() - 2), group.start()):
            yield "address", m.start(), m.end()


def _spelt(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Spelt e-mail addresses of one run of the characters they are made of."""
    m = _SPELT.match(text, start, end) or _SPELT_WORD.search(text, start, end)
    while m:
        if "[" in m.group() or "(" in m.group() or m.group().split()[-1].lower() in _ENDINGS:
            yield "email", m.start(), m.end()
        m = _SPELT.match(text, m.end(), end) or _SPELT_WORD.search(text, m.end(), end)


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans that the method adds to them; both by start, then kind."""
    if not text:
        return [], []
    base: list[tuple[str, int, int]] = []
    more: list[tuple[str, int, int]] = []
    email_end = region_end = colon_end = spelt_end = secret_end = label_end = 0
    for last, (kind, length) in _automaton().iter(text):
        first = last - length + 1
        if kind == "digit":
            if first < region_end:
                continue
            region_end = _REGION.match(text, first).end()
            start = first - 1 if first and text[first - 1] == "+" else first
            base.extend(_numbers(text, start, region_end))
            if first and text[first - 1] == "(":
                start = first - 1
            more.extend(_more_numbers(text, first, region_end) if start == first else _more_numbers(text, start, region_end))
        elif kind == "at":
            span = _email_at(text, first, email_end)
            if span:
                base.append(("email", *span))
                email_end = span[1]
        elif kind == "spelt":
            if first < spelt_end:
                continue
            start = first
            while start > spelt_end and text[start - 1] in _SPELT_CHARS:
                start -= 1
            spelt_end = _SPELT_RUN.match(text, first).end()
            more.extend(_spelt(text, start, spelt_end))
        elif kind == "colons":
            if first < colon_end:
                continue
            start = first
            while start > colon_end and text[start - 1] in "0123456789abcdefABCDEF:":
                start -= 1
            colon_end = _HEX_RUN.match(text, first).end()
            if 4 < colon_end - start <= 39:
                try:
                    ipaddress.IPv6Address(text[start:colon_end])
                except ValueError:
                    pass
                else:
                    more.append(("ip", start, colon_end))
        elif kind == "secret":
            m = _CREDENTIAL.match(text, last + 1) if last >= secret_end else None
            if m:
                secret_end = m.end()
                value = m[1].rstrip(".")
                if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                    more.append(("account", m.start(1), m.start(1) + len(value)))
        elif kind == "cue":
            if last < label_end:
                continue
            m = _LABELLED_IBAN.match(text, last + 1) if text[first : last + 1].lower() == "iban" else None
            if m and _iban(m[1].upper()):
                more.append(("account", *m.span(1)))
                label_end = m.end(1)
                continue
            m = _LABELLED.match(text, last + 1)
            if m and sum(c.isdigit() for c in m[1]) >= 6:
                more.append(("account", m.start(1), m.start(1) + len(m[1].rstrip("-"))))
            label_end = m.end() if m else label_end
        elif text.startswith("://", first):
            stop = re.compile(r"[^\s/@]*").match(text, last + 1).end()
            if stop < len(text) and text[stop] == "@" and stop > last + 1:
                host = re.compile(r"[A-Za-z0-9.-]+").match(text, stop + 1)
                if host:
                    more.append(("account", last + 1, host.end()))
    order = lambda s: (s[1], _RANK[s[0]], s[2])
    base.sort(key=order)
    kept: list[tuple[str, int, int]] = []
    starts, ends = _union(base)
    for span in sorted(set(more), key=order):
        before = bisect_left(starts, span[2]) - 1
        if not (before >= 0 and span[1] < ends[before]) and not (kept and span[1] < kept[-1][2]):
            kept.append(span)
    return base, kept


def _union(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that spans (by start) cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_spans string, spans string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in (*BASE_KINDS, "spans")), ("base_spans", pa.string()), ("spans", pa.string())])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds and of all spans, base spans and all spans as ``kind:start:end``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, more = find(text.as_py())
                counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
                every = sorted(base + more, key=lambda s: (s[1], _RANK[s[0]], s[2])) if more else base
                rows.append((doc_id, *counts, len(every), joined(base), joined(every)))
            columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), scan, SCHEMA)


def op1_pii(docs: DataFrame) -> DataFrame:
    """The contract's columns: digest of the base spans, and all spans.  ``n_spans`` counts the spans of every kind."""
    found = find_pii(docs)
    return found.select(
        "doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans"
    )


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
