"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative, by weights learned from
labelled pages: pages that mark their article themselves (``article``, ``main`` or ``itemprop=articleBody``)
tell, for each kind of place a word stands in and each tag, how often it lies inside.  A linear scan then
finds the contiguous region of the greatest sum, in every page, marked or not.  Inside the region, the
blocks of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are left out; the others are joined in page order.

Defined results: null or empty html has an empty text and 0 characters; a tag or comment that is not
closed runs to the end of the page; unclosed elements end with the page; repeated rows give a row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, maybe_broadcast, text_or_empty

#: Pages that the weights are learned from at most, those of the smallest id hash.
SAMPLE_PAGES = 2000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(/?)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe")}
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea iframe svg canvas object menu dialog title".split())
_SELF_CLOSING = {"p": frozenset("p h1 h2 h3 h4 h5 h6 div ul ol table section article header footer nav aside form blockquote pre hr dl figure".split()), "li": frozenset(["li"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
#: Class, id and role tokens that name what is not the article, wherever they stand.
_BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsored sponsor promo cookie cookies consent gdpr popup modal overlay"
    " sidebar navbar navigation menubar breadcrumb breadcrumbs pagination pager masthead comment comments disqus newsletter complementary contentinfo".split()
)
#: Tokens that name it outside a marked article only: inside one they may well be about its matter.
_AROUND = frozenset(
    "promotion banner notice notices alert side aside widget menu nav toolbar header topbar footer foot bottom copyright legal reply replies discussion"
    " responses respond share sharing social follow related recommended recommendations more trending subscribe subscription signup login search form skip".split()
)
_ANY = _BOILER | _AROUND
#: Words that name it as any part of a compound: reader comments and adverts everywhere, the others outside a marked article.
_COMMENTS_ADS = frozenset("comment comments disqus ad ads adv advert adverts advertisement advertising sponsored sponsor".split())
_PARTS = _COMMENTS_ADS | frozenset(
    "header footer nav navbar navigation menu sidebar related recommended recommendations share sharing social breadcrumb breadcrumbs pagination"
    " newsletter cookie cookies consent gdpr promo popup modal masthead replies".split()
)
#: A header or footer with one of these is the article's own; a compound with one of those says that something is absent or near.
_OWN_EDGE, _ONLY_SAID = frozenset("article entry post story content title".split()), frozenset("has with no not without is free".split())
_ARTICLE_WORDS = frozenset("article articlebody post-content entry-content main".split())

WORD, TAG, BREAK = 0, 1, 2
#: Without evidence; and what is left out anyway, which costs little and inside a marked article nothing.
_UNKNOWN_WORD, _UNKNOWN_TAG, _LEFT_OUT = 1.0, -1.0, -0.5


def _marks(attributes: str) -> tuple[set[str], bool]:
    """Lower-case tokens of class, id, role and itemprop; whether the element is hidden."""
    names: set[str] = set()
    hidden = False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden":
                hidden = True
            elif key == "aria-hidden":
                hidden |= value == "true"
            else:
                names.update(value.split())
    return names, hidden


def _named_away(names: set[str], article: bool) -> bool:
    """Whether a whole token names what is not the article, or a compound does: by one word of those that name it in any
    compound, or by all its words together."""
    for name in names:
        if name in _BOILER or (name in _AROUND and not article):
            return True
        words = re.split(r"[-_]+", name)
        if len(words) < 2 or any(w in _ONLY_SAID for w in words):
            continue
        parts = {w for w in words if w in (_COMMENTS_ADS if article else _PARTS)}
        if any(w in _OWN_EDGE for w in words):
            parts -= {"header", "footer"}
        if parts or (all(w in _ANY for w in words) and (not article or any(w in _BOILER for w in words))):
            return True
    return False


def events(html: str) -> Iterator[tuple[int, str, str, bool, bool]]:
    """(kind, place or tag, text, boilerplate, inside a marked article) in page order."""
    stack: list[tuple[str, bool, bool, str]] = []  # tag, boilerplate, article, place
    open_tags: Counter = Counter()
    boiler = article = False
    place = "body"
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        begin = m.start() if m else size
        if begin > at:
            text = unescape(html[at:begin])
            if text:
                yield WORD, place, text, boiler, article
        if not m:
            return
        at = m.end()
        name = m[2] or m[6]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[5]), m[3] or m[7] or ""
        if name in _VOID:
            yield (TAG if name in _INLINE else BREAK), name, " " if name == "br" else "", boiler, article
            continue
        if closing:
            # Only a tag that is open is looked for, and what is passed over is closed with it.
            if open_tags[name]:
                yield (TAG if name in _INLINE else BREAK), "/" + name, "", boiler, article
                closed = ""
                while closed != name:
                    closed = stack.pop()[0]
                    open_tags[closed] -= 1
        else:
            if stack and name in _SELF_CLOSING.get(stack[-1][0], ()):
                open_tags[stack.pop()[0]] -= 1
                _, boiler, article, place = stack[-1] if stack else _OUTSIDE
            names, hidden = _marks(attributes)
            own_article = article or name in ("article", "main") or bool(names & _ARTICLE_WORDS)
            in_header = name == "header" and not article
            starts_article = name in ("article", "main", "body", "html") or bool(names & {"articlebody"})
            drop = boiler or hidden or name in _DROPPED or in_header or (not starts_article and bool(names) and _named_away(names, article))
            if name not in _INLINE or drop != boiler:
                yield (TAG if name in _INLINE else BREAK), name, "", drop, own_article
            else:
                yield TAG, name, "", boiler, article
            if name in _RAW_END:
                end = _RAW_END[name].search(html, at)
                at = end.end()
                continue
            if not attributes.rstrip().endswith("/") or name not in ("svg", "path"):
                stack.append((name, drop, own_article, _place(name, place)))
                open_tags[name] += 1
        _, boiler, article, place = stack[-1] if stack else _OUTSIDE


#: Where the page's text stands outside all elements.
_OUTSIDE = ("", False, False, "body")


def _place(name: str, around: str) -> str:
    """The innermost block element and the link inside it, if any: what a word's weight depends on."""
    if name not in _INLINE:
        return name
    return around if name != "a" or around.endswith(">a") else around + ">a"


def _clean(text: str) -> str:
    return " ".join(text.split())


def evidence(html: str) -> Counter:
    """(key, inside) → count for one labelled page; empty if the page marks no article."""
    seen: Counter = Counter()
    for kind, key, text, boiler, inside in events(html):
        weight = len(text.split()) if kind == WORD else 1
        if weight and not boiler:
            seen[("w " if kind == WORD else "t ") + key, inside] += weight
    return seen if any(inside for _, inside in seen) else Counter()


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of lying inside, within limits and drawn to the tag class's own weight where they rest on few tokens; tags
    also pay a fixed price, so they score negative unless they hardly occur elsewhere, and are cut to at most -0.1."""
    weights = {}
    for key in {k for k, _ in counts}:
        inside, outside = counts.get((key, True), 0), counts.get((key, False), 0)
        odds, trust = math.log((inside + 1) / (outside + 1)), (inside + outside) / (inside + outside + _TRUSTED)
        drawn = trust * (odds if key[0] == "w" else odds - 1.0) + (1 - trust) * _by_class(key)
        weights[key] = max(-4.0, min(4.0, drawn)) if key[0] == "w" else max(-4.0, min(-0.1, drawn))
    return weights


#: Tokens of a key at which its own odds and its class's weight count alike.
_TRUSTED = 200
#: Elements that an article's matter stands in.
_MATTER = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot caption tr td th blockquote pre figure figcaption div section article main details summary address hr".split())


def _by_class(key: str) -> float:
    """The weight of a kind of place or tag without evidence of its own, by its tag's class."""
    tag = key[2:].lstrip("/").split(">")[0]
    if key[0] == "w":
        return _UNKNOWN_WORD * (0.25 if key.endswith(">a") else 1.0)
    return -0.25 if tag in _MATTER or tag in _INLINE else _UNKNOWN_TAG


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The best contiguous region's blocks, joined by two newlines.

    Inside a marked article no word scores less than its class's weight and no tag costs more, and a region that meets a
    marked article reaches to its edges: what the page itself marks is left out only by name."""
    if not html:
        return ""
    best, best_span = 0.0, None
    running, start, index = 0.0, 0, 0
    tokens: list[tuple[int, str, bool, bool]] = []
    for kind, key, text, boiler, inside in events(html):
        if boiler:
            score = 0.0 if inside else _LEFT_OUT * (len(text.split()) if kind == WORD else 1)
        else:
            key = ("w " if kind == WORD else "t ") + key
            score = weights.get(key, _by_class(key))
            score = max(score, _by_class(key)) if inside else score
            score *= len(text.split()) if kind == WORD else 1
        tokens.append((kind, text, boiler, inside))
        if running <= 0:
            running, start = 0.0, index
        running += score
        if running > best:
            best, best_span = running, (start, index + 1)
        index += 1
    if best_span is None:
        return ""
    blocks: list[str] = []
    parts: list[str] = []
    low, high = best_span
    if any(t[3] for t in tokens[low:high]):
        while low > 0 and tokens[low][3] and tokens[low - 1][3]:
            low -= 1
        while high < len(tokens) and tokens[high - 1][3] and tokens[high][3]:
            high += 1
    # A region that starts or ends inside a block takes the whole block.
    while low > 0 and tokens[low - 1][0] != BREAK:
        low -= 1
    while high < len(tokens) and tokens[high][0] != BREAK:
        high += 1
    for kind, text, boiler, _ in tokens[low:high]:
        if kind == BREAK:
            block = _clean("".join(parts))
            if block:
                blocks.append(block)
            parts = []
        elif not boiler:
            parts.append(text)
    block = _clean("".join(parts))
    if block:
        blocks.append(block)
    return "\n\n".join(blocks)


def learn_weights(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most ``sample_pages`` pages that mark their article."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]|articleBody"))
    ids = marked.select("page_id", F.xxhash64("page_id").alias("order")).distinct().orderBy("order", "page_id").limit(sample_pages).select("page_id")
    sample = marked.join(maybe_broadcast(ids, sample_pages), "page_id", "left_semi").select("html")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for html in batch.column(0):
                seen.update(evidence(html.as_py() or ""))
        if seen:
            keys = list(seen)
            yield pa.record_batch([pa.array([k for k, _ in keys]), pa.array([i for _, i in keys]), pa.array([seen[k] for k in keys], pa.int64())], ["key", "inside", "n"])

    rows = map_arrow(sample, gather, "key string, inside boolean, n long").groupBy("key", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r["key"], r["inside"]): r["n"] for r in rows})


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    weights = learn_weights(pages) if weights is None else weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_OUT)

    return map_arrow(pages, scan, "page_id long, url string, text string, n_chars long")
