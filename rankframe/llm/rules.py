"""Quality rules: counted statistics, two fixed limits, and gradient-boosted trees over the statistics.

Trees are grown on the driver from a bounded labelled sample: second-order logistic boosting over
binned features, with monotonic constraints on those features of which more can only be worse (a split
that would raise the score with such a feature is not taken, and children keep to the bounds that
earlier splits set).  All trees are flattened into node arrays, so scoring a batch is a few numpy steps
per tree level.

Defined results: null and empty texts have no words, fail the base limits and are not kept; repeated
rows are judged each; an empty table gives no rows; without both labels the trees keep every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import SAMPLE_PER_LABEL, labelled_features
from .shared import map_arrow, text_or_empty
from .stats import DECREASING, FEATURES, base_counts, features

TREES = 40
DEPTH = 3
RATE = 0.2
BINS = 32
LAMBDA = 1.0
KEEP = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Forest:
    """Node arrays of all trees: leaves have feature -1 and point to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while (self.feature[at] >= 0).any():
            feature = self.feature[at]
            goes_left = x[rows, np.maximum(feature, 0)] <= self.threshold[at]
            at = np.where(feature < 0, at, np.where(goes_left, self.left[at], self.right[at]))
        return self.start + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -700, 700)))


def _split(binned, cuts, g, h, rows, signs, low, high):
    """Best (gain, feature, bin, value left, value right) of a node, or None."""
    best = None
    weight = lambda gs, hs: np.clip(-gs / (hs + LAMBDA), low, high)
    gain_of = lambda gs, hs, w: -(gs * w + 0.5 * (hs + LAMBDA) * w * w)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    own = gain_of(total_g, total_h, weight(total_g, total_h))
    for f, sign in enumerate(signs):
        if not len(cuts[f]):
            continue
        n = len(cuts[f]) + 1
        left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], n))[:-1]
        left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], n))[:-1]
        wl, wr = weight(left_g, left_h), weight(total_g - left_g, total_h - left_h)
        gain = gain_of(left_g, left_h, wl) + gain_of(total_g - left_g, total_h - left_h, wr) - own
        gain[(left_h < 1e-3) | (total_h - left_h < 1e-3) | ((wr - wl) * sign < 0)] = -np.inf
        at = int(np.argmax(gain))
        if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
            best = (gain[at], f, at, wl[at], wr[at])
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, names=FEATURES, decreasing=DECREASING) -> Forest:
    if len(set(y.tolist())) < 2:
        return Forest(np.zeros(1, np.int64), np.full(1, -1), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), 20.0)
    signs = [-1 if n in decreasing else 0 for n in names]
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    margin = np.zeros(len(y))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def grow(rows, level, low, high, g, h) -> int:
        me = len(feature)
        for array, v in ((feature, -1), (threshold, 0.0), (left, me), (right, me)):
            array.append(v)
        value.append(RATE * float(np.clip(-g[rows].sum() / (h[rows].sum() + LAMBDA), low, high)))
        found = _split(binned, cuts, g, h, rows, signs, low, high) if level < depth else None
        if found:
            _, f, at, wl, wr = found
            middle = (wl + wr) / 2
            feature[me], threshold[me] = f, float(cuts[f][at])
            inside = binned[rows, f] <= at
            bounds = ((middle, high), (low, middle)) if signs[f] < 0 else ((low, high), (low, high))
            left[me] = grow(rows[inside], level + 1, *bounds[0], g, h)
            right[me] = grow(rows[~inside], level + 1, *bounds[1], g, h)
            value[me] = 0.0
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), 0, -8.0, 8.0, (p - y) * share, np.maximum(p * (1 - p), 1e-6) * share))
        arrays = [np.array(a) for a in (feature, threshold, left, right, value)]
        margin = Forest(np.array(roots), *arrays, 0.0).margin(x)
    return Forest(np.array(roots), *(np.array(a) for a in (feature, threshold, left, right, value)), 0.0)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Forest:
    return fit(*labelled_features(docs, labels, per_label))


_OUT = pa.schema([
    *((c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64()),
])
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, forest: Forest, keep: float = KEEP) -> DataFrame:
    """Counts, base verdict and the trees' verdict for every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = [], []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes()
                words, chars, symbols, dups, repeats = base_counts(data)
                counts.append((len(words), chars, symbols, dups, repeats))
                x.append(features(data, words, repeats))
            n = np.array(counts, np.int64).reshape(-1, 5)
            score = forest.score(np.array(x).reshape(-1, len(FEATURES)))
            failed = (n[:, 0] < MIN_WORDS) | (100 * n[:, 4] > MAX_REPEAT_PERCENT * n[:, 0])
            columns = [batch.column(0), *(pa.array(n[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= keep)), pa.array(score)]
            yield pa.record_batch(columns, schema=_OUT)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), scan, SCHEMA)


def op6_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, train(docs, labels))
