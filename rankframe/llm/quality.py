"""Quality classifier: Bradley-Terry pairwise ranking.

Preference pairs are drawn from a bounded labelled sample (a document of label 1 is preferred to one of
label 0).  The worth of a document is linear in its features, and the chance that one beats the other is
the logistic function of the difference of worths, so the fit is logistic loss on feature differences
(Newton steps with a small ridge).  A quantile of the training worths becomes the threshold: the one that
errs least when each label weighs the same.  Scores put that threshold at ``ACCEPT``.

Inputs of a score are features of the text alone.  Defined results: null and empty texts have a score
(all features zero but one); repeated rows get the same score; without both labels every document scores
0.5; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import SAMPLE_PER_LABEL, labelled_features
from .shared import held_out, map_arrow, text_or_empty
from .stats import FEATURES, features

ACCEPT = 0.3
PAIRS = 60_000
RIDGE = 1e-3
SEED = 7
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass(frozen=True)
class RankModel:
    """worth = weights · (x - centre) / spread; ``threshold`` is the worth that gets score ``ACCEPT``."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    quantile: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(self.worth(x) - self.threshold + shift, -700, 700)))


def flat_model() -> RankModel:
    n = len(FEATURES)
    return RankModel(np.zeros(n), np.ones(n), np.zeros(n), float(np.log(ACCEPT / (1 - ACCEPT))), 0.0)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = SEED) -> RankModel:
    """Learn worths from preference pairs (a label-1 row over a label-0 row)."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return flat_model()
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    scaled = lambda a: np.clip((a - centre) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = scaled(good), scaled(bad)
    difference = better[rng.integers(0, len(better), pairs)] - worse[rng.integers(0, len(worse), pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        chance = 1 / (1 + np.exp(np.clip(difference @ w, -500, 500)))
        gradient = ridge * w - difference.T @ chance / pairs
        curvature = (difference * (chance * (1 - chance))[:, None]).T @ difference / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    worth = scaled(x) @ w
    # Candidate thresholds are quantiles of the worths; the best one leaves least balanced error.
    quantiles = np.linspace(0, 1, 1001)
    cuts = np.quantile(worth, quantiles)
    errors = np.array([np.mean(worth[y == 1] < c) + np.mean(worth[y == 0] >= c) for c in cuts])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    at = best[len(best) // 2]
    below, above = worth[worth < cuts[at]], worth[worth >= cuts[at]]
    threshold = (below.max() + above.min()) / 2 if len(below) and len(above) else cuts[at]
    return RankModel(centre, spread, w, float(threshold), float(quantiles[at]))


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> RankModel:
    return fit(*labelled_features(docs, labels, per_label))


def score_documents(docs: DataFrame, model: RankModel) -> DataFrame:
    """doc_id, score of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_buffer().to_pybytes()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column(0), pa.array(model.score(x))], schema=_OUT)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), scan, "doc_id long, score double")


def accepted(docs: DataFrame, model: RankModel, accept: float = ACCEPT) -> DataFrame:
    """The rows that score ``accept`` or more, with all their columns; one pass, no join.  A null text scores as empty."""
    schema = docs.schema
    place = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            x = np.array([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= accept))

    return map_arrow(docs, keep, schema)


def op4_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
