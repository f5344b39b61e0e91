"""One vector from the token vectors that an encoder gives: last token, first token, means, latent attention.

Token matrices are ragged (a row has as many tokens as its text) and are pooled in Arrow batches: the tokens of a batch
are one matrix, and a row is a range of it, so no padding is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("last", "cls", "mean", "mean_tokennorm", "latent")
_erf = np.vectorize(math.erf, otypes=[np.float64])


def _standardised(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    spread = np.sqrt(x.var(axis=-1, keepdims=True) + eps)
    return (x - x.mean(axis=-1, keepdims=True)) / spread * weight + bias


@dataclass(frozen=True)
class LatentHead:
    """Every token attends to trained latent vectors and passes a gated feed-forward block; both are residual.

    For d parts a token, n latents and h heads of i parts in all: ``latents`` (n, d), ``to_q`` (d, i), ``to_kv`` (d, 2 i),
    ``to_out`` (i, d), the three (weight, bias) pairs of the normalisations of tokens, latents and feed-forward input,
    ``up`` (d, 2 f) with ``up_bias`` and ``down`` (f, d) with ``down_bias``."""

    heads: int
    latents: np.ndarray
    to_q: np.ndarray
    to_kv: np.ndarray
    to_out: np.ndarray
    norms: tuple[tuple[np.ndarray, np.ndarray], ...]
    up: np.ndarray
    up_bias: np.ndarray
    down: np.ndarray
    down_bias: np.ndarray

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        split = lambda x: x.reshape(len(x), self.heads, -1).transpose(1, 0, 2)
        keys, values = np.split(_standardised(self.latents, *self.norms[1]) @ self.to_kv, 2, axis=1)
        asked = split(_standardised(tokens, *self.norms[0]) @ self.to_q)
        weights = asked @ split(keys).transpose(0, 2, 1) / math.sqrt(asked.shape[-1])
        weights = np.exp(weights - weights.max(axis=-1, keepdims=True))
        met = (weights / weights.sum(axis=-1, keepdims=True)) @ split(values)
        x = met.transpose(1, 0, 2).reshape(len(tokens), -1) @ self.to_out + tokens
        value, gate = np.split(_standardised(x, *self.norms[2]) @ self.up + self.up_bias, 2, axis=1)
        return (value * gate * 0.5 * (1 + _erf(gate / math.sqrt(2)))) @ self.down + self.down_bias + x


def _sums(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over ranges of rows; an empty range is zero."""
    out = np.zeros((len(sizes), *x.shape[1:]))
    if len(x):
        some = sizes > 0
        out[some] = np.add.reduceat(x, starts[some], axis=0)
    return out


def pool(tokens: DataFrame, how: str, head: LatentHead | None = None) -> DataFrame:
    """``tokens(id, hidden, attention, mask)`` → (id, vec).

    ``hidden`` lists token vectors of one width, ``attention`` says of each token whether it is real (padding is at the
    end), ``mask`` whether it is pooled (instructions are not).  ``last`` takes the last real token, ``cls`` the first of all;
    ``mean`` averages the pooled tokens, ``mean_tokennorm`` after making each of unit length, ``latent`` after ``head``.

    A row of which no token is pooled has a vector of zeros; where the token asked for does not exist, or ``hidden`` is
    null or empty, the vector is null.  Lists of different lengths in a row, and token vectors of different widths, are errors."""
    if how not in KINDS or (how == "latent") != (head is not None):
        raise ValueError(f"unknown pooling {how!r}, or a head where none belongs")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hidden, attention, mask = (c.fill_null([]) if isinstance(c, pa.ListArray) and c.null_count else c for c in batch.columns[1:])
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            lengths = [c.value_lengths().to_numpy(zero_copy_only=False) for c in (hidden, attention, mask)]
            sizes = lengths[0]
            if any((known & (n != sizes)).any() for n in lengths[1:]):
                raise ValueError("a row has other numbers of tokens, attention marks and mask marks")
            each = hidden.flatten()
            widths = np.unique(each.value_lengths().to_numpy(zero_copy_only=False))
            if len(widths) > 1:
                raise ValueError("token vectors differ in width")
            x = each.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(each), int(widths[0]) if len(widths) else 0)
            real, pooled = (np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.int64)[np.repeat(known, n)] for c, n in ((attention, lengths[1]), (mask, lengths[2])))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
            if how in ("last", "cls"):
                place = _sums(real, starts, sizes).astype(np.int64) - 1 if how == "last" else np.zeros(len(sizes), np.int64)
                there = known & (place >= 0) & (place < sizes)
                vectors = [x[s + p].tolist() if t else None for s, p, t in zip(starts, place, there)]
            else:
                if how == "mean_tokennorm":
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                elif how == "latent" and len(x):
                    x = head(x)
                means = _sums(x * pooled[:, None], starts, sizes) / np.maximum(_sums(pooled, starts, sizes), 1)[:, None]
                vectors = [v.tolist() if t else None for v, t in zip(means, known & (sizes > 0))]
            yield pa.record_batch({"id": batch.column(0), "vec": pa.array(vectors, pa.list_(pa.float64()))})

    rows = tokens.select("id", F.col("hidden").cast("array<array<double>>"), F.col("attention").cast("array<int>"), F.col("mask").cast("array<int>"))
    return rows.mapInArrow(scan, f"id {dict(tokens.dtypes)['id']}, vec array<double>")
