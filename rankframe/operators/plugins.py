"""What a user of the library may replace: retrievers, encoders, and the lane that answers prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_COLUMNS = ("qid", "did", "score", "rank")


class SearchBackend(Protocol):
    """Finds documents for query texts.  ``retryable`` says whether a short list may be asked for again."""

    retryable: bool

    def start(self) -> None: ...
    def prepare(self, queries: DataFrame) -> DataFrame: ...
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...
    def stop(self) -> None: ...


class TableSearch:
    """A backend from one function of (queries, corpus, k) that gives qid, did, score, rank."""

    def __init__(self, corpus: DataFrame, rank: Callable[[DataFrame, DataFrame, int], DataFrame], retryable: bool = False):
        self.corpus, self.rank, self.retryable, self.running = corpus, rank, retryable, False

    def start(self) -> None:
        self.running = True

    def prepare(self, queries: DataFrame) -> DataFrame:
        """Each text once: queries of the same text share a search."""
        return queries.groupBy("text").agg(F.min("qid").alias("qid"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if not self.running:
            raise RuntimeError("the backend is not started")
        return self.rank(queries, self.corpus, k).select(*RUN_COLUMNS)

    def stop(self) -> None:
        self.running = False


def searched(backend: SearchBackend, queries: DataFrame, k: int) -> DataFrame:
    """qid, did, score, rank of every query (qid, text), through a backend that is started and stopped here."""
    backend.start()
    try:
        asked = backend.prepare(queries)
        found = backend.search(asked, k)
    finally:
        backend.stop()
    texts = asked.select(F.col("qid"), F.col("text").alias("asked_text"))
    names = queries.select(F.col("qid").alias("asked_by"), "text").join(texts, F.col("text").eqNullSafe(F.col("asked_text"))).select("asked_by", "qid")
    return found.join(names, "qid").select(F.col("asked_by").alias("qid"), "did", "score", "rank")


def run_arms(arms: dict[str, Callable[[], DataFrame]], chosen: list[str]) -> DataFrame:
    """The runs of the arms chosen by name, with the arm in column ``retriever``."""
    unknown = sorted(set(chosen) - set(arms))
    if unknown or not chosen:
        raise ValueError(f"unknown arms {unknown}, known are {sorted(arms)}")
    return reduce(DataFrame.unionByName, (arms[name]().select(F.lit(name).alias("retriever"), *RUN_COLUMNS) for name in chosen))


class Encoder(Protocol):
    """Texts to vectors; queries and documents may be encoded in different ways."""

    def encode_queries(self, texts: list[str]) -> np.ndarray: ...
    def encode_docs(self, texts: list[str]) -> np.ndarray: ...


class CharacterEncoder:
    """A stand-in that needs no model: how often each of ``dim`` classes of code points occurs."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def encode_docs(self, texts: list[str]) -> np.ndarray:
        return np.stack([np.bincount([ord(c) % self.dim for c in t], minlength=self.dim) for t in texts]).astype(np.float32) if texts else np.zeros((0, self.dim), np.float32)

    encode_queries = encode_docs


ENCODERS: dict[str, Callable[[], Encoder]] = {"characters": CharacterEncoder}


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder a worker process, made at first use."""
    return ENCODERS[name]()


def encoded(rows: DataFrame, name: str, kind: str = "docs") -> DataFrame:
    """(id, text) → (id, vec) in Arrow batches; null texts count as empty."""
    if name not in ENCODERS or kind not in ("docs", "queries"):
        raise ValueError(f"no encoder {name} of {kind}")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = getattr(encoder(name), f"encode_{kind}")
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "vec": list(encode(batch["text"].tolist()))})

    return rows.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(scan, "id long, vec array<float>")


def replies(asked: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(id, prompt) → (id, reply, lane): a stored reply (id, reply) of the live lane, or else the stub's.

    The stub's reply is a function of the prompt, so runs without a model can be repeated."""
    stub = F.concat(F.lit("stub-"), F.substring(F.sha1(F.coalesce("prompt", F.lit(""))), 1, 8))
    if stored is None:
        return asked.select("id", stub.alias("reply"), F.lit("stub").alias("lane"))
    live = asked.join(stored.groupBy("id").agg(F.max("reply").alias("had")), "id", "left")
    return live.select("id", F.coalesce("had", stub).alias("reply"), F.when(F.col("had").isNull(), "stub").otherwise("live").alias("lane"))
