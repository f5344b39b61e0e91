"""Which texts name which concepts: many thousand names against all texts in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept

#: Ids of texts in one group of bits, about.
GROUP_IDS = 2048
#: Bytes of names that one pass over the texts takes: what is sent to each executor.
MOST_BYTES = 32 << 20


def named_concepts(texts: DataFrame, names: DataFrame, fields: tuple[str, ...] = ("text",), most_bytes: int = MOST_BYTES) -> DataFrame:
    """``texts(did, *fields)`` and ``names(cid, name)`` → (did, cid), each pair once, where a name of the concept stands in
    the fields joined by blanks; case is ignored, names are trimmed, and a name may be part of a word.

    A task searches for all names at once with an automaton.  Names are counted in bytes first: beyond ``most_bytes`` they
    are dealt by hash to as many sets as that takes, and each set is one pass over the texts.  Null fields are empty;
    empty and null names match nothing."""
    known = _known(names)
    return _hits(texts, known, fields, most_bytes).join(known, "name").select("did", "cid").distinct()


def texts_by_concept(texts: DataFrame, names: DataFrame, fields: tuple[str, ...] = ("text",), most_bytes: int = MOST_BYTES) -> DataFrame:
    """(cid, n): the number of distinct ids of texts that name a concept, where any does; ``named_concepts``, counted.

    The pairs themselves are as many as texts times concepts where a name is in most texts, so they are not made: the ids are
    dealt to groups, a name's ids in a group are bits, and each distinct set of names takes the union of its names' bits."""
    concepts = _known(names).groupBy("cid").agg(F.array_sort(F.collect_set("name")).alias("names"))
    concepts = kept(concepts, "concepts")
    hits = _hits(texts, _known(names), fields, most_bytes).where("did IS NOT NULL")
    groups = max(1, -(-texts.count() // GROUP_IDS))

    def pack(group: pa.Table) -> pa.Table:
        names = group.column("name").combine_chunks().dictionary_encode()
        _, at = np.unique(group.column("did").to_pylist(), return_inverse=True)
        bits = np.zeros((len(names.dictionary), at.max() + 1), bool)
        bits[names.indices.to_numpy(), at] = True
        return pa.table({"words": pa.array([names.dictionary.to_pylist()], pa.list_(pa.string())), "bits": pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, bits, sets in zip(*(batch.column(c) for c in range(3))):
                bits = np.frombuffer(bits.as_py(), np.uint8).reshape(len(words), -1)
                bits = np.concatenate([bits, np.zeros((1, bits.shape[1]), np.uint8)])  # a name that no text has
                flat, starts = sets.values.flatten(), np.concatenate([[0], np.cumsum(sets.values.value_lengths().to_numpy())[:-1]])
                at = pc.fill_null(pc.index_in(flat, value_set=words.values), len(words)).to_numpy()
                n = np.bitwise_count(np.bitwise_or.reduceat(bits[at], starts, axis=0)).sum(axis=1, dtype=np.int64)
                yield pa.record_batch({"names": sets.values.filter(pa.array(n > 0)), "n": pa.array(n[n > 0])})

    packed = hits.groupBy(F.pmod(F.xxhash64("did"), F.lit(groups)).alias("group")).applyInArrow(pack, "words array<string>, bits binary")
    sets = concepts.select("names").distinct().groupBy(F.spark_partition_id().alias("part"), F.pmod(F.xxhash64("names"), F.lit(64)).alias("deal")).agg(F.collect_list("names").alias("sets"))
    counts = packed.join(F.broadcast(sets.select("sets"))).select("words", "bits", "sets").mapInArrow(unite, "names array<string>, n long")
    counts = counts.groupBy("names").agg(F.sum("n").alias("n"))
    return concepts.join(counts, "names").select("cid", "n")


def _known(names: DataFrame) -> DataFrame:
    return names.select("cid", F.lower(F.trim("name")).alias("name")).where("name <> ''")


def _hits(texts: DataFrame, known: DataFrame, fields: tuple[str, ...], most_bytes: int) -> DataFrame:
    """(did, name): the names in each text."""
    spark = texts.sparkSession
    distinct = known.select("name").distinct()
    size = distinct.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    sets = max(1, -(-size // most_bytes))
    body = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields)))
    rows = texts.select("did", body.alias("body"))
    kind = dict(texts.dtypes)["did"]

    def search(part: int) -> DataFrame:
        words = [r["name"] for r in distinct.where(F.pmod(F.xxhash64("name"), F.lit(sets)) == part).collect()]
        sent = spark.sparkContext.broadcast(words)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in sent.value:
                automaton.add_word(word, word)
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(1)):
                    hits = {word for _, word in automaton.iter(text.as_py())}
                    at += [i] * len(hits)
                    found += hits
                yield pa.record_batch({"did": batch.column(0).take(pa.array(at, pa.int64())), "name": pa.array(found, pa.string())})

        return rows.mapInArrow(scan, f"did {kind}, name string")

    return reduce(DataFrame.unionByName, map(search, range(sets)))
