"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most two bits are found by cutting the 64 bits into two halves: one half
then differs in at most one bit.  Each half is indexed under its 32 one-wildcard variants (one bit set
aside), an equality-join on (half, wildcard, remaining bits) gives candidates, and the full distance
verifies them.  Only distinct fingerprints take part, so exact copies cost one entry.

A bucket of more than ``HOT`` fingerprints is not paired out.  Its members are linked exactly by another
equality: two fingerprints differ in at most two bits if and only if they share a word of their
radius-one balls, so each member joins the smallest member of each of its 65 words; the work is linear.

``similar_documents`` links texts whose shingle sets have a true similarity of 0.8 or more.  Such sets
differ in up to 16 of 64 bits, which bit segments do not reach, so there the signature is cut by shingle
instead: see its text.

Defined results: null and empty texts, and texts of white space, have fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; repeated rows share a fingerprint; an empty table
gives no rows.  A null doc_id never becomes a component's id unless all of its ids are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components
from .shared import map_arrow, maybe_broadcast, text_or_empty, written

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Members from which a bucket is linked by balls instead of pairs.
HOT = 32
_OUT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("mark", pa.binary())])


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as an unsigned number."""
    import xxhash

    # Bytes lower-case A-Z only and split at exactly the six white-space code points.
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], np.uint64)
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        block = hashes[start : start + 4096]
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: Column | None = None) -> DataFrame:
    """doc_id, fp (signed 64 bits) and ``mark``, a binary column that is passed through."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], schema=_OUT)

    mark = F.lit(None).cast("binary") if carry is None else carry
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), mark.alias("mark"))
    return map_arrow(source, scan, "doc_id long, fp long, mark binary")


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def variants(points: DataFrame) -> DataFrame:
    """Each fingerprint under its 64 one-wildcard segment variants: which half and bit (part), and what is left."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    bits = points.select("fp", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("part"))
    half = F.when(F.col("part") < 32, F.col("low")).otherwise(F.col("high"))
    masked = half.bitwiseAND(F.expr("~shiftleft(1L, part % 32)"))
    return bits.select("fp", F.shiftleft(F.col("part").cast("long"), 32).bitwiseOR(masked).alias("variant"))


def near_links(points: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within the radius.

    Fingerprints are few bytes but 64 variants each, so they are dealt to as many tasks as a shuffle has."""
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = variants(points.repartition(tasks, "fp"))
    buckets = written(
        index.groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "simhash-buckets"
    )
    two = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(_near("a", "b"))
    more = buckets.where("n > 2").select("variant", "n")
    members = written(index.join(maybe_broadcast(more, more.count()), "variant"), "simhash-members")
    few = members.where(F.col("n") <= hot)
    left, right = few.select("variant", F.col("fp").alias("a")), few.select("variant", F.col("fp").alias("b"))
    paired = left.join(right, "variant").where("a < b").select("a", "b").where(_near("a", "b"))
    crowd = members.where(F.col("n") > hot).select("fp").distinct()
    balls = crowd.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("bit")).select(
        "fp", F.expr("CASE WHEN bit = 64 THEN fp ELSE fp ^ shiftleft(1L, bit) END").alias("word")
    )
    balls = written(balls, "simhash-balls")
    stars = balls.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    starred = balls.join(stars, "word").select("a", F.col("fp").alias("b")).where("a <> b")
    return two.unionByName(paired).unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT, carry: Column | None = None) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach), the carried ``mark`` and ``root``.

    ``root``, the component's smallest fingerprint, tells components apart; component_id need not."""
    marked = written(fingerprints(docs, shingle, carry), "simhash-fp")
    points = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-points")
    roots = connected_components(near_links(points.select("fp"), hot))
    named = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-named")
    least = written(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    classes = written(named.select("fp", "root").join(least, "root").select("fp", "component_id", "root"), "simhash-classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "mark", "root")


#: Mean shingles of a group (up to twice as many), groups that are indexed, hubs of a crowded bucket, and members in a
#: block of one that are compared at once.
GROUP_SHINGLES, GROUPS, HUBS, BLOCK = 2, 12, 4, 256
#: Slots in which shingles are counted, to tell rare from frequent ones.
SLOTS = 1 << 18
_SKETCH = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("digest", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("fp", pa.int64()), ("groups", pa.list_(pa.int64()))])


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle, no words none."""
    import xxhash

    words = (text or b"").lower().split()
    grams = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams] if words else [], np.uint64))


def group_signatures(hashes: np.ndarray, similarity: float) -> list[int]:
    """A hash for each of the first ``GROUPS`` groups that the set is dealt to by the leading bits of its hashes.

    The number of groups is a power of two that fits the size of the set; a set whose size lies near the next power has
    the groups of both, so that two sets of the wanted similarity always share a number of groups."""
    import xxhash

    n, found = len(hashes), []
    reach = similarity**-0.5
    for bits in sorted({max(0, int(np.floor(np.log2(n * f / GROUP_SHINGLES)))) for f in (1 / reach, reach)} if n else ()):
        step = 1 << (64 - bits)
        cuts = np.searchsorted(hashes, np.array([min(i * step, (1 << 64) - 1) for i in range(1, min(GROUPS, 1 << bits) + 1)], np.uint64))
        cuts[-1] = n if 1 << bits <= GROUPS else cuts[-1]
        start = 0
        for number, end in enumerate(cuts.tolist()):
            if end > start:
                value = xxhash.xxh64_intdigest(hashes[start:end].tobytes(), bits * GROUPS + number)
                found.append(value - (value >> 63 << 64))
            start = end
    return found


def sketches(docs: DataFrame, shingle: int, similarity: float, carry: Column | None) -> DataFrame:
    """doc_id, mark, digest of the text, node (digest of the shingle set), n (its size), fp and group signatures of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes()
                hashes = shingle_set(data, shingle)
                fp = fingerprint(data, shingle)
                rows.append((hashlib.sha256(hashes.tobytes()).digest()[:16], len(hashes), fp - (fp >> 63 << 64), group_signatures(hashes, similarity)))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), *(pa.array(c, f.type) for c, f in zip(columns, list(_SKETCH)[3:]))], schema=_SKETCH)

    mark = F.lit(None).cast("binary") if carry is None else carry
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), mark.alias("mark"), F.xxhash64(text_or_empty()).alias("digest"))
    return map_arrow(source, scan, "doc_id long, mark binary, digest long, node binary, n long, fp long, groups array<long>")


def _bucket_pairs(points: DataFrame, similarity: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of nodes that share a group signature and could reach the similarity by their sizes, and the
    members (bucket, c, node) of crowded buckets.

    A bucket of more than ``hot`` nodes is not paired out: each member meets the bucket's hubs, those of its nodes that
    stand in most crowded buckets, as the text that many others are copies of does.  ``_rest_links`` takes the rest."""
    index = points.select(F.struct("n", "node").alias("p"), F.explode("groups").alias("bucket"))
    fits = lambda x, y: F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"])
    buckets = index.groupBy("bucket").agg(F.count("*").alias("c"), F.min("p").alias("lo"), F.max("p").alias("hi")).where("c > 1")
    buckets = written(buckets, "similar-buckets")
    two = buckets.where("c = 2").select(F.col("lo").alias("x"), F.col("hi").alias("y"))
    more = buckets.where("c > 2").select("bucket", "c")
    members = written(index.join(maybe_broadcast(more, more.count()), "bucket"), "similar-members")
    few = members.where(F.col("c") <= hot)
    paired = few.select("bucket", F.col("p").alias("x")).join(few.select("bucket", F.col("p").alias("y")), "bucket").where("x.node < y.node").select("x", "y")
    crowd = members.where(F.col("c") > hot).select("bucket", "p")
    score = crowd.groupBy("p").agg(F.count("*").alias("score"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("score"), "p"))
    hubs = crowd.join(score, "p").withColumn("place", place).where(F.col("place") <= HUBS).select("bucket", F.col("p").alias("x"))
    hubs = written(hubs, "similar-hubs")
    starred = crowd.select("bucket", F.col("p").alias("y")).join(maybe_broadcast(hubs, hubs.count(), longs=6), "bucket").where("x.node <> y.node").select("x", "y")
    every = two.unionByName(paired).unionByName(starred).where(fits(F.col("x"), F.col("y")))
    pairs = every.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return pairs, members.where(F.col("c") > hot).select("bucket", "c", F.col("p.node").alias("node"))


def _fingerprint_pairs(points: DataFrame, hot: int) -> DataFrame:
    """Candidate pairs of nodes whose fingerprints are equal or near: by deletion variants."""
    first = written(points.groupBy("fp").agg(F.min("node").alias("node")), "similar-fp")
    same = points.select("fp", F.col("node").alias("b")).join(first.withColumnRenamed("node", "a"), "fp").where("a <> b").select("a", "b")
    links = near_links(first.select("fp"), hot).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    named = links.join(first.select(F.col("fp").alias("fa"), F.col("node").alias("a")), "fa").join(first.select(F.col("fp").alias("fb"), F.col("node").alias("b")), "fb")
    return same.unionByName(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def shingle_sets(docs: DataFrame, points: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, hashes (sorted 64-bit numbers) of the listed nodes: one text is read again for each."""
    wanted = points.join(nodes.distinct(), "node").select("node", F.col("first.doc_id").alias("of_id"), F.col("first.digest").alias("of_digest"))
    wanted = written(wanted, "similar-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    side = maybe_broadcast(wanted, wanted.count(), longs=6)
    met = texts.join(side, texts["doc_id"].eqNullSafe(F.col("of_id")) & (F.xxhash64(texts["text"]) == F.col("of_digest"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_buffer().to_pybytes(), shingle).tobytes() for t in batch.column(1)]
            yield pa.record_batch({"node": batch.column(0), "hashes": pa.array(found, pa.binary())})

    return map_arrow(met, sets, "node binary, hashes binary").groupBy("node").agg(F.min("hashes").alias("hashes"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return map_arrow(both.select("a", "b", "x", "y"), compare, "a binary, b binary")


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall in each of ``SLOTS`` hash slots: a table of fixed size, on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for row in batch.column(0):
                np.add.at(total, np.frombuffer(row.as_buffer(), np.uint64) % SLOTS, 1)
        found = np.flatnonzero(total)
        yield pa.record_batch({"slot": pa.array(found), "n": pa.array(total[found])})

    sums = map_arrow(sets.select("hashes"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def _rare_prefixes(sets: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """The rarest shingles (key) of every set, as many as two sets of the similarity can't all differ in, with the set's
    node, class (kin), size n and the size ``most`` of the largest set that could have this shingle as the first common one.

    Rare is by slot, then by hash: one order for all sets, so a pair's first common shingle stands in both prefixes, and
    all that the two share stands behind it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, sizes, most = [], [], [], []
            for row, text in enumerate(batch.column(2)):
                own = np.frombuffer(text.as_buffer(), np.uint64)
                n = len(own)
                order = np.lexsort((own, counts[own % SLOTS]))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                keys.append(own[order].view(np.int64))
                owner.append(np.full(len(order), row))
                sizes.append(np.full(len(order), n))
                most.append(np.floor((n - np.arange(len(order))) * (1 + 1 / similarity) + 1e-9).astype(np.int64) - n)
            if keys:
                at = pa.array(np.concatenate(owner))
                numbers = [pa.array(np.concatenate(c)) for c in (sizes, most)]
                columns = [pa.array(np.concatenate(keys)), batch.column(0).take(at), batch.column(1).take(at), *numbers]
                yield pa.record_batch(columns, names=["key", "node", "kin", "n", "most"])

    return map_arrow(sets.select("node", "kin", "hashes"), scan, "key long, node binary, kin long, n long, most long")


def _open_members(placed: DataFrame) -> DataFrame:
    """Members (bucket, node, root) of buckets with more than one class, the bucket's largest class (top), and how many
    members it has (every) and has outside that class (rest)."""
    classes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = classes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("every")).where("top.n < every")
    sizes = largest.select("bucket", F.col("top.root").alias("top"), "every", (F.col("every") - F.col("top.n")).alias("rest"))
    sizes = written(sizes, "similar-open")
    return placed.join(maybe_broadcast(sizes, sizes.count(), longs=6), "bucket")


def _block_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of classes: the members outside a bucket's largest class are compared with all its members, in blocks.
    Each pair of blocks has a place of its own, so a bucket is spread over as many tasks as it has blocks."""
    placed = members.join(sets.select("node", "hashes"), "node")
    block = lambda size: F.pmod(F.xxhash64("node"), F.ceil(F.col(size) / BLOCK))
    held = F.collect_list(F.struct("node", "root", "hashes"))
    ys = placed.groupBy("bucket", block("every").alias("y_block")).agg(held.alias("y"))
    rest = placed.where("root <> top").groupBy("bucket", block("rest").alias("x_block")).agg(held.alias("x"), F.max("every").alias("every"))
    xs = rest.select("bucket", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("every") / BLOCK) - 1)).alias("y_block"))
    met = xs.join(ys, ["bucket", "y_block"]).select("x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda rows: [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                theirs = numbers(ys)
                sizes = np.array([len(t) for t in theirs])
                every, owner = np.concatenate(theirs), np.repeat(np.arange(len(theirs)), sizes)
                order = np.argsort(every, kind="stable")
                every, owner = every[order], owner[order]
                for x, own in zip(xs, numbers(xs)):
                    start, end = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                    counts = end - start
                    at = np.repeat(start - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                    common = np.bincount(owner[at], minlength=len(theirs))
                    seen = {x["root"]}
                    for i in np.flatnonzero(common >= similarity * (len(own) + sizes - common)).tolist():
                        if ys[i]["root"] not in seen:
                            seen.add(ys[i]["root"])
                            links.append((x["root"], ys[i]["root"]))
            yield pa.record_batch({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return map_arrow(met, compare, "a binary, b binary")


def _rest_links(crowd: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, hot: int) -> DataFrame:
    """Links (a, b) between the classes that hubs left apart in crowded buckets, from each text to each other class.

    Two sets of the similarity share one of their rarest shingles, so the members of buckets with several classes meet
    by those: what a crowd has in common is frequent, hence late in the order, and brings no one together.  Of the texts
    at a rare shingle only those that fit by size and place are kept.  Up to ``hot`` of them are paired and verified;
    the members of larger groups are compared in blocks within their buckets."""
    placed = written(crowd.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "similar-placed")
    several = _open_members(placed).select("node", "root", F.xxhash64("root").alias("kin")).distinct()
    several = written(several.join(sets, "node"), "similar-several")
    entries = written(_rare_prefixes(several, _slot_counts(several), similarity), "similar-prefixes")
    # Of a pair the smaller set is the one whose shingle allows a partner of its own size.
    small = F.col("n") <= F.col("most")
    bounds = entries.groupBy("key").agg(
        F.min(F.when(small, F.col("n"))).alias("least"), F.max(F.when(small, F.col("most"))).alias("top"), F.min("kin").alias("k0"), F.max("kin").alias("k1")
    )
    fit = entries.join(bounds.where("least IS NOT NULL AND k0 <> k1"), "key").where("n <= top AND most >= least")
    fit = written(fit.select("key", "node", "kin", "n", "most"), "similar-fit")
    sizes = fit.groupBy("key").agg(F.count("*").alias("c"), F.min("kin").alias("k0"), F.max("kin").alias("k1")).where("k0 <> k1").select("key", "c")
    met = written(fit.join(sizes, "key"), "similar-met")
    few = met.where(F.col("c") <= hot).select("key", F.struct("node", "kin", "n", "most").alias("x"))
    both = few.join(few.withColumnRenamed("x", "y"), "key").where("x.kin <> y.kin AND x.n <= y.n AND y.n <= x.most AND x.n <= y.most")
    pairs = both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    found = verified(written(pairs, "similar-rare"), several, similarity)
    of = several.select("node", "root")
    found = found.join(of.withColumnRenamed("node", "a"), "a").select("b", F.col("root").alias("x")).join(of.withColumnRenamed("node", "b"), "b")
    many = met.where(F.col("c") > hot).select("node").distinct()
    blocks = _open_members(written(placed.join(many, "node", "left_semi"), "similar-many"))
    return found.select(F.col("x").alias("a"), F.col("root").alias("b")).unionByName(_block_links(blocks, several, similarity))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, hot: int = HOT, carry: Column | None = None) -> DataFrame:
    """doc_id, mark, root: texts whose sets of word shingles have the similarity (shared over all shingles) or more, and
    all that such links reach, have one root.

    Candidates are of two kinds.  Fingerprints within two bits, by deletion variants as above.  And, as sets of similarity
    0.8 have fingerprints many bits apart, sets that agree in one group of shingles: a set is dealt to groups by hash, a
    fifth of other shingles leaves about half of the groups whole, and each of at most 12 groups is an equality key.  Every
    candidate is verified by its true similarity, so no other texts are linked.  Of pairs at 0.8 more than 0.99 share a key,
    and every link between texts that share one is found, in crowded groups too.

    Defined results: texts of the same shingle set are one node, empty texts among them; repeated rows share a root; an
    empty table gives no rows; null ids are ids like others; columns other than doc_id, text and those of ``carry`` are
    not read."""
    marked = written(sketches(docs, shingle, similarity, carry), "similar-sketches")
    points = marked.groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("groups").alias("groups"))
    points = written(points, "similar-points")
    found, crowd = _bucket_pairs(points, similarity, hot)
    pairs = written(found.unionByName(_fingerprint_pairs(points, hot)).distinct(), "similar-pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowd.select("node"))
    sets = written(shingle_sets(docs, points, nodes, shingle), "similar-sets")
    roots = connected_components(written(verified(pairs, sets, similarity), "similar-links"))
    rest = written(_rest_links(crowd, roots, sets, similarity, hot), "similar-rest")
    # What the rest joins are whole classes: their roots get a root of their own.
    joined = connected_components(rest).select(F.col("root").alias("last"), F.col("node").alias("root"))
    named = marked.join(maybe_broadcast(roots, roots.count(), longs=4), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(maybe_broadcast(joined, joined.count(), longs=4), "root", "left")
    return named.select("doc_id", "mark", F.coalesce("last", "root").alias("root"))


def op5_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns; the fingerprint as 16 lower-case hex digits."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
