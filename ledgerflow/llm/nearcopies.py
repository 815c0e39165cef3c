"""Operator 9: near copies by banded MinHash with sequential Bayesian verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import Sieve, give_back, mixed, pieces, shingle_hashes, word_hashes
from .components import components

BANDS, ROWS = 28, 4  # a pair at similarity 0.8 misses all bands once in 2.6 million
BATCH = 16  # signature values that are compared at a time
MISS = 1e-6  # posterior probability of a link below which a pair is given up
HEADS = 3  # members of each bucket that all its others are compared with first
BLOCK = 512  # members of a bucket that one task compares with others


def signatures(shingles: np.ndarray, owner: np.ndarray, count: int, size: int) -> np.ndarray:
    """MinHash values (32 bits) of each text's shingles; texts without any keep the largest value."""
    seeds = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    result = np.full((count, size), np.uint32(0xFFFFFFFF))
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(heads):
        # Multiplying by odd numbers permutes; the upper half of the product is kept.
        for k, seed in enumerate(seeds):
            result[owner[heads], k] = np.minimum.reduceat((shingles * seed >> np.uint64(32)).astype(np.uint32), heads)
    return result


def least_agreement(size: int, batch: int, similarity: float, miss: float) -> list[int]:
    """For each number of compared values, the matches below which a pair is given up.

    With a uniform prior, m matches of n make the similarity Beta(m + 1, n - m + 1);
    a pair goes when that is above ``similarity`` with a probability under
    ``miss``. That tail is the binomial chance of at most m successes in n + 1
    trials.
    """
    limits = []
    for n in range(batch, size + 1, batch):
        tail, least = 0.0, n + 1
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= miss:
                least = m
                break
        limits.append(least)
    return limits


def surviving(left: np.ndarray, right: np.ndarray, batch: int, limits: list[int]) -> np.ndarray:
    """Numbers of the row pairs that are never given up, comparing one batch of values after the other."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for step, least in enumerate(limits):
        part = slice(step * batch, (step + 1) * batch)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def alike(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach ``percent`` of their union."""
    if len(left) > len(right):
        left, right = right, left
    if not len(left) or 100 * len(left) < percent * len(right):
        return False
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    both = int((right[at] == left).sum())
    return 100 * both >= percent * (len(left) + len(right) - both)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def described_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Shingles, their texts' numbers, set sizes and digests (None for an empty set)."""
    sets, owner = shingle_hashes(*word_hashes(texts), len(texts), width)
    sizes = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(sizes)
    # Order does not matter in sums: two independent ones name a set.
    sums = np.zeros((len(sets) + 1, 2), np.uint64)
    np.cumsum(np.stack([mixed(sets), mixed(sets ^ np.uint64(0x5851F42D4C957F2D))], 1), axis=0, out=sums[1:])
    same = sums[ends] - sums[ends - sizes]
    return sets, owner, sizes, [s.tobytes() if n else None for s, n in zip(same, sizes)]


def unpack(column: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), dtype) for v in column]


class NearCopies:
    """Links documents whose sets of word shingles are alike.

    ``width`` words make a shingle; two different sets are linked if
    100 * intersection >= ``percent`` * union.
    """

    def __init__(self, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, block: int = BLOCK):
        self.width, self.percent, self.bands, self.rows, self.block = width, percent, bands, rows, block
        self.size = -(-bands * rows // BATCH) * BATCH
        self.limits = least_agreement(self.size, BATCH, percent / 100, miss)

    def described(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, n_shingles, same, sig)``: size of the set, digest of the set, signature."""
        width, size = self.width, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                ids = batch.column("doc_id")
                for first, texts in pieces(batch, "text"):
                    sets, owner, sizes, same = described_sets(texts, width)
                    sig = signatures(sets, owner, len(texts), size)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                        ["doc_id", "n_shingles", "same", "sig"],
                    )

        return texts_of(docs).mapInArrow(run, "doc_id long, n_shingles long, same binary, sig binary")

    def full_sets(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """``(id, shingles)``: the sorted sets of the wanted ``(id, same)``.

        Made from the texts anew rather than kept for all documents; a sieve of
        fixed size drops most others before anything is shuffled.
        """
        sieve, width = Sieve(wanted, "id"), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                batch = batch.filter(pa.array(sieve.passes(batch.column("doc_id").fill_null(-1).to_numpy())))
                for first, texts in pieces(batch, "text"):
                    sets, _, sizes, same = described_sets(texts, width)
                    ends = np.cumsum(sizes)
                    full = [sets[e - n : e].tobytes() for e, n in zip(ends, sizes)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, len(texts)), pa.array(same, pa.binary()), pa.array(full, pa.binary())],
                        ["id", "same", "shingles"],
                    )

        made = texts_of(docs).mapInArrow(run, "id long, same binary, shingles binary")
        return made.join(wanted, ["id", "same"]).dropDuplicates(["id", "same"]).select("id", "shingles")

    def banded(self, signed: DataFrame) -> DataFrame:
        """``(bucket, band, id)``: the bucket of each set in every band."""
        bands, rows = self.bands, self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                if not batch.num_rows:
                    continue
                sig = np.stack(unpack(batch.column("sig"), np.uint32))
                values = sig[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), values.shape[:2]).copy()
                for r in range(rows):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(sig))),
                        pa.array(np.repeat(batch.column("id").to_numpy(), bands)),
                    ],
                    ["bucket", "band", "id"],
                )

        return signed.select("id", "sig").mapInArrow(run, "bucket long, band int, id long")

    def likely(self, pairs: DataFrame, signed: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that sequential comparison of their signatures does not give up."""
        limits = self.limits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                if batch.num_rows:
                    left, right = (np.stack(unpack(batch.column(c), np.uint32)) for c in ("sig_a", "sig_b"))
                    alive = surviving(left, right, BATCH, limits)
                    yield batch.select(["a", "b"]).take(pa.array(alive))

        sig = signed.select("id", "sig")
        with_sig = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
        return with_sig.mapInArrow(run, "a long, b long")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose full sets are alike."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                hits = []
                for at, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                    if alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent):
                        hits.append(at)
                yield batch.select(["a", "b"]).take(pa.array(hits, pa.int64()))

        with_sets = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        return with_sets.mapInArrow(run, "a long, b long")

    def across(self, members: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
        """Links ``(a, b)`` that join different components among the members ``(bucket, id, component)``.

        Members are compared within their buckets only, and a pair in the first
        bucket that it shares. Small buckets are dealt to tasks in lots. In a large one its
        largest component is set apart; the rest is compared with it and
        with itself in pairs of blocks, so a group's size is bounded and no pair
        of different components is left out. A first pass over the signatures
        finds the members that have a likely mate; only these are met by their
        full sets.
        """
        spread = durable(self.spread(members), "spread")
        sig = signed.select("id", "sig")
        alive = durable(self.in_cells(spread.join(sig, "id"), False).distinct(), "alive")
        near = spread.join(alive, ["bucket", "id"]).join(sig, "id").join(sets, "id")
        return self.in_cells(near, True)

    def spread(self, members: DataFrame) -> DataFrame:
        """The members with the cells ``(lot, i, j)`` they go to, as part ``own`` of their bucket."""
        block = self.block
        sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        most = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("n"))
        small = F.col("n") <= block
        lots = members.count() // (4 * block) + 1
        parts = most.select(
            "bucket", "main", small.alias("small"),
            F.when(small, F.pmod(F.xxhash64("bucket"), F.lit(lots))).otherwise(F.col("bucket")).alias("lot"),
            F.when(small, 1).otherwise(F.ceil((F.col("n") - F.col("main_n")) / block)).cast("int").alias("rests"),
            F.when(small, 0).otherwise(F.ceil(F.col("main_n") / (4 * block))).cast("int").alias("mains"),
        )
        cut = members.join(parts, "bucket").withColumn("rest", F.col("small") | (F.col("component") != F.col("main")))
        own = F.when(F.col("rest"), F.pmod(F.xxhash64("id"), F.col("rests"))).otherwise(F.col("rests") + F.pmod(F.xxhash64("id"), F.col("mains")))
        others = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("rests") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))
        return cut.withColumn("own", own.cast("int")).withColumn("other", F.explode(others)).select(
            "bucket", "band", "id", "component", "small", "lot", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
        )

    def in_cells(self, rows: DataFrame, confirm: bool) -> DataFrame:
        """Compare the members of each bucket in each cell: ``(bucket, id)`` of likely pairs, or confirmed links ``(a, b)``.

        Where links are confirmed, components that are joined in a cell's bucket
        are not compared again there.
        """
        limits, percent, bands, width = self.limits, self.percent, self.bands, self.rows

        def mates_of(sig, band, at, mates):
            """Likely mates of a member that meet it in this band first."""
            both = np.broadcast_to(sig[at], (len(mates), sig.shape[1]))
            mates = mates[surviving(both, sig[mates], BATCH, limits)]
            if len(mates):
                equal = (sig[mates, : bands * width] == sig[at, : bands * width]).reshape(-1, bands, width).all(axis=2)
                mates = mates[equal.argmax(axis=1) == band]
            return mates

        def compare(table, sig, full, members, i, j, found):
            bucket, band = table["bucket"][members[0]], table["band"][members[0]]
            part, own = table["component"], table["own"]
            left, right = members[own[members] == i], members[own[members] == j]
            root = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for n, at in enumerate(left):
                mates = right[n + 1 :] if i == j else right
                mates = mates_of(sig, band, at, mates[part[mates] != part[at]])
                if not confirm:
                    if len(mates):
                        found.append(np.stack([np.full(len(mates) + 1, bucket), table["id"][np.append(mates, at)]], 1))
                    continue
                # The likeliest first.
                for mate in mates[np.argsort(-(sig[mates] == sig[at]).sum(axis=1), kind="stable")]:
                    if find(part[at]) != find(part[mate]) and alike(full[at], full[mate], percent):
                        root[find(part[at])] = find(part[mate])
                        found.append(np.array([[table["id"][at], table["id"][mate]]]))

        def run(cell: pa.Table) -> pa.Table:
            give_back()
            table = {c: cell.column(c).to_numpy() for c in ("bucket", "band", "id", "component", "own")}
            sig = np.stack(unpack(cell.column("sig"), np.uint32))
            full = unpack(cell.column("shingles"), np.uint64) if confirm else None
            order = np.lexsort((table["id"], table["bucket"]))
            found = [np.empty((0, 2), np.int64)]
            for members in np.split(order, np.flatnonzero(np.diff(table["bucket"][order])) + 1):
                compare(table, sig, full, members, cell.column("i")[0].as_py(), cell.column("j")[0].as_py(), found)
            pairs = np.concatenate(found) if confirm else np.unique(np.concatenate(found), axis=0)
            return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        pairs = rows.groupBy("small", "lot", "i", "j").applyInArrow(run, "a long, b long")
        return pairs if confirm else pairs.toDF("bucket", "id")

    def grouped(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, n_shingles, component_id, kept)``: see :func:`near_copies`."""
        described = durable(self.described(docs), "shingles")
        # Equal sets are one vertex, named by its least id; its signature is kept once.
        named = described.where("same IS NOT NULL AND doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("id"))
        named = durable(named, "classes")
        first = described.select("doc_id", "same", "sig").join(named.withColumnRenamed("id", "doc_id"), ["doc_id", "same"])
        signed = durable(first.dropDuplicates(["doc_id", "same"]).withColumnRenamed("doc_id", "id"), "vertices")
        buckets = self.banded(signed)
        heads = [F.min("id").alias("h0"), *[F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in range(1, HEADS)]]
        shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), *heads).where("n > 1")
        members = durable(buckets.join(shared.drop("n"), "bucket"), "buckets")
        wanted = signed.select("id", "same").join(members.select("id").distinct(), "id")
        sets = signed, durable(self.full_sets(docs, wanted), "sets")
        # In every bucket each member is compared with a few heads, the least id and some by a hash.
        stars = members.select(F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(HEADS)]))).alias("a"), F.col("id").alias("b"))
        links = self.linked(stars, sets)
        rest = self.apart(members, components(links))
        links = links.union(durable(self.across(rest, *sets), "links"))
        part = durable(components(links), "components")
        # Documents follow their set's vertex.
        of_set = named.join(part, "id", "left").select("same", F.coalesce("component", "id").alias("component"))
        out = described.select("doc_id", "n_shingles", "same").join(of_set, "same", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))

    def linked(self, pairs: DataFrame, sets: tuple[DataFrame, DataFrame]) -> DataFrame:
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return durable(self.verified(self.likely(pairs, sets[0]), sets[1]), "links")

    def apart(self, members: DataFrame, part: DataFrame) -> DataFrame:
        """``(bucket, band, id, component)``: the members of each bucket that may still have an uncompared mate there.

        A bucket's heads have met all its members; what is left matters where it
        has more than one component.
        """
        others = members.where(~F.array_contains(F.array(*[f"h{k}" for k in range(HEADS)]), F.col("id"))).select("bucket", "band", "id")
        known = others.join(part, "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component"))
        mixed_ = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        return durable(known.join(mixed_.select("bucket"), "bucket"), "apart")


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, **options) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row.

    Documents are linked if their sets of ``width``-word shingles (A-Z
    lower-cased, words parted by white space) reach ``percent`` of their union.
    A text with fewer words has its whole sequence as its one shingle. A NULL,
    empty or blank text has no shingle and is linked with nothing. The component
    is the least doc_id reachable by links, and that document is kept. Rows with
    a NULL id stand alone and are kept. Rows that repeat an id are one document
    with several texts: linked by any of them, and all kept if their id is the
    least. Other columns are ignored.

    Equal sets are collapsed before anything else. Buckets of bands are first
    linked in stars around a few members; then the other members of a bucket that are in
    different components are compared, so no pairs within a component are looked at and none besides is
    skipped. Candidates are pruned by their signatures, batch by batch, and
    confirmed on the full sets.
    """
    return NearCopies(width, percent, **options).grouped(docs)
