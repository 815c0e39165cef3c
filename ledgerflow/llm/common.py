"""Helpers that the operators of this folder share: batches of bytes, word hashes and splits."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# White space of the word rule: space and the control characters 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def share_path(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder it was started in."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the ids that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def share_of(*columns: str) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def give_back() -> None:
    """Let Arrow use the system's allocator in this worker: freed batches go back at once instead of staying pooled."""
    pa.set_memory_pool(pa.system_memory_pool())


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a batch's rows of about ``limit`` bytes: first row and UTF-8 texts, NULL as empty."""
    first, size, part = 0, 0, []
    for at, value in enumerate(batch.column(column).cast(pa.binary())):
        text = value.as_py() or b""
        if part and size + len(text) > limit:
            yield first, part
            first, size, part = at, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield first, part


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``limit`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy())
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    z = values ^ (values >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < length:
        size = max(length, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"][:length], _powers["down"][:length]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``, equal wherever the bytes are equal."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_spans(texts: list[bytes], space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts: joined bytes, starts, ends and the number of each word's text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~space[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    return data, starts, ends, np.searchsorted(begins, starts, "right") - 1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words after lower-casing A-Z, number of the text of each)."""
    data, starts, ends, owner = word_spans([t.translate(LOWER) for t in texts])
    return span_hashes(data, starts, ends), owner


def shingle_hashes(hashes: np.ndarray, owner: np.ndarray, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text, sorted by (text, hash).

    A text with fewer words than ``width`` has its whole sequence as its only
    shingle; one without words has none.
    """
    lengths = np.bincount(owner, minlength=count)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(hashes)) - first[owner]
    left = np.minimum(lengths[owner] - place, width)
    heads = np.flatnonzero((left == width) | (place == 0))
    total = np.zeros(len(heads), np.uint64)
    for step in range(width):
        reach = left[heads] > step
        total[reach] += mixed(hashes[heads[reach] + step] + np.uint64(step + 1)) * np.uint64(2 * step + 3)
    total = mixed(total)
    texts = owner[heads]
    order = np.lexsort((total, texts))
    total, texts = total[order], texts[order]
    if len(total):
        new = np.concatenate([[True], (total[1:] != total[:-1]) | (texts[1:] != texts[:-1])])
        total, texts = total[new], texts[new]
    return total, texts


class Sieve:
    """A bit for each residue of a set of 64-bit numbers: lets all of the set pass and drops most others.

    Its size is fixed, whatever the set's, so it may be sent to every task; what
    passes must still be joined with the set. A set far larger than the sieve
    makes it let more through, nothing else.
    """

    BITS = 1 << 24
    _CELL = 8 * 4096  # bits in one of the engine's bitmaps

    def __init__(self, numbers: DataFrame, column: str):
        place = F.pmod(F.col(column), F.lit(self.BITS)) + 1  # the engine counts bits from 1
        # At most BITS / _CELL rows of 4 KiB.
        cells = (
            numbers.select(place.alias("b"))
            .groupBy(F.bitmap_bucket_number("b").alias("cell"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
            .collect()
        )
        self.bits = np.zeros((self.BITS // self._CELL, 4096), np.uint8)
        for row in cells:
            self.bits[row.cell - 1] = np.frombuffer(row.bits, np.uint8)

    def passes(self, numbers: np.ndarray) -> np.ndarray:
        at = np.mod(numbers.view(np.int64), self.BITS)
        return (self.bits.ravel()[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sieved(docs: DataFrame, sieve: Sieve, passing: bool) -> DataFrame:
    """Rows whose ``doc`` (a number, not NULL) passes the sieve, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            yield batch.filter(pa.array(sieve.passes(batch.column("doc").to_numpy()) == passing))

    return docs.mapInArrow(run, docs.schema)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc`` and ``part``, which tell rows apart: the id, the least number for NULL, and a 128-bit digest of the text.

    Rows with equal keys have equal ids and texts, so what is found for one
    holds for the other.
    """
    return docs.withColumns({
        "doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
        "part": F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))),
    })


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc``, or ``(doc, part)``, is not listed in ``gone``.

    A sieve of fixed size lets most rows by, so few texts are shuffled.
    """
    keys = [c for c in ("doc", "part") if c in gone.columns]
    names = docs.columns
    known = keyed(docs.select(F.struct(*names).alias("row"), "doc_id", "text")).select("row", "doc", "part")
    sieve = Sieve(gone, "doc")
    rest = sieved(known, sieve, True).join(gone.select(*keys).distinct(), keys, "left_anti")
    return sieved(known, sieve, False).unionByName(rest).select("row.*")
