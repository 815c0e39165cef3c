"""Operator 4: best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
SEPARATOR = 1  # tokens that end each document
GROUP = 20_000  # documents that are packed together, about
ATTENTION = 65536.0  # length at which attention costs as much as all the rest


def price(capacity: int) -> float:
    """Cost of one sequence: linear in its length, plus attention, plus a fixed part."""
    return 64.0 + capacity * (1.0 + capacity / ATTENTION)


def place(sizes: np.ndarray, capacities: tuple[int, ...], largest: int) -> tuple[list[int], list[list[int]]]:
    """Best fit, largest piece first, opening no bin above ``largest``: (capacity of each bin, its pieces).

    A piece goes to the open bin that it leaves the least room in. If none has
    room, the bin size with the least price for each token it may come to hold
    is opened: what it holds at most is its capacity, or the piece and all that
    is still to come.
    """
    order = np.argsort(-sizes, kind="stable")
    rest = int(sizes.sum())
    open_: list[tuple[int, int]] = []  # (room left, bin), sorted
    bins: list[list[int]] = []
    opened: list[int] = []
    for at in order.tolist():
        size = int(sizes[at])
        spot = bisect_left(open_, (size, -1))
        if spot < len(open_):
            room, number = open_.pop(spot)
        else:
            fitting = [c for c in capacities if c >= size]
            fitting = [c for c in fitting if c <= largest] or fitting[:1]
            room = min(fitting, key=lambda c: (price(c) / min(c, rest), c))
            number = len(bins)
            bins.append([])
            opened.append(room)
        bins[number].append(at)
        rest -= size
        if room > size:
            insort(open_, (room - size, number))
    return opened, bins


def downsized(bins: list[list[int]], sizes: np.ndarray, capacities: tuple[int, ...]) -> list[int]:
    """The smallest permitted length that holds each bin's contents."""
    return [capacities[bisect_left(capacities, int(sizes[b].sum()))] for b in bins]


def best_packing(sizes: np.ndarray, capacities: tuple[int, ...]) -> tuple[list[int], list[list[int]]]:
    """The cheapest packing over all limits on the size that is opened, each downsized at the end."""
    best = None
    for largest in capacities:
        _, bins = place(sizes, capacities, largest)
        lengths = downsized(bins, sizes, capacities)
        cost = sum(map(price, lengths))
        if best is None or cost < best[0]:
            best = cost, lengths, bins
    return best[1], best[2]


def pack_documents(
    docs: DataFrame,
    length: Column | None = None,
    capacities: tuple[int, ...] = CAPACITIES,
    separator: int = SEPARATOR,
    group: int = GROUP,
) -> DataFrame:
    """``(pack, bin, capacity, used, place, doc_id, piece, start, length)``: a row for each piece of a document.

    ``length`` is a document's number of tokens; by default its UTF-8 bytes, one
    token each. A document longer than the largest capacity is cut there; its
    pieces but the last fill bins of their own. The last piece takes
    ``separator`` tokens more, so a NULL or empty text is a piece of length 0
    that takes those only. ``used`` counts the bin's tokens, ``place`` is the
    piece's offset in it. ``(pack, bin)`` names a sequence.

    Documents are dealt by a hash of their row into packs of about ``group``
    documents, so the number of packs follows the input and a pack's memory does
    not; at most one bin for each size stays partly filled in a pack. Only
    (id, length) pairs are shuffled. Repeated rows are packed each; an empty
    table gives no rows; columns other than doc_id and text are ignored.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    length = F.coalesce(F.octet_length("text"), F.lit(0)) if length is None else length
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"))
    packs = max(1, -(-docs.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[list, np.ndarray]]] = {}
        for batch in batches:
            numbers = batch.column("pack").to_numpy()
            for pack in np.unique(numbers):
                mine = np.flatnonzero(numbers == pack)
                held.setdefault(int(pack), []).append((batch.column("doc_id").take(pa.array(mine)).to_pylist(), batch.column("length").to_numpy()[mine]))
        for pack, parts in held.items():
            ids = np.array([i for part, _ in parts for i in part], object)
            lengths = np.concatenate([n for _, n in parts])
            # The same order whichever way the rows arrived.
            order = np.lexsort((lengths, [(-1 if i is None else i) for i in ids], [i is not None for i in ids]))
            ids, lengths = ids[order], lengths[order]
            yield from packed(pack, ids, lengths)

    def packed(pack: int, ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole = np.maximum(lengths + separator - 1, 0) // top  # pieces that fill a bin
        count = whole + 1
        doc = np.repeat(np.arange(len(ids)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * top
        last = piece == whole[doc]
        size = np.where(last, lengths[doc] + separator - start, top)
        bins_of, mates = best_packing(size, capacities)
        rows = np.array([p for b in mates for p in b], np.int64)
        number = np.repeat(np.arange(len(mates)), [len(b) for b in mates])
        used = np.array([int(size[b].sum()) for b in mates], np.int64)
        ends = np.cumsum(size[rows])
        before = np.concatenate([[0], np.cumsum(used)[:-1]])
        columns = [
            np.full(len(rows), pack), number, np.array(bins_of, np.int64)[number], used[number], ends - size[rows] - before[number],
            ids[doc[rows]].tolist(), piece[rows], start[rows], np.maximum(np.where(last, lengths[doc] - start, top), 0)[rows],
        ]
        names = ["pack", "bin", "capacity", "used", "place", "doc_id", "piece", "start", "length"]
        table = pa.table([pa.array(c, pa.int64()) for c in columns], names)
        yield from table.to_batches(max_chunksize=50_000)

    dealt = rows.withColumn("pack", F.pmod(F.xxhash64("doc_id", "length"), F.lit(packs))).repartition(packs, "pack")
    return dealt.mapInArrow(
        run, "pack long, bin long, capacity long, used long, place long, doc_id long, piece long, start long, length long"
    )
