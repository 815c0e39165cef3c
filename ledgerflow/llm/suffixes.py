"""Operator 3: removal of long repeated strings by sorting sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import Sieve, give_back, keyed, mixed, pieces, powers, sieved, slices

LENGTH = 400  # bytes of a string that must not repeat
HEAD = 200  # leading bytes that make a suffix's leading token
ROWS = 400_000  # suffixes that one task sorts
HOT = 1_000  # anchors of one leading token that one task compares
SUFFIX = "head long, d0 long, d1 long, doc long, part binary, spots array<int>, far int, near int"
# A second value for each byte, for a second hash.
SHUFFLED = (np.arange(256) * 167 + 43).astype(np.uint8)


def rolled(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: len(data) - width + 1])


def running(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` values in a row, by block prefixes and suffixes."""
    if len(values) < width:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, fill, values.dtype)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = pick.accumulate(square, axis=1).ravel()
    behind = pick.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


def anchors(heads: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places that are the first least of some ``window`` hashes in a row, and the first and last window of each."""
    least = running(heads, window, np.minimum, np.iinfo(np.uint64).max)
    if not len(least):
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(window - 1, np.uint64)
    # Every place lies in `window` windows, fewer at the ends; it holds the least of one of them or of none.
    spots = np.flatnonzero(running(np.concatenate([edge, least, edge]), window, np.maximum, 0) == heads)
    # Windows whose first least place this is: behind the last place as small, and before the next smaller one.
    value = heads[spots]
    first = np.maximum(spots - window + 1, 0)
    last = np.minimum(spots, len(least) - 1)
    for at, lower in ((1, np.less_equal), (-1, np.less)):
        # Spots that matter for a window are spots themselves: the neighbours decide, or theirs.
        near = np.arange(len(spots)) - at
        while True:
            inside = (near >= 0) & (near < len(spots))
            near_ = np.clip(near, 0, len(spots) - 1)
            close = inside & (np.abs(spots[near_] - spots) < window)
            on = close & ~lower(value[near_], value)
            if not on.any():
                break
            near = np.where(on, near - at, near)
        if at == 1:
            first = np.where(close, np.maximum(first, spots[near_] + 1), first)
        else:
            last = np.where(close, np.minimum(last, spots[near_] - window), last)
    some = first <= last
    return spots[some], first[some], last[some]


def multikey_order(words: list[np.ndarray], leaf: int = 4096) -> np.ndarray:
    """Order of rows by their words, by multikey quicksort.

    A stretch is parted by a pivot word at its depth into less, equal and
    greater; only the equal part goes on to the next word. Short stretches are
    sorted outright.
    """
    order = np.arange(len(words[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(words):
            continue
        rows = order[lo:hi]
        if hi - lo <= leaf:
            order[lo:hi] = rows[np.lexsort([w[rows] for w in words[: depth - 1 if depth else None : -1]])]
            continue
        key = words[depth][rows]
        pivot = np.sort(key[:: max(1, len(key) // 63)])[len(key[:: max(1, len(key) // 63)]) // 2]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate([rows[less], rows[same], rows[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


class RepeatedStrings:
    """Finds the bytes covered by strings of ``length`` bytes that start in two places or more.

    A string's anchor is the place in it whose next ``head`` bytes hash least,
    so equal strings have equal anchors. Suffixes are taken at anchors only and
    compared by three words: the leading token, which is the hash of their first
    ``head`` bytes, and a 128-bit digest of the bytes that all strings of that
    anchor can reach. Sorted, they tell which anchors repeat with all their
    strings and which with the leading token only. The strings of the latter
    are compared one by one, unless their bytes are covered anyhow, with those
    of all anchors of the same token, one for each digest; so nothing is missed.
    """

    def __init__(self, length: int = LENGTH, head: int = HEAD, rows: int = ROWS, hot: int = HOT):
        self.length, self.head, self.rows, self.hot = length, head, rows, hot
        self.window = length - head + 1
        self.block = max(1, length // 8)

    def anchored(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the heads, anchors, and how far before them their first and last string start."""
        heads = rolled(np.frombuffer(text, np.uint8), self.head)
        spots, first, last = anchors(heads, self.window)
        return heads, spots, spots - first, spots - last

    def sampled(self, docs: DataFrame) -> DataFrame:
        """The suffix at each anchor, one row for the equal ones of a document."""
        length, reach = self.length, self.window - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                docs_, parts = batch.column("doc").to_numpy(), batch.column("part").to_pylist()
                for first, texts in pieces(batch, "text"):
                    found = []
                    for row, text in enumerate(texts, first):
                        if len(text) < length:
                            continue
                        heads, spots, far, near = self.anchored(text)
                        groups: dict = {}
                        for at, a, b in zip(spots.tolist(), far.tolist(), near.tolist()):
                            ahead = min(at, reach)
                            key = hashlib.blake2b(text[at - ahead : at + length], digest_size=16, key=ahead.to_bytes(4, "big")).digest()
                            groups.setdefault(key, (int(heads[at]), a, b, []))[3].append(at)
                        found += [(h, k, int(docs_[row]), parts[row], s, a, b) for k, (h, a, b, s) in groups.items()]
                    yield suffix_rows(found)

        return docs.select("doc", "part", "text").mapInArrow(run, SUFFIX)

    def compared(self, suffixes: DataFrame, name: str) -> DataFrame:
        """The suffixes with ``mark``: 2 if the digest repeats as well, 1 if only the leading token does; no others.

        Spark's sampled splitters deal the suffixes into ranges of leading
        tokens; the document is the last part of the key, so equal suffixes of
        very many documents fall into several ranges. Each range is sorted by
        itself and neighbours are compared; the ends of the ranges are compared
        with the ends of the others.
        """
        spark = suffixes.sparkSession
        suffixes = durable(suffixes, name)
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // self.rows))
        dealt = suffixes.repartitionByRange(ranges, "head", "d0", "d1", "doc").withColumn("range", F.spark_partition_id())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            held = list(batches)
            table = pa.Table.from_batches(held) if held else None
            if not table:
                return
            words = [table.column(c).to_numpy() for c in ("head", "d0", "d1")]
            order = multikey_order(words)
            head, d0, d1 = (w[order] for w in words)
            near = head[1:] == head[:-1]
            same = near & (d0[1:] == d0[:-1]) & (d1[1:] == d1[:-1])
            several = (table.column("spots").combine_chunks().value_lengths().to_numpy() > 1)[order]
            token, full = several.copy(), several.copy()
            for mark, equal in ((token, near), (full, same)):
                mark[1:] |= equal
                mark[:-1] |= equal
            mark = np.where(full, 2, np.where(token, 1, 0)).astype(np.int32)
            end = np.zeros(len(order), bool)
            end[[0, -1]] = True
            some = (mark > 0) | end
            kept = table.take(pa.array(order[some]))
            kept = kept.append_column("mark", pa.array(mark[some])).append_column("end", pa.array(end[some]))
            yield from kept.to_batches(max_chunksize=100_000)

        ordered = durable(dealt.mapInArrow(run, f"{SUFFIX}, range int, mark int, end boolean"), name)
        # Two lines for each range: its first and last suffix.
        ends = ordered.where("end").select("range", "head", "d0", "d1")
        tokens = ends.groupBy("head").agg(F.count_distinct("range").alias("n")).where("n > 1").select("head", F.lit(1).alias("t"))
        fulls = ends.groupBy("head", "d0", "d1").agg(F.count_distinct("range").alias("n")).where("n > 1")
        # Either list holds an entry for each range at most.
        joined = ordered.join(F.broadcast(tokens), "head", "left").join(
            F.broadcast(fulls.select("head", "d0", "d1", F.lit(2).alias("f"))), ["head", "d0", "d1"], "left"
        )
        mark = F.greatest(F.col("mark"), F.coalesce("t", F.lit(0)), F.coalesce("f", F.lit(0)))
        return joined.withColumn("mark", mark).where("mark > 0").drop("range", "end", "t", "f")

    def settled(self, marked: DataFrame) -> DataFrame:
        """``(doc, part, lo, hi, open)``: byte ranges known to repeat, and leading tokens of anchors that have other bytes."""
        length = self.length
        entry = F.struct("head", "mark", "far", "near", "spots")
        # Rows of one id and text have equal entries; they are gathered once.
        once = marked.select("doc", "part", "head", "d0", "d1", "mark", "far", "near", "spots").distinct()
        texts = once.groupBy("doc", "part").agg(F.collect_list(entry).alias("all"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                los, his, opens = [], [], []
                for value in batch.column("all"):
                    rows = value.values
                    spots = rows.field("spots")
                    number = spots.value_lengths().to_numpy()
                    at = spots.flatten().to_numpy().astype(np.int64)
                    head, mark, far, near = (np.repeat(rows.field(c).to_numpy(), number) for c in ("head", "mark", "far", "near"))
                    lo, hi = at - far, at - near + length
                    full = mark == 2
                    a, b = merged(lo[full], hi[full])
                    # A range is covered if the last one that starts no later ends no earlier.
                    place = np.searchsorted(a, lo, "right") - 1
                    over = (place >= 0) & (np.append(b, 0)[place] >= hi)
                    los.append(a)
                    his.append(b)
                    opens.append(np.unique(head[~over]))
                made = [pa.array([x.tolist() for x in xs], pa.list_(t)) for xs, t in ((los, pa.int32()), (his, pa.int32()), (opens, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), *made], ["doc", "part", "lo", "hi", "open"])

        return texts.mapInArrow(run, "doc long, part binary, lo array<int>, hi array<int>, open array<long>")

    def contexts(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """The bytes that the strings of the wanted anchors ``(doc, part, head, at)`` span."""
        length = self.length
        entry = F.collect_list(F.struct("at", "far", "near", "head", "hot"))
        each = wanted.groupBy("doc", "part").agg(entry.alias("all"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in (part for whole in batches for part in slices(whole, "text")):
                docs_, parts = batch.column("doc").to_pylist(), batch.column("part").to_pylist()
                found = []
                for row, (text, value) in enumerate(zip(batch.column("text").cast(pa.binary()), batch.column("all"))):
                    data = text.as_py()
                    for e in value.as_py():
                        lo, hi = e["at"] - e["far"], e["at"] - e["near"] + length
                        found.append((e["head"], docs_[row], parts[row], lo, e["far"], data[lo:hi], e["hot"]))
                columns = list(zip(*found)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["head", "doc", "part", "lo", "far", "bytes", "hot"])

        texts = sieved(docs, Sieve(each, "doc"), True)
        joined = texts.join(each, ["doc", "part"]).select("doc", "part", "text", "all")
        return joined.mapInArrow(run, "head long, doc long, part binary, lo int, far int, bytes binary, hot boolean")

    def matched(self, contexts: DataFrame) -> DataFrame:
        """``(doc, part, lo, hi)``: of each context, the bytes that its repeated strings cover.

        All strings of a context share its anchor, so what they cover is one
        range, from the first to the last that repeats.
        """
        length = self.length

        def compare(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sizes = np.array([len(t) for t in texts])
            data = np.frombuffer(b"".join(texts), np.uint8)
            starts = np.cumsum(sizes) - sizes
            number = sizes - length + 1
            owner = np.repeat(np.arange(len(texts)), number)
            at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            place = starts[owner] + at
            one, two = rolled(data, length)[place], rolled(SHUFFLED[data], length)[place]
            order = np.lexsort((two, one))
            equal = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            hit = np.zeros(len(order), bool)
            hit[1:] |= equal
            hit[:-1] |= equal
            hits = np.sort(order[hit])
            who, heads = np.unique(owner[hits], return_index=True)
            lows = at[hits]
            if not len(who):
                return who, who, who
            return who, np.minimum.reduceat(lows, heads), np.maximum.reduceat(lows, heads)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            held = list(batches)
            table = pa.Table.from_batches(held) if held else None
            if not table:
                return
            order = np.argsort(table.column("head").to_numpy(), kind="stable")
            head = table.column("head").to_numpy()[order]
            cuts = np.append(np.flatnonzero(np.diff(head, prepend=head[0] - 1)), len(head))
            begin = 0
            for nxt in range(1, len(cuts)):
                # As many whole groups of a leading token as make a fair number of contexts.
                if nxt < len(cuts) - 1 and cuts[nxt + 1] - cuts[begin] <= 1000:
                    continue
                rows = order[cuts[begin] : cuts[nxt]]
                begin = nxt
                part = table.take(pa.array(rows))
                who, least, most = compare(part.column("bytes").to_pylist())
                lo = part.column("lo").to_numpy()[who]
                some = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc").combine_chunks(), some.column("part").combine_chunks(), pa.array((lo + least).astype(np.int32)), pa.array((lo + most + length).astype(np.int32))],
                    ["doc", "part", "lo", "hi"],
                )

        parts = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-contexts.count() // 100_000))
        return contexts.repartition(parts, "head").mapInArrow(run, "doc long, part binary, lo int, hi int")

    def cells(self, contexts: DataFrame, width: int, whole: bool) -> DataFrame:
        """The contexts' ``runs`` of strings, each ``width`` strings in a row as a suffix; ``far`` and ``near`` are the first and last start.

        Equal strings start equally far before their anchors. Cells are counted
        from there, so equal strings lie in cells that share equal bytes. What
        is told apart are the bytes that all strings of a cell share, or with
        ``whole`` all bytes that its strings in the run cover.
        """
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            found = []
            for batch in batches:
                for row in batch.to_pylist():
                    text, lo, far = row["bytes"], row["lo"], row["far"]
                    for r in row["runs"]:
                        first, last = far - (r["first"] - lo), far - (r["last"] - lo)
                        for b in range(last // width, first // width + 1):
                            ahead, least = min(first, (b + 1) * width - 1), max(last, b * width)
                            if whole:
                                shared, key = text[far - ahead : far - least + length], (ahead, least)
                            else:
                                shared, key = text[far - b * width : far - (b + 1) * width + 1 + length], (b, 0)
                            digest = hashlib.blake2b(shared, digest_size=16, key=b"".join(k.to_bytes(4, "big") for k in key)).digest()
                            found.append((row["head"] % (1 << 64), digest, row["doc"], row["part"], [lo], lo + far - ahead, lo + far - least))
                    if len(found) > 10_000:
                        yield suffix_rows(found)
                        found = []
            if found:
                yield suffix_rows(found)

        return contexts.select("head", "doc", "part", "lo", "far", "bytes", "runs").mapInArrow(run, SUFFIX)

    def blocks(self, contexts: DataFrame, whole: bool = False) -> DataFrame:
        """The contexts' runs in cells of ``block`` strings."""
        return self.cells(contexts, self.block, whole)

    def strings(self, contexts: DataFrame) -> DataFrame:
        """All strings of the contexts' runs as suffixes of their own."""
        return self.cells(contexts, 1, True)

    def spread(self, contexts: DataFrame) -> DataFrame:
        """Like :meth:`matched`, for leading tokens of any number of contexts: nothing is gathered by token.

        Blocks of strings are sorted in ranges like the suffixes. Of those whose
        shared bytes repeat, the ones that repeat as a whole are settled, and one
        stands for all its copies; its strings and those of the others are sorted.
        """
        keys, place = ["doc", "part", "lo"], F.get("spots", F.lit(0)).alias("lo")
        # Rows of one id and text have equal contexts: a set, or each would bring the runs of all.
        runs = F.collect_set(F.struct(F.col("far").alias("first"), F.col("near").alias("last"))).alias("runs")

        def within(cells: DataFrame) -> DataFrame:
            return contexts.join(cells.groupBy(*keys).agg(runs), keys)

        span = F.struct(F.col("lo").alias("first"), (F.col("lo") + F.length("bytes") - self.length).alias("last"))
        some = self.compared(self.blocks(contexts.withColumn("runs", F.array(span))), "blocks").where("mark = 2")
        # Each of these shares its leading token with another one, so all come back marked.
        known = durable(self.compared(self.blocks(within(some.select("doc", "part", place, "far", "near")), True), "whole"), "whole")
        one = known.groupBy("head", "d0", "d1").agg(F.min(F.struct("doc", "part", place, "far", "near")).alias("e")).select("e.*")
        found = self.compared(self.strings(within(one)), "strings").unionByName(known).where("mark = 2")
        # All strings of a context share its anchor: what they cover is one range.
        each = found.select("doc", "part", place, "far", "near").groupBy(*keys).agg(F.min("far").alias("first"), F.max("near").alias("last"))
        return each.select("doc", "part", F.col("first").alias("lo"), (F.col("last") + self.length).alias("hi"))

    def crowded(self, rows: DataFrame) -> DataFrame:
        """Leading tokens of more than ``hot`` rows."""
        return rows.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > self.hot).select("head")

    def covered(self, docs: DataFrame) -> DataFrame:
        """``(doc, part, lo, hi)``: arrays of byte ranges that cover all repeated strings."""
        length = self.length
        marked = durable(self.compared(self.sampled(docs), "suffixes"), "anchors")
        settled = durable(self.settled(marked), "settled")
        open_ = settled.select(F.explode("open").alias("head")).distinct()
        # Of equal suffixes one stands for all; those that repeat are settled themselves.
        first = F.min(F.struct("doc", "part", F.get("spots", F.lit(0)).alias("at"), "far", "near")).alias("e")
        # Tokens of many suffixes are not dealt by token; one line for each `hot` suffixes at most.
        many = durable(self.crowded(marked), "crowded")
        crowd = marked.join(F.broadcast(open_.join(F.broadcast(many), "head", "left_semi")), "head", "left_semi")
        rest = marked.join(F.broadcast(many), "head", "left_anti").join(open_, "head", "left_semi")
        one = rest.unionByName(crowd).groupBy("head", "d0", "d1").agg(first).select("head", "e.*")
        one = durable(one, "opened")
        hot = self.crowded(one).withColumn("hot", F.lit(True))
        wanted = one.join(F.broadcast(hot), "head", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        contexts = durable(self.contexts(docs, wanted), "contexts")
        alike = self.matched(contexts.where("NOT hot"))
        spread = self.spread(contexts.where("hot"))
        known = settled.select("doc", "part", F.explode(F.arrays_zip("lo", "hi")).alias("r")).select("doc", "part", "r.lo", "r.hi")
        ranges = known.unionByName(alike).unionByName(spread).groupBy("doc", "part").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))
        return durable(ranges.select("doc", "part", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi")), "ranges")

    def removed(self, docs: DataFrame) -> DataFrame:
        """See :func:`remove_repeats`."""
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        known = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
        ranges = self.covered(known)
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in (part for whole in batches for part in slices(whole, "text")):
                rows = []
                ranged = "lo" in batch.schema.names
                for row, value in enumerate(batch.column("text").cast(pa.binary())):
                    text = value.as_py()
                    if not ranged or not batch.column("lo")[row].is_valid:
                        rows.append((len(text), 0, 0, text))
                        continue
                    lo, hi = merged(*(batch.column(c)[row].values.to_numpy().astype(np.int64) for c in ("lo", "hi")))
                    kept = b"".join(text[a:b] for a, b in zip(np.append(0, hi), np.append(lo, len(text))))
                    rows.append((len(text), int((hi - lo).sum()), len(lo), kept))
                n, gone, runs, kept = zip(*rows) if rows else ((), (), (), ())
                made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

        # Only texts that may lose bytes are shuffled.
        sieve = Sieve(ranges, "doc")
        cut = sieved(known, sieve, True).join(ranges, ["doc", "part"], "left").select("doc_id", "text", "lo", "hi")
        whole = sieved(known, sieve, False).select("doc_id", "text")
        return cut.mapInArrow(run, schema).union(whole.mapInArrow(run, schema))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that touch or overlap, joined."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]


def suffix_rows(found: list[tuple]) -> pa.RecordBatch:
    words = np.frombuffer(b"".join(f[1] for f in found), np.int64).reshape(-1, 2)
    columns = [
        pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64)), pa.array(words[:, 0]), pa.array(words[:, 1]),
        pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.binary()),
        pa.array([f[4] for f in found], pa.list_(pa.int32())),
        pa.array([f[5] for f in found], pa.int32()), pa.array([f[6] for f in found], pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["head", "d0", "d1", "doc", "part", "spots", "far", "near"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options: int) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: each text without its repeated bytes.

    A byte goes if it is covered by ``length`` bytes of its UTF-8 text that also
    start anywhere else, in another document or in the same one, overlapping or
    not. ``n_spans`` counts the maximal removed runs, ``kept`` is what is left,
    in order; it may part a character. NULL and empty texts have no bytes; texts
    under ``length`` bytes stay whole. Rows that repeat count as texts of their
    own, so a long text that comes twice goes both times. Other columns are
    ignored. Texts are shuffled only where they may lose bytes.
    """
    return RepeatedStrings(length, **options).removed(docs)
