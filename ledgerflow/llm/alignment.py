"""Operator 11: two tokenizations of a text aligned by divide and conquer at the offsets where both end a token."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import give_back, keyed, slices
from .tokens import byte_symbols

HOT_PAIRS = 1 << 20  # id pairs whose counts are sent to the tasks; all others are joined
CACHED = 400_000  # runs a worker remembers, of CHARACTERS in all
CHARACTERS = 1 << 22
MERGED = 1 << 21  # pair counts gathered before they are added up

# A text may be cut before a space that follows something else than white space.
_CUT = re.compile(r"(?<=\S)(?= )")
_MIXED = re.compile(r"^ |\s ")


class Vocabularies:
    """The two tokenizer files, and the bytes of their tokens."""

    def __init__(self, text: str, model: bytes):
        self.json, self.model = text, model
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(self.json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=self.model)
        code = {c: i for i, c in enumerate(byte_symbols())}
        self.bytes_a = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        for token, number in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[number] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # No piece goes on past the end of a word, and A's words start at their space: then runs can be encoded one by one.
        # Control pieces never match text.
        spec = json.loads(self.json)
        plain = spec["pre_tokenizer"] or {}
        self.cuttable = (
            spec["normalizer"] is None and plain.get("type") == "ByteLevel" and not plain.get("add_prefix_space") and plain.get("use_regex", True)
            and not any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not self.b.is_control(i))
            and self.b.encode("a  b \n  c") == self.b.encode("a") + self.b.encode(" b") + self.b.encode("\n  c")
        )
        # What a space at the end of a text becomes.
        self.lone = self.b.encode("a ")[len(self.b.encode("a")):]

    def runs(self, text: str) -> list[str]:
        """The text, cut where neither vocabulary has a token across; each run stands for itself after one space."""
        if not self.cuttable:
            return [text]
        if _MIXED.search(text) is None:
            return text.split(" ")
        return [run[1:] for run in _CUT.split(" " + text)]

    def encode(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both, and how many each run has after a space: none where the bytes of either differ from the run's."""
        odd = [not r or r[0].isspace() or r[-1].isspace() for r in runs]
        if self.cuttable and not any(odd):
            # Runs stand next to each other as well as alone.
            found = self._whole(runs)
            if found is not None:
                return found
        a = [e.ids for e in self.a.encode_batch_fast([" " + r for r in runs], add_special_tokens=False)]
        b = self.b.encode(runs, num_threads=1)
        for i, run in enumerate(runs):
            if self.cuttable and run == "":
                b[i] = self.lone
            if self._joined(self.bytes_a, a[i]) != (" " + run).encode() or self._joined(self.bytes_b, b[i]) != (" " + run).encode():
                a[i], b[i] = [], []
        counts = [np.array([len(x) for x in ids], np.int64) for ids in (a, b)]
        flat = [np.fromiter((i for x in ids for i in x), np.int64) for ids in (a, b)]
        return flat[0], flat[1], counts[0], counts[1]

    @staticmethod
    def _joined(table: list[bytes], ids: list[int]) -> bytes:
        return b"".join(map(table.__getitem__, ids))

    def _whole(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """The runs encoded as one text; None unless both give back its bytes."""
        text = " ".join(runs)
        data = (" " + text).encode()
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        if self._joined(self.bytes_a, a) != data or self._joined(self.bytes_b, b) != data:
            return None
        ends = np.cumsum([len(r.encode()) + 1 for r in runs])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        counts = [np.diff(np.searchsorted(np.cumsum(lengths[ids]), ends, "right"), prepend=0) for lengths, ids in ((self.lengths_a, a), (self.lengths_b, b))]
        return a, b, counts[0], counts[1]


def divide(ends_a: np.ndarray, ends_b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (one past the last A and B token) of the groups of the intervals ``[a0, a1)`` and ``[b0, b1)``, in order.

    An interval starts and ends at offsets that both token rows share. The A end
    nearest to its middle that is also a B end, found by bisecting the B ends, cuts
    it into two halves that are treated alike; an interval without such an end
    is a group. All intervals of a level are handled at once.
    """
    cuts_a, cuts_b = [a1], [b1]
    while True:
        wide = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[wide], a1[wide], b0[wide], b1[wide]
        if not len(a0):
            break
        middle = (a0 + a1) // 2 - 1
        farthest = np.maximum(middle - a0, a1 - 2 - middle)
        cut_a, cut_b = np.zeros(len(a0), np.int64), np.zeros(len(a0), np.int64)
        open_, reach = np.arange(len(a0)), 0
        while len(open_):
            for side in (reach, -reach) if reach else (0,):
                at = middle[open_] + side
                inside = (at >= a0[open_]) & (at < a1[open_] - 1) & (cut_a[open_] == 0)
                which, at = open_[inside], at[inside]
                spot = np.searchsorted(ends_b, ends_a[at])
                hit = ends_b[spot] == ends_a[at]
                cut_a[which[hit]], cut_b[which[hit]] = at[hit] + 1, spot[hit] + 1
            reach += 1
            open_ = open_[(cut_a[open_] == 0) & (farthest[open_] >= reach)]
        cut = cut_a > 0
        a0, a1, b0, b1, cut_a, cut_b = a0[cut], a1[cut], b0[cut], b1[cut], cut_a[cut], cut_b[cut]
        cuts_a.append(cut_a)
        cuts_b.append(cut_b)
        a0, a1 = np.concatenate([a0, cut_a]), np.concatenate([cut_a, a1])
        b0, b1 = np.concatenate([b0, cut_b]), np.concatenate([cut_b, b1])
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at ``first``, one range after the other."""
    skipped = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(skipped - first, count)


class Aligner:
    """Runs with their ids of both vocabularies and the ends of their groups; each is worked out once and remembered."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        # Of A and B: ids of all runs in a row, whether each ends a group, and where each run starts.
        self.ids = [np.zeros(0, np.int32) for _ in "ab"]
        self.ends = [np.zeros(0, bool) for _ in "ab"]
        self.first = [np.zeros(1, np.int64) for _ in "ab"]
        self.held = 0

    def learn(self, runs: set[str]) -> None:
        """Align the runs not known yet."""
        new = list(runs.difference(self.known))
        if len(self.known) + len(new) > CACHED or self.held > CHARACTERS:
            self.clear()
            new = list(runs)
        self.held += sum(map(len, new))
        waiting = iter(new)
        while part := list(islice(waiting, 20_000)):
            self._add(part)

    def _add(self, runs: list[str]) -> None:
        ids_a, ids_b, count_a, count_b = self.v.encode(runs)
        # Both rows of tokens cover the same bytes, so running sums of lengths are offsets in one joined text.
        ends_a, ends_b = np.cumsum(self.v.lengths_a[ids_a]), np.cumsum(self.v.lengths_b[ids_b])
        a1, b1 = np.cumsum(count_a), np.cumsum(count_b)
        good = count_a > 0
        cuts = divide(ends_a, ends_b, (a1 - count_a)[good], a1[good], (b1 - count_b)[good], b1[good])
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs))))
        for side, (ids, stops, last) in enumerate(zip((ids_a, ids_b), (a1, b1), cuts)):
            flags = np.zeros(len(ids), bool)
            flags[last - 1] = True
            self.ids[side] = np.concatenate([self.ids[side], ids.astype(np.int32)])
            self.ends[side] = np.concatenate([self.ends[side], flags])
            self.first[side] = np.concatenate([self.first[side], self.first[side][-1] + stops])

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For A and B: ids of all texts, whether each ends a group, and where each text ends; a text may have no tokens."""
        cut = [self.v.runs(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        at = np.fromiter((n for runs in cut for n in map(self.known.__getitem__, runs)), np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(runs) for runs in cut])
        keep = ~np.isin(owner, owner[self.first[0][at + 1] == self.first[0][at]])
        at, owner = at[keep], owner[keep]
        result = []
        for ids, ends, first in zip(self.ids, self.ends, self.first):
            held = first[at + 1] - first[at]
            inside = _ranges(first[at], held)
            result.append((ids[inside], ends[inside], np.cumsum(np.bincount(owner, held, len(texts)).astype(np.int64))))
        return result


def tokenizer_files(path_a: str, path_b: str) -> tuple[str, bytes]:
    """What the two files hold; a few megabytes that go with each task."""
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return a.read(), b.read()


# What this worker has aligned so far, for the last pair of files it was given: kept from task to task.
_last: list[tuple[tuple[str, bytes], Aligner]] = []


def aligner_for(files: tuple[str, bytes]) -> Aligner:
    if not _last or _last[0][0] != files:
        _last[:] = [(files, Aligner(Vocabularies(*files)))]
    return _last[0][1]


def _groups_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part in slices(batch, column, 1 << 20):
        yield part, [t.as_py() or "" for t in part.column(column)]


ALIGNED = "doc long, part binary, doc_id long, a binary, a_ends binary, b binary, b_ends binary"


def aligned(rows: DataFrame, files: tuple[str, bytes], kinds: tuple[str, str]) -> DataFrame:
    """Each text's ids of both vocabularies, in the given number formats, and a bit per id that tells whether it ends a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        aligner = aligner_for(files)
        for batch in batches:
            for piece, part in _groups_of(batch, "text"):
                columns = []
                for (ids, ends, stops), kind in zip(aligner.tokens(part), kinds):
                    ids, bounds = ids.astype(kind), [0, *stops.tolist()]
                    columns.append(pa.array([ids[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()))
                    columns.append(pa.array([np.packbits(ends[i:j]).tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in ("doc", "part", "doc_id")), *columns], ["doc", "part", "doc_id", "a", "a_ends", "b", "b_ends"]
                )

    return rows.select("doc", "part", "doc_id", "text").mapInArrow(run, ALIGNED)


class Groups:
    """The groups of a run of aligned rows: ids of both sides, ends of the groups in them, and the row of each."""

    def __init__(self, batch: pa.RecordBatch, kinds: tuple[str, str]):
        self.count = batch.num_rows
        self.ids, self.last, self.sizes = [], [], []
        for name, kind in zip("ab", kinds):
            texts = batch.column(name).to_pylist()
            size = np.array([len(t) for t in texts], np.int64) // np.dtype(kind).itemsize
            ends = [np.unpackbits(np.frombuffer(e, np.uint8), count=n) for e, n in zip(batch.column(f"{name}_ends").to_pylist(), size.tolist())]
            self.ids.append(np.frombuffer(b"".join(texts), kind).astype(np.int64))
            self.last.append(np.flatnonzero(np.concatenate([np.zeros(0, np.uint8), *ends])) + 1)
            self.sizes.append(size)
        self.owner = np.searchsorted(np.cumsum(self.sizes[0]), self.last[0])
        self.widths = [np.diff(last, prepend=0) for last in self.last]
        self.links = self.widths[0] * self.widths[1]

    def pairs(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, times, row) of all links, a pair as A id times the size of B plus B id; not always added up."""
        (ids_a, ids_b), (size_a, width_b) = self.ids, self.widths
        first_a, first_b = self.last[0] - size_a, self.last[1] - width_b
        large = self.links > 1 << 12
        small = np.flatnonzero(~large)
        part = np.repeat(small, self.links[small])
        place = _ranges(np.zeros(len(small), np.int64), self.links[small])
        a, b = np.divmod(place, width_b[part])
        found = [ids_a[first_a[part] + a] * size_b + ids_b[first_b[part] + b]]
        times, whose = [np.ones(len(part), np.int64)], [self.owner[part]]
        for g in np.flatnonzero(large):
            # A long stretch without a shared end: distinct ids of both sides, with their numbers.
            one, n_one = np.unique(ids_a[first_a[g]:first_a[g] + size_a[g]], return_counts=True)
            two, n_two = np.unique(ids_b[first_b[g]:first_b[g] + width_b[g]], return_counts=True)
            found.append((one[:, None] * size_b + two).ravel())
            times.append((n_one[:, None] * n_two).ravel())
            whose.append(np.full(len(one) * len(two), self.owner[g]))
        return np.concatenate(found), np.concatenate(times), np.concatenate(whose)

    def summed(self, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact sums by row."""
        order = np.argsort(rows, kind="stable")
        ends = np.searchsorted(rows[order], np.arange(self.count), "right")
        sums = np.concatenate([[0], np.cumsum(numbers[order])])
        return np.diff(sums[ends], prepend=0)

    def written(self, names: list[np.ndarray], digits: np.ndarray) -> list[str]:
        """The groups of each row as text: all ids in their written order, joined and cut again."""
        comma, bar, semicolon = names
        (ids_a, ids_b), (last_a, last_b) = self.ids, self.last
        spot_a = np.arange(len(ids_a)) + np.repeat(np.concatenate([[0], last_b])[:-1], self.widths[0])
        spot_b = np.arange(len(ids_b)) + np.repeat(last_a, self.widths[1])
        row = np.empty(len(ids_a) + len(ids_b), object)
        row[spot_a], row[spot_b] = comma[ids_a], comma[ids_b]
        row[spot_a[last_a - 1]], row[spot_b[last_b - 1]] = bar[ids_a[last_a - 1]], semicolon[ids_b[last_b - 1]]
        size = np.zeros(len(row) + 1, np.int64)
        size[spot_a + 1], size[spot_b + 1] = digits[ids_a] + 1, digits[ids_b] + 1
        ends = np.cumsum(size)
        text = "".join(row.tolist())
        bounds = ends[np.concatenate([[0], np.cumsum(self.sizes[0] + self.sizes[1])])].tolist()
        return [text[i:max(i, j - 1)] for i, j in zip(bounds, bounds[1:])]


def pair_counts(tokens: DataFrame, kinds: tuple[str, str], size_a: int, size_b: int) -> DataFrame:
    """``(a, b, count)``: how many rows hold the id pair linked; added up in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        every = size_a * size_b
        pairs, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def added():
            key, back = np.unique(np.concatenate([pairs, *waiting]), return_inverse=True)
            one = np.ones(sum(map(len, waiting)), np.int64)
            return key, np.bincount(back, np.concatenate([counts, one]), len(key)).astype(np.int64)

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array((pairs // size_b).astype(np.int32)), pa.array((pairs % size_b).astype(np.int32)), pa.array(counts)], ["a", "b", "count"]
            )

        for batch in batches:
            for piece in slices(batch, "a", 1 << 20):
                pair, _, row = Groups(piece, kinds).pairs(size_b)
                waiting.append(np.unique(row * every + pair) % every)
                held += len(waiting[-1])
                if held > MERGED:
                    pairs, counts = added()
                    waiting, held = [], 0
                    if len(pairs) > MERGED:
                        yield rows()
                        pairs, counts = pairs[:0], counts[:0]
        pairs, counts = added()
        yield rows()

    return tokens.mapInArrow(run, "a int, b int, count long").groupBy("a", "b").agg(F.sum("count").alias("count"))


def hot_pairs(pairs: DataFrame, limit: int) -> tuple[int, int]:
    """(number of pairs, least count such that at most ``limit`` pairs have it or more), from a few hundred classes of counts."""
    level = F.floor(F.log2("count") * 16).cast("int").alias("level")
    classes = pairs.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).collect()
    total, taken, least = sum(c.n for c in classes), 0, 1 << 62
    for c in sorted(classes, key=lambda c: -c.level):
        if taken + c.n > limit:
            break
        taken, least = taken + c.n, c.least
    return total, least


class Counts:
    """Counts of the hot pairs as sorted arrays of a bounded size; negative where a pair is its A id's best."""

    def __init__(self, hot: DataFrame, size: int):
        rows = hot.select((F.col("a").cast("long") * size + F.col("b")).alias("pair"), F.when(F.col("count") == F.col("top"), -F.col("count")).otherwise(F.col("count")).alias("count")).toArrow()
        pair, count = rows.column("pair").to_numpy(), rows.column("count").to_numpy()
        order = np.argsort(pair)
        self.pair, self.count = pair[order], count[order]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of each pair, 0 for a cold one; whether it is its A id's best)."""
        if not len(self.pair):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        count = np.where(self.pair[at] == pairs, self.count[at], 0)
        return np.abs(count), count < 0


SCORED = "doc long, part binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, cold array<struct<pair:long,times:long>>"


def _scored(tokens: DataFrame, kinds: tuple[str, str], size_a: int, size_b: int, counts: Counts, texts: bool) -> DataFrame:
    """A row for each text, with what the hot pairs add and the list of its cold ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        size, every = max(size_a, size_b), size_a * size_b
        # Each id as it is written: inside a row of ids, and at the end of a group's A or B row.
        names = [np.array([f"{i}{mark}" for i in range(size)], object) for mark in ",|;"] if texts else []
        digits = np.array([len(str(i)) for i in range(size)], np.int64)
        for batch in batches:
            for piece in slices(batch, "a", 1 << 20):
                found, n = Groups(piece, kinds), piece.num_rows
                pairs, times, row = found.pairs(size_b)
                count, best = counts.of(pairs)
                numbers = [
                    *found.sizes, np.bincount(found.owner, minlength=n).astype(np.int64), found.summed(found.links, found.owner),
                    found.summed(times * best, row), found.summed(times * count, row),
                ]
                few = np.flatnonzero(count == 0)
                key, again = np.unique(row[few] * every + pairs[few], return_inverse=True)
                weight = np.bincount(again, times[few], len(key)).astype(np.int64)
                listed = pa.StructArray.from_arrays([pa.array(key % every), pa.array(weight)], ["pair", "times"])
                cold = pa.ListArray.from_arrays(pa.array(np.searchsorted(key // every, np.arange(n + 1)).astype(np.int32)), listed)
                groups = pa.array(found.written(names, digits) if texts else [None] * n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in ("doc", "part", "doc_id")), *map(pa.array, numbers), groups, cold],
                    ["doc", "part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "cold"],
                )

    return tokens.mapInArrow(run, SCORED)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", limit: int = HOT_PAIRS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` of each row's whole text.

    A is a byte-level ``tokenizer.json`` applied to a space and the text, B a
    sentencepiece model, which adds that space itself; the driver reads both. Byte
    offsets at which tokens of both end cut them into groups, found by ``divide``;
    ``groups`` lists them as ``a1,a2|b1;a3|b2,b3``. All A-B pairs of a group are
    links. A pair's count is the number of rows of the table that hold it linked;
    ``n_best`` are links whose count is the greatest of their A id.

    NULL and empty texts, and texts that either tokenization does not give back
    byte by byte, have zeros and an empty ``groups``. Repeated rows count each;
    NULL ids stay NULL; columns besides the two are not looked at. Where a space
    follows a word both vocabularies start a token (checked on the vocabularies,
    else texts stay whole), so runs between such spaces are encoded and divided
    once and remembered.

    Ids and group ends of all texts are written as one table of the shared folder,
    so that texts are encoded once; counts are summed over it in one pass and
    looked up in another. At most ``limit`` of the most frequent pairs are sent to
    the tasks; what less frequent ones add is joined by pair and summed by text,
    so that their number need not fit anywhere.
    """
    rows = keyed(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))).select("doc", "part", "doc_id", "text")
    files = tokenizer_files(path_a, path_b)
    v = Vocabularies(*files)
    kinds = tuple("<u2" if size <= 1 << 16 else "<u4" for size in (v.size_a, v.size_b))
    tokens = durable(aligned(rows, files, kinds), "tokens")
    pairs = durable(pair_counts(tokens, kinds, v.size_a, v.size_b), "pairs")
    pairs = pairs.join(pairs.groupBy("a").agg(F.max("count").alias("top")), "a")
    total, least = hot_pairs(pairs, limit)
    counts = Counts(pairs.where(F.col("count") >= least), v.size_b)
    done = _scored(tokens, kinds, v.size_a, v.size_b, counts, True)
    if total > len(counts.pair):
        # Rows with equal keys have equal pairs: each is taken once.
        rest = _scored(tokens, kinds, v.size_a, v.size_b, counts, False).select("doc", "part", F.explode("cold").alias("c")).select("doc", "part", "c.*")
        rest = rest.groupBy("doc", "part", "pair").agg(F.max("times").alias("times"))
        pair = (F.col("a").cast("long") * v.size_b + F.col("b")).alias("pair")
        known = pairs.where(F.col("count") < least).select(pair, "count", (F.col("count") == F.col("top")).alias("best"))
        hidden = durable(rest.join(known, "pair").groupBy("doc", "part").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("count")).alias("_sum")
        ), "cold")
        some = done.where(F.size("cold") > 0).join(hidden, ["doc", "part"])
        some = some.withColumns({"n_best": F.col("n_best") + F.col("_best"), "count_sum": F.col("count_sum") + F.col("_sum")}).drop("_best", "_sum")
        done = done.where(F.size("cold") == 0).unionByName(some)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
