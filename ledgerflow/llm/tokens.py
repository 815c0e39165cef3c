"""Operator 7: exact byte-level BPE token counts by rank-synchronous array merging."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The splitting rule of this family of byte-level vocabularies, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)
CACHED = 400_000


def byte_symbols() -> list[str]:
    """The character by which such a vocabulary writes each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Merge ranks of a tokenizer file as sorted arrays, small enough to be sent with a task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, kind = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or kind["type"] != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.bytes = np.array([ids[c] for c in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token.

        All pre-tokens lie in one ragged array. In each round every sequence
        merges all places of its own lowest-rank pair at once, left to right
        where they overlap; a sequence without a pair of known rank is done.
        """
        result = np.array([len(w) for w in words], np.int64)
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), result)
        while len(symbols) > 1:
            rank = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), NONE)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(np.append(rank, NONE), heads)
            each = np.repeat(lowest, np.diff(np.append(heads, len(owner))))
            spots = np.flatnonzero((rank == each[:-1]) & (rank < NONE))
            if len(spots):
                # In a run of overlapping places every second one merges.
                starts = np.flatnonzero(np.diff(spots, prepend=-2) != 1)
                runs = np.repeat(starts, np.diff(np.append(starts, len(spots))))
                spots = spots[(np.arange(len(spots)) - runs) % 2 == 0]
                symbols[spots] = self.merged[rank[spots]]
            keep = each < NONE
            keep[spots + 1] = False
            sizes = np.diff(np.append(heads, len(owner)))
            result[owner[heads]] = sizes - np.bincount(np.searchsorted(heads, spots, "right") - 1, minlength=len(heads))
            symbols, owner = symbols[keep], owner[keep]
        return result


class Counter:
    """Counts tokens of texts; remembers a bounded number of pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None

    def learn(self, parts: list[list[str]]) -> None:
        new = list(set().union(*parts).difference(self.known))
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = list(set().union(*parts))
        if new:
            self.known.update(zip(new, self.merges.counts([w.encode() for w in new]).tolist()))

    def segments(self, text: str) -> tuple[int, list[str]]:
        """Special strings in the text count one each and part it, as the library does by default."""
        if self.cut is None:
            return 0, [text]
        rest = self.cut.split(text)
        return len(rest) - 1, rest

    def long_text(self, text: str) -> int:
        number, rest = self.segments(text)
        for segment in rest:
            words = (m.group() for m in self.words.finditer(segment))
            while part := list(islice(words, 50_000)):
                self.learn([part])
                number += sum(map(self.known.__getitem__, part))
        return number

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of a bounded group of texts."""
        special, parts = [], []
        for text in texts:
            number, rest = self.segments(text)
            special.append(number)
            words = self.words.findall(rest[0])
            for segment in rest[1:]:
                words += self.words.findall(segment)
            parts.append(words)
        self.learn(parts)
        return [n + sum(map(self.known.__getitem__, words)) for n, words in zip(special, parts)]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of each row's whole text.

    ``path`` names a byte-level BPE ``tokenizer.json``; the driver reads it.
    NULL and empty texts have no bytes and no tokens. Repeated rows are counted
    each; NULL ids stay NULL. Columns besides the two are not looked at.
    Rows are independent, so there is no shuffle; texts are taken in groups of
    about a megabyte.
    """
    merges = Merges(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges)
        for batch in batches:
            sizes, numbers = [], []
            group: list[str] = []
            held = 0
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                if len(text) > 1 << 20 or held > 1 << 20:
                    numbers += counter.count(group)
                    group, held = [], 0
                if len(text) > 1 << 20:
                    numbers.append(counter.long_text(text))
                else:
                    group.append(text)
                    held += len(text)
            numbers += counter.count(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64()), pa.array([n > limit for n in numbers], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
