"""Operator 10: language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, pieces, share_of

ORDER = 3  # longest context in bytes
SAMPLE_BYTES = 3_000_000  # expected bytes of text to learn from, per language
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Slots:
    """Open-addressed table from 64-bit keys to their row numbers, filled and searched as arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(8, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.rows = np.full(1 << bits, -1, np.int32)
        pending, home, step = np.arange(len(keys)), self.home(keys), 0
        while len(pending):
            at = (home[pending] + step) & self.mask
            free = self.rows[at] < 0
            self.rows[at[free]] = pending[free]
            pending = pending[self.rows[at] != pending]
            step += 1

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MULTIPLIER >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it is absent."""
        home = self.home(keys)
        found = self.rows[home]
        if not len(self.keys):
            return found
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        step = 1
        while len(open_):
            row = self.rows[(home[open_] + step) & self.mask]
            found[open_] = row
            open_ = open_[(row >= 0) & (self.keys[row] != keys[open_])]
            step += 1
        return found


class Trees:
    """Byte context trees of all languages with frozen counts.

    ``grams`` are the distinct strings of ``order + 1`` bytes of the sample,
    packed into integers, ``counts`` how often each language has them. Within a
    context seen n times with q different next bytes, a byte seen c times costs
    -log2(c / (n + q)); an unseen one costs the escape -log2(q / (n + q)) plus
    its cost after the context without its first byte. A context that a language
    never saw costs nothing by itself. After the empty context, an unseen byte
    costs the escape and 8 bits.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int):
        self.order, languages = order, counts.shape[1]
        self.slots, self.costs, self.contexts, self.escapes = [], [], [], []
        lower = None
        for k in range(order + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            keys, place = np.unique(grams & mask, return_inverse=True)
            seen = np.zeros((len(keys), languages))
            np.add.at(seen, place, counts)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), languages)), np.zeros((len(contexts), languages))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            all_ = np.maximum(total + kinds, 1)
            escape = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / all_), 0.0)
            if k == 0:
                below = np.full((len(keys), languages), 8.0)
                self.unseen = (escape[0] if len(contexts) else np.zeros(languages)) + 8.0
            else:
                below = lower[np.searchsorted(self.slots[k - 1].keys, keys & (mask >> np.uint64(8)))]
            cost = np.where(seen > 0, -np.log2(np.maximum(seen, 1) / all_[of]), escape[of] + below)
            self.slots.append(Slots(keys))
            self.contexts.append(Slots(contexts))
            self.costs.append(cost)
            self.escapes.append(escape)
            lower = cost

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length in bits of each text under each language."""
        gap = b" " * self.order
        data = np.frombuffer(gap + gap.join(texts), np.uint8).astype(np.uint64)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + self.order)[:-1]]) + self.order
        grams = np.zeros(len(data), np.uint64)
        for back in range(self.order + 1):
            grams[self.order :] |= data[self.order - back : len(data) - back] << np.uint64(8 * back)
        own = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        grams = grams[own]
        rows = self.slots[self.order].find(grams)
        cost = self.costs[self.order][rows]
        rest = np.flatnonzero(rows < 0)
        if len(rest):
            cost[rest] = 0.0
            for k in range(self.order, -1, -1):
                key = grams[rest] & np.uint64((1 << 8 * (k + 1)) - 1)
                rows = self.slots[k].find(key)
                hit = rows >= 0
                cost[rest[hit]] += self.costs[k][rows[hit]]
                rest, key = rest[~hit], key[~hit]
                if k:
                    rows = self.contexts[k].find(key >> np.uint64(8))
                    known = rows >= 0
                    cost[rest[known]] += self.escapes[k][rows[known]]
                else:
                    cost[rest] += self.unseen
        result = np.zeros((len(texts), cost.shape[1]))
        filled = np.flatnonzero(sizes)
        if len(filled):
            heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])[filled]
            result[filled] = np.add.reduceat(cost, heads, axis=0)
        return result


def learn(docs: DataFrame, train: Column, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], Trees]:
    """Context trees from the rows where ``train`` holds and text and lang are set.

    Rows are picked by a hash of the text, so that a language gives about
    ``sample_bytes`` bytes or all it has; their byte strings are counted by
    Spark. What reaches the driver is at most that many counts per language.
    """
    rows = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).where("n > 0").orderBy("lang").collect()
    names = [r.lang for r in sizes]
    if not names:
        return [], Trees(np.zeros(0, np.uint64), np.zeros((0, 0)), order)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, sample_bytes / r.n))])
    chosen = rows.where(share_of("text") < share[F.col("lang")]).select("lang", F.lower("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, texts in pieces(batch, "text"):
                part = langs[first : first + len(texts)]
                for name in sorted(set(part)):
                    joined = b"".join(b" " * order + t for t, l in zip(texts, part) if l == name)
                    data = np.frombuffer(joined, np.uint8).astype(np.uint64)
                    grams = np.zeros(max(len(data) - order, 0), np.uint64)
                    for back in range(order + 1):
                        grams |= data[order - back : order - back + len(grams)] << np.uint64(8 * back)
                    keys, counts = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"]
                    )

    counted = chosen.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    grams = counted.column("gram").to_numpy().view(np.uint64)
    keys, place = np.unique(grams, return_inverse=True)
    counts = np.zeros((len(keys), len(names)))
    column = np.searchsorted(np.array(names), np.array(counted.column("lang").to_pylist()))
    np.add.at(counts, (place, column), counted.column("n").to_numpy())
    return names, Trees(keys, counts, order)


def identify(docs: DataFrame, train: Column, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, train, lang_pred, score)``: the language with the shortest code for the whole text.

    ``score`` is that language's share of the likelihood, all languages taken
    as equally probable before; ties go to the first name in order. A text that
    is NULL or has no letter is ``und`` with score 0, as is any text when there
    is nothing to learn from. Repeated rows are judged each; other columns are
    ignored. Scoring needs no shuffle.
    """
    names, trees = learn(docs, train, order, sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            known = np.array(batch.column("letters").to_pylist(), bool)
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if names:
                for first, texts in pieces(batch, "text", 1 << 18):
                    bits = trees.lengths(texts)
                    pick = bits.argmin(axis=1)
                    ahead = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0))
                    here = slice(first, first + len(texts))
                    best[here], score[here] = pick, 1.0 / ahead.sum(axis=1)
            known &= best >= 0
            told = [names[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("train"), pa.array(told, pa.string()), pa.array(np.where(known, score, 0.0))],
                ["doc_id", "train", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        train.alias("train"),
        F.lower("text").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return rows.mapInArrow(run, "doc_id long, train boolean, lang_pred string, score double")
