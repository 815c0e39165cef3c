"""Operator 12: license scans by ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, give_back, pieces, span_hashes, word_spans
from .license_rules import BASE, RULES

# A word is a run of a-z, 0-9 and non-ASCII bytes once A-Z are lower-cased.
GAP = np.ones(256, bool)
GAP[0x30:0x3A] = GAP[0x61:0x7B] = GAP[0x80:] = False
# How sure one detection of a level is.
SURE = {1: 0.6, 2: 0.8, 3: 0.9, 4: 0.95}


@dataclass(frozen=True)
class Rule:
    label: str
    level: int
    needs: tuple[bytes, ...]
    pattern: str
    base: bool = False


def parsed(text: str) -> list[Rule]:
    """Rules from lines ``label level words :: pattern``."""
    rules = []
    for line in filter(str.strip, text.splitlines()):
        head, pattern = line.split("::", 1)
        label, level, *needs = head.split()
        rules.append(Rule(label, int(level), tuple(n.encode() for n in needs), pattern.strip()))
    return rules


def signature_rules() -> list[Rule]:
    """The base phrases, then all other rules in their order."""
    return [Rule(label, 1, tuple(phrase.encode().split()), phrase, True) for label, phrase in BASE] + parsed(RULES)


def hashes_of(words: Sequence[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return span_hashes(data, ends - [len(w) for w in words], ends)


class Scanner:
    """The rules compiled, and an index from keywords to the rules they gate."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.compiled = [re.compile(b"(?<= )(?:" + r.pattern.encode() + b")(?= )") for r in rules]
        words = sorted({w for r in rules for w in r.needs})
        found = hashes_of(words)
        order = np.argsort(found)
        self.hashes = found[order]
        number = {words[i]: at for at, i in enumerate(order)}
        self.needs = [frozenset(number[w] for w in r.needs) for r in rules]
        # A rule is looked up by the first of its words only.
        self.gated: dict[int, list[int]] = {}
        for i, r in enumerate(rules):
            self.gated.setdefault(number[r.needs[0]], []).append(i)
        self.starts, self.sizes = np.zeros(256, bool), np.zeros(max(map(len, words)) + 1, bool)
        self.starts[[w[0] for w in words]] = True
        self.sizes[[len(w) for w in words]] = True

    def keywords(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the words, keyword numbers) of all keywords; most words are told by length and first byte."""
        size = np.minimum(ends - starts, len(self.sizes) - 1)
        some = np.flatnonzero(self.sizes[size] & self.starts[data[starts]])
        if not len(some):
            return some, some
        hashes = span_hashes(data, starts[some], ends[some])
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return some[hit], at[hit]

    def rules_for(self, known: set[int]) -> list[int]:
        """Rules all of whose words occur."""
        return sorted(i for k in known for i in self.gated.get(k, ()) if self.needs[i] <= known)

    def scan(self, words: bytes, rules: list[int]) -> list[tuple[int, int, int]]:
        """(rule, first word, one past the last) of every match in words that are each followed by a space."""
        text = b" " + words
        found, spaces = [], None
        for i in rules:
            for match in self.compiled[i].finditer(text):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
                found.append((i, match.start() - 1, match.end()))
        if not found:
            return []
        rule, start, end = np.array(found, np.int64).T
        return list(zip(rule.tolist(), np.searchsorted(spaces, start).tolist(), np.searchsorted(spaces, end).tolist()))

    def settled(self, found: list[tuple[int, int, int]]) -> list[bool]:
        """Whether each detection stays.

        One goes when its interval lies inside another's of a higher level, or of
        its own level that is longer or, of equal intervals, of an earlier rule.
        """
        levels = sorted({self.rules[i].level for i, _, _ in found}, reverse=True)
        reach = dict.fromkeys(levels, -1)
        stays = [True] * len(found)
        order = sorted(range(len(found)), key=lambda k: (found[k][1], -found[k][2], -self.rules[found[k][0]].level, found[k][0]))
        for k in order:
            rule, _, end = found[k]
            level = self.rules[rule].level
            stays[k] = all(reach[other] < end for other in levels if other >= level)
            reach[level] = max(reach[level], end)
        return stays


FOUND = "array<struct<label:string,start:long,end:long,level:int,base:boolean,kept:boolean>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``(doc_id, n_words, found)`` of each row's whole text.

    Words are runs of letters, digits and non-ASCII characters after A-Z are
    lower-cased. ``found`` lists every detection: label, first word and one past
    the last (words from 0), level, whether it is a base phrase, and whether it is
    ``kept``, i.e. not inside one of higher priority. Base phrases are listed
    at all their places.

    NULL and empty texts have no words and nothing found. Repeated rows are
    scanned each; NULL ids stay NULL; columns besides the two are not looked at.
    A text is taken whole, in groups of about a megabyte; rules run only on texts
    with all of their keywords, so a text without any costs one look at its words.
    There is no shuffle.
    """
    every = signature_rules() if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        scanner = Scanner(every)
        for batch in batches:
            for first, texts in pieces(batch, "text"):
                data, starts, ends, owner = word_spans([t.translate(LOWER) for t in texts], GAP)
                counts = np.bincount(owner, minlength=len(texts))
                bounds = np.concatenate([[0], np.cumsum(counts)])
                places, words = scanner.keywords(data, starts, ends)
                known: dict[int, set[int]] = {}
                for text, word in zip(owner[places].tolist(), words.tolist()):
                    known.setdefault(text, set()).add(word)
                found: list[list[dict]] = [[] for _ in texts]
                for text, has in known.items():
                    rules = scanner.rules_for(has)
                    if not rules:
                        continue
                    lo, hi = bounds[text], bounds[text + 1]
                    part = data[starts[lo]:ends[hi - 1] + 1]
                    inside = ~GAP[part]
                    keep = inside | np.concatenate([[False], inside[:-1]])
                    plain = np.where(inside, part, 0x20)[keep].astype(np.uint8).tobytes()
                    hits = scanner.scan(plain, rules)
                    found[text] = [
                        {"label": every[i].label, "start": s, "end": e, "level": every[i].level, "base": every[i].base, "kept": kept}
                        for (i, s, e), kept in zip(hits, scanner.settled(hits))
                    ]
                kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("level", pa.int32()), ("base", pa.bool_()), ("kept", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(counts.astype(np.int64)), pa.array(found, kind)], ["doc_id", "n_words", "found"]
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, found {FOUND}")


def _labels(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"])))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of the base phrases, the labels that stay, and a score, of each row (see ``scan_licenses``).

    ``score`` takes detections of different labels as independent: one minus the
    product, over the labels that stay, of one minus the best certainty of each.
    """
    found = scan_licenses(docs, id_col, text_col)
    base = F.filter("found", lambda d: d["base"])
    kept = F.filter("found", lambda d: d["kept"] | d["base"])
    starts = F.transform(base, lambda d: d["start"])
    sure = F.create_map(*[c for level, p in SURE.items() for c in (F.lit(level), F.lit(p))])
    doubt = F.aggregate(
        _labels(kept), F.lit(1.0),
        lambda left, label: left * (1 - F.array_max(F.transform(F.filter(kept, lambda d: d["label"] == label), lambda d: F.element_at(sure, d["level"])))),
    )
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(_labels(base), ",").alias("base_labels"), F.array_join(_labels(kept), ",").alias("labels"), F.round(1 - doubt, 6).alias("score"),
    )
