"""Operator 6: toxicity by a weighted grammar of composed finite-state transducers over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import give_back, share_of, slices

TRAIN_ROWS = 20_000  # expected number of labelled rows to learn from, at most
STEMS = 400  # learned insult stems, at most
STEM_LENGTHS = range(4, 9)

# Words of the grammar's classes, fixed values. Insults and threats are stems.
INSULTS = "idiot moron stupid trash scum loser clown pathetic worthless disgusting imbecil dumb fool jerk vermin garbage".split()
THREATS = "kill murder destroy strangle stab shoot burn hurt beat hunt".split()
TARGETS = "you your yours u ur he she they them his her their him these those du ihr euch sie tu vous toi usted ustedes".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't didn't kein keine nicht nie pas jamais nunca".split()
REPORTS = "said says say claimed claims wrote writes quoted called according reported sagte schrieb disait dijo".split()
QUOTES = '"“”„«»'

EVENTS = "insult targeted_insult negated_insult reported_insult threat targeted_threat negated_threat reported_threat".split()
_TOKEN = re.compile(rf"[^\W\d_]+(?:'[^\W\d_]+)?|[{QUOTES}]")
_CLAUSE = re.compile(r"[.!?;:\n\r]+")


class Transducer:
    """A finite-state transducer over tagged tokens.

    ``step`` maps (state, class, tags) to (state, tags): it passes the token on
    and may add a tag to it. States are small integers, 0 the start.
    """

    def __init__(self, step):
        self.step = step

    def __matmul__(self, then: Transducer) -> Transducer:
        """Composition: this one's output tags are the next one's input."""

        def step(state, kind, tags):
            first, second = state or (0, 0)
            first, tags = self.step(first, kind, tags)
            second, tags = then.step(second, kind, tags)
            return (first, second), tags

        return Transducer(step)

    def run(self, kinds: list[str]) -> list[frozenset]:
        state, out = 0, []
        for kind in kinds:
            state, tags = self.step(state, kind, frozenset())
            out.append(tags)
        return out


def nearby(trigger: str, tag: str, reach: int) -> Transducer:
    """Tags what follows a trigger within ``reach`` tokens; the state counts down."""

    def step(state, kind, tags):
        if kind == trigger:
            return reach, tags
        return max(state - 1, 0), (tags | {tag} if state else tags)

    return Transducer(step)


def _reported(state, kind, tags):
    """Reported speech: behind a reporting verb to the clause's end, or inside quotation marks. States: bit 0 verb, bit 1 quote."""
    if kind == "report":
        state |= 1
    elif kind == "quote":
        state ^= 2
    return state, (tags | {"reported"} if state else tags)


TARGETED, NEGATED, REPORTED = nearby("target", "targeted", 4), nearby("negation", "negated", 3), Transducer(_reported)
CONTEXT = TARGETED @ NEGATED @ REPORTED
BACKWARD = nearby("target", "targeted", 3)  # a target may follow its insult


def events(kinds: list[str]) -> list[tuple[int, str]]:
    """(token, event) of each insult or threat of a clause, by the composed grammar."""
    tags = CONTEXT.run(kinds)
    behind = BACKWARD.run(kinds[::-1])[::-1]
    found = []
    for at, kind in enumerate(kinds):
        if kind in ("insult", "threat"):
            way = "reported_" if "reported" in tags[at] else "negated_" if "negated" in tags[at] else ""
            way = way or ("targeted_" if "targeted" in tags[at] | behind[at] else "")
            found.append((at, way + kind))
    return found


class Grammar:
    """The grammar with its stems and arc weights; made on each worker from plain lists."""

    def __init__(self, insults: dict[str, float], threats: list[str]):
        self.insults, self.threats = insults, set(threats)
        self.closed = {w: k for k, ws in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}
        self.closed |= {q: "quote" for q in QUOTES}
        plain = {s.rstrip("+") for s in (*insults, *threats)}
        self.lengths = sorted({len(s) for s in plain})
        self.stems = ahocorasick.Automaton()
        for stem in plain:
            self.stems.add_word(stem, len(stem))
        if insults or threats:
            self.stems.make_automaton()

    def kind(self, word: str) -> tuple[str, float]:
        if word in self.closed:
            return self.closed[word], 0.0
        for n in self.lengths:
            for stem in (word[:n], word[:n] + "+" * (len(word) > n)):
                if stem in self.insults:
                    return "insult", self.insults[stem]
            if word[:n] in self.threats:
                return "threat", 1.0
        return "other", 0.0

    def features(self, text: str) -> list[float]:
        """Weighted events of the whole text: a log-scaled sum for each kind, and their share of its length."""
        low = text.lower()
        sums = dict.fromkeys(EVENTS, 0.0)
        done = -1
        for end, size in self.stems.iter(low) if len(self.stems) else ():
            start = end - size + 1
            if start < done or (start and (low[start - 1].isalpha())):
                continue
            # The clause around the stem, parsed once.
            left = max(low.rfind(c, max(done, 0), start) + 1 for c in ".!?;:\n\r") or max(done, 0)
            stop = _CLAUSE.search(low, end)
            done = stop.start() if stop else len(low)
            words = _TOKEN.findall(low, left, done)
            kinds = [self.kind(w) for w in words]
            for at, event in events([k for k, _ in kinds]):
                sums[event] += kinds[at][1]
        total = sum(sums.values())
        return [math.log1p(v) for v in sums.values()] + [min(1.0, 200.0 * total / (len(low) + 100)), float(total > 0)]


def batches_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, Iterator[str]]]:
    """Runs of rows with a bounded amount of text."""
    give_back()
    for whole in batches:
        for batch in slices(whole, column):
            yield batch, (v.as_py() or "" for v in batch.column(column))


def stem_weights(sample: DataFrame, limit: int = STEMS) -> dict[str, float]:
    """Insult stems: the fixed list, and word beginnings that set toxic documents of the sample apart.

    A stem is taken if at least 5 toxic documents have it and it is ten times
    likelier in those; its weight is the log-odds. One that ends in + asks for
    more letters. Stems that begin with a taken one are left out.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(rows, "text"):
            found = {0: Counter(), 1: Counter()}
            for label, text in zip(batch.column("toxic").to_pylist(), texts):
                words = set(_TOKEN.findall(text.lower()))
                found[label].update({w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n})
                found[label].update({w[:n] + "+" for w in words for n in STEM_LENGTHS if len(w) > n})
                found[label][""] += 1
            for label, counts in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.string()), pa.array([label] * len(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                    ["stem", "label", "n"],
                )

    each = sample.mapInArrow(run, "stem string, label long, n long").groupBy("stem").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )
    all_ = each.where("stem = ''").first()
    weights = dict.fromkeys(INSULTS, 3.0)
    if all_ is None or not all_.toxic or not all_.clean:
        return weights
    odds = F.log((F.col("toxic") / all_.toxic) / ((F.col("clean") + 0.5) / (all_.clean + 1)))
    apart = each.where("stem <> '' AND toxic >= 5").withColumn("odds", odds).where(F.col("odds") > math.log(10))
    # What each stem explains: its odds for all the toxic documents that have it.
    best = apart.orderBy((F.col("odds") * F.col("toxic")).desc(), F.length("stem"), "stem").limit(limit).collect()
    for row in sorted(best, key=lambda r: (len(r.stem.rstrip("+")), r.stem)):
        plain = row.stem.rstrip("+")
        shorter = (plain[:n] + mark for n in range(1, len(plain)) for mark in ("", "+"))
        if plain not in weights and not any(s in weights for s in shorter):
            weights[row.stem] = round(row.odds, 4)
    return weights


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps; the last is the intercept."""
    x = np.hstack([features, np.ones((len(features), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, rows: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) for each whole text.

    Stems and weights are learned from labelled documents for which ``train``
    (on ``doc_id``) holds: all, or about ``rows`` of them, picked by a hash of
    the id. Labels that are NULL teach nothing; a document with several labels
    counts for each. Without labels of both sorts the fixed words and weights
    are used. NULL and empty texts get the score of a text without any match.
    All columns are kept; ``score`` and ``predicted`` are replaced if there.
    Scoring needs no shuffle; the labels of the sample are broadcast, about
    ``rows`` short lines.
    """
    marked = labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("long").alias("toxic"))
    number = marked.count()
    sampled = marked.where(share_of("doc_id") < min(1.0, rows / max(number, 1)))
    sample = docs.select("doc_id", "text").join(F.broadcast(sampled), "doc_id")
    insults = stem_weights(sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults, THREATS)
        for batch, texts in batches_of(batches, "text"):
            found = [grammar.features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "features"])

    # At most about `rows` short vectors.
    seen = sample.mapInArrow(learn, "toxic long, features array<double>").toArrow()
    y = np.array(seen.column("toxic").to_pylist(), float)
    if 0 < y.sum() < len(y):
        weights = fit(np.array(seen.column("features").to_pylist()), y)
    else:
        weights = np.array([1.0, 1.5, 0.2, 0.2, 1.0, 1.5, 0.2, 0.2, 1.0, 0.5, -3.0])
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults, THREATS)
        for batch, texts in batches_of(batches, "text"):
            x = np.array([grammar.features(t) for t in texts]).reshape(batch.num_rows, -1)
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))) if len(x) else np.zeros(0)
            made = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "score", "predicted"])

    chosen = docs.select(*keep)
    schema = StructType([*chosen.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return chosen.mapInArrow(run, schema)
