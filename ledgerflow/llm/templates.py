"""Operator 5: benchmark decontamination by template canonicalisation and slot consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import SPACE, Sieve, give_back, keyed, mixed, pieces, powers, span_hashes, word_spans

WINDOW = 8  # template tokens that are matched together
COVERAGE = 0.5  # share of an item's windows that a document must hold
CONFLICTS = 0.5  # share of an item's slot values that may be filled in more than one way

# Units that a number may carry, fixed values.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros pound pounds percent degrees mph kmh hz w watts volts"
).split()
TEMPLATE, LOWERED, WORDS = range(3)  # forms of a window: typed slots, no slots for names, no slots
NUM, UNIT, NAME = (np.uint64(k) for k in (0x6E756D, 0x756E6974, 0x6E616D65))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True  # bytes of letters beyond ASCII
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;"]] = True


class Template:
    """Template tokens of several texts: hash, slot value (0 for a literal), lower-cased word and the text's number of each."""

    def __init__(self, texts: list[bytes]):
        data, starts, ends, owner = word_spans(texts, SPACE)
        low = data.copy()
        low[_UPPER[data]] += 32
        # Capital letters of the Latin-1 range are the byte 0xC3 and one of 0x80 to 0x9E.
        wide = np.zeros(len(data), bool)
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[wide] += 32
        letter, digit = _LOWER[low], _DIGIT[low]
        kept = letter | digit
        # A word is its letters and digits; one without any is dropped.
        inner = np.concatenate([[0], np.cumsum(kept)])
        some = inner[ends] > inner[starts]
        starts, ends, owner = starts[some], ends[some], owner[some]
        word = span_hashes(low[kept], inner[starts], inner[ends])
        digits, letters = (np.concatenate([[0], np.cumsum(x)]) for x in (digit, letter))
        n_digit, n_letter = digits[ends] - digits[starts], letters[ends] - letters[starts]
        number = (n_digit > 0) & (n_letter <= 2)
        capitals = np.concatenate([[0], np.cumsum(_UPPER[data] | wide)])
        first = np.searchsorted(np.flatnonzero(kept), starts)
        spot = np.flatnonzero(kept)[first] if len(starts) else starts
        initial = _UPPER[data[spot]] | (wide[np.minimum(spot + 1, len(data) - 1)] & (data[spot] == 0xC3))
        # A capital that opens a sentence or stands in a word of capitals makes no name.
        alone = (capitals[ends] - capitals[starts] == 1) & (n_letter > 1)
        opens = np.ones(len(starts), bool)
        opens[1:] = (owner[1:] != owner[:-1]) | _END[data[ends[:-1] - 1]] | (data[starts[1:] - 1] == 10)
        name = initial & alone & ~opens & ~number
        unit = np.zeros(len(starts), bool)
        unit[1:] = number[:-1] & (owner[1:] == owner[:-1]) & np.isin(word[1:], _UNIT_HASHES) & ~number[1:]
        self.hashes = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, word)))
        self.slots = np.where(number | unit | name, word | np.uint64(1), np.uint64(0))
        self.plain = np.where(name, word, self.hashes)  # names are words like others
        self.counted = np.where(name, np.uint64(0), self.slots)
        self.words = word
        self.owner = owner

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows in one form or two: hashes, first tokens, forms and which first tokens have a template.

        The template has slots for numbers, units and names; a second form takes
        names as lower-cased words, as it depends on the surroundings and on case
        what is a name, and is told where it differs. A form with literals in less
        than half of its places would match nearly anything by its slots and is
        left out; if that holds for the second one, a third has words alone. The
        last two depend on the window's words only: a copy has the same.
        """
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, bool)
        at = np.arange(n - width + 1)
        at = at[self.owner[at] == self.owner[at + width - 1]]
        few = (np.concatenate([[0], np.cumsum(x == 0)]) for x in (self.slots, self.counted))
        typed, known = (f[at + width] - f[at] for f in few)
        # A unit that opens the window is a word: its number is outside.
        known += self.plain[at] == UNIT
        typed, known = 2 * typed >= width, 2 * known >= width
        template = rolled(self.hashes, at, width)
        words = np.where(known, rolled(self.plain, at, width, np.where(self.plain[at] == UNIT, self.words[at], self.plain[at])), rolled(self.words, at, width))
        other = ~typed | (words != template)
        return (
            np.concatenate([template[typed], words[other]]), np.concatenate([at[typed], at[other]]),
            np.concatenate([np.full(typed.sum(), TEMPLATE, np.int8), np.where(known, LOWERED, WORDS)[other].astype(np.int8)]),
            np.concatenate([typed[typed], typed[other]]),
        )

    def values(self, at: int, width: int, form: int) -> np.ndarray:
        """Slot values of a window in order."""
        if form == WORDS:
            return self.slots[:0]
        values = (self.slots if form == TEMPLATE else self.counted)[at : at + width]
        if form == LOWERED and self.plain[at] == UNIT:
            values = values[1:]
        return values[values != 0]


def rolled(tokens: np.ndarray, at: np.ndarray, width: int, first: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the ``width`` tokens from each place of ``at`` on; ``first`` stands for the tokens in these places."""
    up, down = powers(len(tokens) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(tokens) * up[: len(tokens)], dtype=np.uint64)])
    total = (sums[at + width] - sums[at]) * down[at]
    if first is not None:
        total += mixed(first) - mixed(tokens[at])
    return mixed(total + np.uint64(width))


_UNIT_HASHES = np.zeros(0, np.uint64)
_joined, _starts, _ends, _ = word_spans([u.encode() for u in UNITS])
_UNIT_HASHES = span_hashes(_joined, _starts, _ends)


def template_windows(texts: DataFrame, keys: list[str], widths: list[int] | int, sieve: Sieve | None = None) -> DataFrame:
    """``(keys, window, at, of, typed, typed_of, slots, width)``: template windows of each text, those that pass the sieve.

    ``widths`` lists the window lengths; a single one is cut down to the tokens
    of a shorter text. ``at`` is the window's first token, ``of`` the number of
    windows of its text, ``typed`` tells windows that have a template from those
    of plain words, ``typed_of`` counts the former in the text, ``slots`` has
    the row's slot values in order. A window has a row for each of its forms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for first, part in pieces(batch, "text"):
                template = Template(part)
                begin = np.searchsorted(template.owner, np.arange(len(part)))
                tokens = np.bincount(template.owner, minlength=len(part))
                if isinstance(widths, int):
                    shapes = sorted({min(widths, int(n)) for n in tokens if n})
                else:
                    shapes = widths
                for width in shapes:
                    made = template.windows(width)
                    if isinstance(widths, int):
                        own = np.minimum(tokens[template.owner[made[1]]], widths) == width
                        made = [m[own] for m in made]
                    hashes, at, form, typed = made
                    # Each window has its template's form, or else one of the others.
                    lead = (form == TEMPLATE) | ~typed
                    of = np.bincount(template.owner[at[lead]], minlength=len(part))
                    typed_of = np.bincount(template.owner[at[lead & typed]], minlength=len(part))
                    if sieve is not None:
                        good = sieve.passes(hashes)
                        hashes, at, form, typed = (m[good] for m in made)
                    if not len(at):
                        continue
                    owner = template.owner[at]
                    slots = [template.values(a, width, f) for a, f in zip(at.tolist(), form.tolist())]
                    rows = batch.slice(first, len(part)).select(keys).take(pa.array(owner))
                    made = [
                        pa.array(hashes.view(np.int64)), pa.array((at - begin[owner]).astype(np.int32)), pa.array(of[owner].astype(np.int32)),
                        pa.array(typed), pa.array(typed_of[owner].astype(np.int32)),
                        pa.array([s.view(np.int64).tolist() for s in slots], pa.list_(pa.int64())),
                        pa.array(np.full(len(at), width, np.int32)),
                    ]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *made], [*keys, "window", "at", "of", "typed", "typed_of", "slots", "width"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema)
    made = "window long, at int, of int, typed boolean, typed_of int, slots array<long>, width int"
    return texts.select(*keys, "text").mapInArrow(run, f"{fields}, {made}")


def template_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, coverage: float = COVERAGE, conflicts: float = CONFLICTS) -> DataFrame:
    """``(doc, part, doc_id, item_id, coverage, n_slots, n_conflicts)`` of each document and benchmark item it holds.

    Numbers, names (capitalised words within a sentence) and units behind
    numbers become typed slots. Windows of ``width`` template tokens are matched
    by their hash, and by a second one with names as lower-cased words, so that
    case and surroundings hide no copy; one with slots in more than half of its
    places is matched by its words alone. An item with fewer tokens is one
    window, and a window is held if either hash is found. A document holds an item if it has ``coverage`` of its windows, or
    of those with a template, so that other values in the rest do not hide it, and
    at most a share ``conflicts`` of the item's slot values are filled in
    several ways there. Both are judged over the whole document and
    for each shift between document and item, so that a question that comes
    twice with other numbers does not contradict itself.

    NULL or empty texts hold nothing, as items and as documents. Items whose
    text repeats are all told. The benchmark's windows are never broadcast, only
    a sieve of fixed size, which keeps most windows of documents from the join.
    """
    items = durable(template_windows(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), ["item_id"], width), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most `width` numbers
    texts = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    own = template_windows(texts, ["doc_id", "doc", "part"], widths, Sieve(items, "window"))
    item = items.select("window", "item_id", *[F.col(c).alias(f"item_{c}") for c in ("at", "of", "typed", "typed_of", "slots")])
    shift = F.col("at") - F.col("item_at")
    scope = F.explode(F.array(F.lit(None).cast("int"), shift))
    key = ["doc", "part", "doc_id", "item_id", "scope"]
    told = [f"item_{c}" for c in ("at", "of", "typed", "typed_of", "slots")]
    hits = durable(own.join(item, "window").withColumn("scope", scope).select(*key, *told, "slots"), "hits")
    each = hits.groupBy(*key, "item_at").agg(*[F.max(c).alias(c) for c in ("item_of", "item_typed", "item_typed_of")])
    typed = F.try_divide(F.sum(F.col("item_typed").cast("int")), F.max("item_typed_of"))
    held = each.groupBy(*key).agg(F.greatest(F.count("*") / F.max("item_of"), typed).alias("coverage"))
    held = held.where(F.col("coverage") >= coverage)
    pairs = hits.select(*key, F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    filled = pairs.groupBy(*key, F.col("s.item_slots").alias("slot")).agg(F.count_distinct("s.slots").alias("ways"))
    slots = filled.groupBy(*key).agg(F.count("*").alias("n_slots"), F.sum((F.col("ways") > 1).cast("long")).alias("n_conflicts"))
    same = [held[k].eqNullSafe(slots[k]) for k in key]
    both = held.join(slots, F.expr("true") & same[0] & same[1] & same[2] & same[3] & same[4], "left").select(
        *[held[k] for k in key], "coverage", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts")
    )
    good = both.where(F.col("n_conflicts") <= F.col("n_slots") * conflicts)
    best = F.max_by(F.struct("coverage", "n_slots", "n_conflicts"), F.struct("coverage", -F.col("n_conflicts"), "n_slots")).alias("b")
    return good.groupBy("doc", "part", "doc_id", "item_id").agg(best).select("doc", "part", "doc_id", "item_id", "b.*")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, contaminated, n_items, items, coverage)`` of each document; ``items`` in order, ``coverage`` the highest."""
    found = template_matches(docs, benchmark, **options).groupBy("doc", "part").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage")
    )
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "doc", "part")
    told = rows.join(found, ["doc", "part"], "left")
    items = F.coalesce("items", F.array().cast("array<long>"))
    return told.select(
        "doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )
