"""Operators 2, 3, 4, 5, 8, 9 and the pipeline against brute force."""

import heapq
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerflow.llm.common import Sieve, keyed, without
from ledgerflow.llm.components import components
from ledgerflow.llm.nearcopies import NearCopies, near_copies
from ledgerflow.llm.packing import CAPACITIES, best_packing, pack_documents, price
from ledgerflow.llm.sharding import schedule, shard_documents
from ledgerflow.llm.suffixes import SUFFIX, RepeatedStrings, multikey_order, remove_repeats
from ledgerflow.llm.templates import contamination, template_matches
from ledgerflow.llm.vectors import NearVectors, near_vectors

DATA = "/root/testdata/sf0.001"


def least_labels(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = least_labels({x for l in links for x in l}, links)
    assert all(got.get(n, n) == c for n, c in want.items())


def test_sieve_lets_the_set_pass(spark):
    numbers = [0, 1, -1, 5, 32767, 32768, Sieve.BITS - 1, Sieve.BITS, -(1 << 63), (1 << 63) - 1]
    sieve = Sieve(spark.createDataFrame([(n,) for n in numbers], "n long"), "n")
    assert sieve.passes(np.array(numbers, np.int64)).all()
    assert not sieve.passes(np.array([2, 3, 100], np.int64)).any()


# ---- near copies ------------------------------------------------------------

def shingle_set(text, width):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[i:] for i in range(width)]))


def brute_copies(rows, width, percent):
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None and shingle_set(t, width):
            sets[i].add(shingle_set(t, width))
    links = []
    for a in sets:
        for b in sets:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                links.append((a, b))
    return least_labels([i for i, _ in rows if i is not None], links)


@pytest.mark.parametrize("width,options", [(2, {}), (5, {"block": 3}), (2, {"block": 3, "rows": 1})])
def test_near_copies_equal_brute_force(spark, width, options):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120]))]
        for copy in range(rng.choice([1, 4, 12])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((family * 100 + copy, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "solo"), (904, "SOLO"), (905, "Été x"), (906, "été x"), (907, rows[3][1].upper()), (None, rows[3][1]), (903, "solo")]
    rows += [(908, "long " * 3000), (909, "long " * 2999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = near_copies(df, width, 80, **options).collect()
    want = brute_copies(rows, width, 80)
    assert len(got) == len(rows)
    sizes = defaultdict(set)
    for i, t in rows:
        sizes[i].add(len(shingle_set(t, width)))
    for r in got:
        assert r.n_shingles in sizes[r.doc_id]
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))


def test_near_copies_of_nothing(spark):
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bayes_limits_never_give_up_a_likely_pair():
    limits = NearCopies().limits
    assert all(a <= b for a, b in zip(limits, limits[1:])) and limits[-1] < 0.8 * NearCopies().size


# ---- vectors ----------------------------------------------------------------

@pytest.mark.parametrize("options", [{}, {"shard": 40, "cell": 30, "overlap": 4}])
def test_near_vectors_equal_brute_force(spark, options):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16))
    family = base[0] + 0.05 * rng.normal(size=(60, 16))
    pair = base[1:20] + 0.02 * rng.normal(size=(19, 16))
    vectors = np.vstack([base, family, pair, base[:3], 5 * base[3:4]]).astype(np.float32)
    rows = [(int(i) * 3, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [None] + [1.0] * 15), (5004, [float("nan")] * 16), (5005, [float("inf")] + [0.0] * 15)]
    odd = [(None, rows[0][1]), rows[4]]
    df = spark.createDataFrame(rows + bad + odd, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = least_labels([i for i, _ in rows], [(int(a) * 3, int(b) * 3) for a, b in np.argwhere(near)])
    got = near_vectors(df, **options).collect()
    assert len(got) == len(rows) + len(bad) + len(odd)
    for r in got:
        if r.vec_id is None or r.vec_id >= 5000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert (r.n_links, r.component_id) == (int(near[r.vec_id // 3].sum()), label[r.vec_id])
    assert {r.audit_recall for r in got} == {1.0}


def test_ids_with_several_vectors_keep_all_links(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert got == {(1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)}
    rng = np.random.default_rng(5)
    base = rng.normal(size=(50, 8))
    vectors = np.repeat(base, 3, axis=0) + 0.1 * rng.normal(size=(150, 8))
    vectors = np.vstack([vectors, vectors[:20]])
    ids = np.concatenate([rng.integers(0, 60, 100), rng.integers(200, 900, 50), rng.integers(0, 900, 20)])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = least_labels(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in np.argwhere(near)])
    first = {(int(i), v.tobytes()): n for n, (i, v) in reversed(list(enumerate(zip(ids, vectors))))}
    links = Counter()
    for n in first.values():
        links[int(ids[n])] += sum(bool(near[n, m]) for m in first.values())
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    got = near_vectors(df, shard=40, cell=30, overlap=4).collect()
    assert len(got) == len(ids)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], label[r.vec_id], r.vec_id == label[r.vec_id])


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(empty).count() == 0 and NearVectors().threshold == 0.95


# ---- repeated strings ---------------------------------------------------------

def brute_repeats(rows, length):
    count = Counter(b[p : p + length] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        text = (t or "").encode()
        mark = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if count[text[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(text)) if mark[k] and not (k and mark[k - 1]))
        out.append((i if i is not None else -1, len(text), sum(mark), runs, bytes(x for x, m in zip(text, mark) if not m)))
    return sorted(out)


@pytest.mark.parametrize("length,options", [(40, {"head": 20, "rows": 400, "hot": 3}), (60, {"head": 30})])
def test_repeats_equal_brute_force(spark, length, options):
    rng = random.Random(length)
    pool = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([30, 60, 90, 150]))) for _ in range(10)]

    def text():
        return "".join(rng.choice(pool)[rng.randint(0, 20) :] if rng.random() < 0.6 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 12)))

    rows = [(0, None), (1, ""), (2, "ab" * 300), (3, "x" * 50), (4, "ab" * 300), (None, pool[3] * 2)] + [(i, text()) for i in range(5, 90)]
    rows += [(90, rows[20][1]), (91, rows[21][1] + "z"), (7, rows[30][1]), (8, rows[8][1]), (92, "for " * 200), (93, "q" + "for " * 100)]
    rows += [(rows[8][0], rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, length, **options).collect())
    assert got == brute_repeats(rows, length)


def test_no_task_compares_a_token_of_very_many_contexts(spark):
    rng = random.Random(11)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    # A passage shorter than a repeated string, which all texts hold, and a longer one, which some of them hold.
    passage = noise(50)
    rows = [(i, noise(rng.randint(40, 80)) + passage + noise(rng.randint(40, 80))) for i in range(1500)]
    rows += [(i, noise(60) + rows[9][1][30:180] + noise(5)) for i in range(1500, 1530)]
    contexts, strings = [], []

    class Watched(RepeatedStrings):
        def matched(self, rows):
            contexts.extend(r["count"] for r in rows.groupBy("head").count().collect())
            return super().matched(rows)

        def strings(self, rows):
            strings.append(super().strings(rows).count())
            return super().strings(rows)

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in Watched(80, 40).removed(df).collect())
    assert got == brute_repeats(rows, 80)
    assert max(contexts, default=0) <= 1000
    # Only texts that share more than the passage have their strings compared one by one.
    assert 0 < strings[0] <= 32 * 41


def test_near_copies_of_a_crowded_token_bring_their_strings_once(spark):
    rng = random.Random(12)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    # Near copies: each differs from all others in one place, so most of its strings repeat; and rows of one id and text.
    base = noise(700)
    rows = [(i, base[:at] + noise(2) + base[at + 2 :]) for i in range(240) for at in [rng.randrange(len(base))]]
    rows += [(500, base[:300] + "zz" + base[302:])] * 25
    counts = []

    class Watched(RepeatedStrings):
        def strings(self, rows):
            counts.append(super().strings(rows).count())
            return super().strings(rows)

        def spread(self, rows):
            counts.extend([rows.count(), sum(r.n for r in rows.select((F.length("bytes") - 79).alias("n")).collect())])
            found = super().spread(rows)
            counts.append(found.count())
            return found

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in Watched(80, 40, hot=5).removed(df).collect())
    assert got == brute_repeats(rows, 80)
    contexts, places, strings, ranges = counts
    # One range for a context, not a row for each string; and strings that repeat in whole blocks are listed once.
    assert 0 < ranges <= contexts
    assert 0 < strings <= places / 2


def test_no_repeats(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 4, 30_000), rng.integers(0, 50, 30_000), rng.integers(0, 3, 30_000)]
    order = multikey_order(words, leaf=16)
    rows = list(zip(*[w[order] for w in words]))
    assert rows == sorted(rows) and sorted(order) == list(range(30_000))


PAIR = "4cc13723ae0ab14111d1d5b9fc4a260a", "c2e5f505e09a830779ebe6c1a459ed12"  # of one 32-bit hash


def test_texts_of_one_id_are_told_apart(spark):
    one, two = PAIR
    df = spark.createDataFrame([(None, one), (None, two), (1, one)], "doc_id long, text string")
    hashes = df.select(F.hash("text").alias("h")).distinct().count()
    parts = keyed(df).groupBy("text").agg(F.collect_set("part").alias("p")).collect()
    assert hashes == 1 and len({p for r in parts for p in r.p}) == 2
    assert {(r.doc_id, r.n_bytes - r.n_removed) for r in remove_repeats(df, 20, head=10).collect()} == {(None, 0), (None, 32), (1, 0)}
    bench = spark.createDataFrame([(7, one)], "item_id long, text string")
    assert sorted(r.n_items for r in contamination(df, bench).collect()) == [0, 1, 1]
    found = template_matches(df, bench).select("doc", "part")
    assert [r.text for r in without(df, found).collect()] == [two]


def test_repeated_rows_bring_their_anchors_once(spark, monkeypatch):
    rows = [(5, 1, 2, 9, b"p", [0, 30], 0, 0, 2), (6, 1, 2, 9, b"p", [200], 0, 0, 2)] * 300 + [(7, 1, 2, 9, b"q", [9], 0, 0, 1)]
    marked = spark.createDataFrame(rows, f"{SUFFIX}, mark int")
    frame, sizes = type(marked), []
    through = frame.mapInArrow

    def watched(self, *args):
        sizes.append({bytes(r.part): r.n for r in self.select("part", F.size("all").alias("n")).collect()})
        return through(self, *args)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    got = {bytes(r.part): (r.lo, r.hi, r.open) for r in RepeatedStrings(40, head=20).settled(marked).collect()}
    assert sizes == [{b"p": 2, b"q": 1}]
    assert got == {b"p": ([0, 200], [70, 240], []), b"q": ([], [], [7])}


# ---- packing ------------------------------------------------------------------

def test_packing_is_whole(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.choice([0, 5, 300, 2047, 2048, 5000, 40_000, 70_000])) for i in range(300)] + [(300, None), (None, "ab"), (3, "again"), (3, "again"), (301, "é" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin", F.lit("clash"))
    got = pack_documents(df, group=60).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.pack, r.bin].append(r)
    whole = Counter()
    for parts in bins.values():
        parts.sort(key=lambda r: r.place)
        assert parts[0].capacity in CAPACITIES and parts[0].used <= parts[0].capacity
        assert not [c for c in CAPACITIES if parts[0].used <= c < parts[0].capacity]
        ends = [b.place for b in parts[1:]] + [parts[0].used]
        assert parts[0].place == 0 and all(0 <= e - r.place - r.length <= 1 for r, e in zip(parts, ends))
        for r in parts:
            whole[r.doc_id] += r.length
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").encode())
    assert +whole == +want and {r.doc_id for r in got} == {i for i, _ in rows}
    assert pack_documents(df.limit(0)).count() == 0


def test_best_packing_is_no_dearer_than_one_size():
    sizes = np.array([3000, 3000, 2000, 1500, 900, 500, 100, 7000, 7000, 1000])
    lengths, bins = best_packing(sizes, CAPACITIES)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert sum(map(price, lengths)) <= len(sizes) * price(8192)


# ---- decontamination ------------------------------------------------------------

ITEM = "A farmer in the valley sold 12 kg of apples to Maria on Monday and kept 30 kg of pears for his brother Hans"


def test_templates(spark):
    other = "A farmer in the valley sold 45 g of apples to Olga on Friday and kept 7 miles of pears for his brother Emil"
    texts = {
        1: "Some words before. " + ITEM + " and some words behind it.",
        2: "Some words before. " + other + " and so on.",
        3: "Nothing that is in there at all, only other words of the same kind in another order",
        4: None, 5: "", 6: " ".join(ITEM.split()[:9]) + " then something else", 7: "1 2 3 4 5 6 7 8 9 10 11 12 13",
        8: "x " * 5000 + ITEM.upper(), 9: ITEM + ". " + other, 10: "five short words of item", 11: "say five short words of item twice",
    }
    docs = spark.createDataFrame([*texts.items(), (3, texts[3]), (None, ITEM)], "doc_id long, text string").withColumn("window", F.lit(1))
    bench = spark.createDataFrame([(70, ITEM), (71, None), (72, ""), (73, "five short words of item"), (70, ITEM)], "item_id long, text string")
    got = [(r.doc_id, r.contaminated, r["items"]) for r in contamination(docs, bench).collect()]
    assert len(got) == len(texts) + 2
    found = {i: items for i, _, items in got}
    assert found[1] == found[2] == found[9] == found[None] == [70] and found[10] == found[11] == [73]
    assert found[8] == [70]
    assert all(found[i] == [] for i in (3, 4, 5, 6, 7))
    assert contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in contamination(docs, bench.limit(0)).collect())


def test_slots_must_agree(spark):
    item = "then Bob gave 5 coins to Ann and later 5 coins to Bob and again 5 coins to Ann and also Bob took 5 coins"
    clash = "then Tim gave 6 coins to Sue and later 8 coins to Kim and again 9 coins to Joe and also Pat took 7 coins"
    docs = spark.createDataFrame([(1, "well " + item), (2, "well " + clash), (3, "well " + item.replace("5", "6").replace("Bob", "Tim"))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in contamination(docs, bench).collect()} == {1: True, 2: False, 3: True}


def test_copies_in_other_case_and_places(spark):
    names = "when Anna saw Bert and Carla met Dirk they asked Emma about Fred and Gina"
    german = "Der Bauer im Tal gab der Frau des Lehrers einen Korb mit Birnen aus dem Garten"
    texts = {
        1: "x " * 50 + ITEM.upper(), 2: "y " * 50 + ITEM.lower(), 3: 'He asked "What is the capital of France?" and left', 4: names.upper(),
        5: german.lower(), 6: "it cost 5. In the valley Maria sold 3 apples. Then", 7: "the colour of that house in Spain is red, they say in the valley",
    }
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    items = [(1, ITEM), (2, "What is the capital of France?"), (3, names), (4, german), (5, "In the valley Maria sold 3 apples.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r["items"], r.coverage) for r in contamination(docs, bench).collect()}
    assert found == {1: ([1], 1.0), 2: ([1], 1.0), 3: ([2], 1.0), 4: ([3], 1.0), 5: ([4], 1.0), 6: ([5], 1.0), 7: ([], 0.0)}


def test_items_of_slots_are_found(spark):
    sums = "Solve 3 x 2 + 5 x - 7 = 0 and 4 x 2 + 9 x - 1 = 0"
    names = "they are Anna, Bert, Carla, Dirk, Emma, Fred, Gina, Hugo, Ines, Jens and Kim"
    mixed = "The farmer then sold each of these boxes for 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29"
    other = mixed[: mixed.index("12")] + " ".join(str(n) for n in range(52, 70))
    texts = {1: f"Well. {sums} and so on", 2: f"Here {names} and more", 3: sums.replace("3 x", "8 x"), 4: "Solve 1 x 9 + 8 x - 6 = 3 and 2 x 7 + 1 x - 4 = 5",
             5: "some numbers 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29", 6: other, 7: "12 13 14 15 16 and none"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, sums), (2, names), (3, mixed), (4, "Solve 7 x 7 + 2 = 0")], "item_id long, text string")
    found = {r.doc_id: (r["items"], r.coverage) for r in contamination(docs, bench).collect()}
    assert found[1] == ([1], 1.0) and found[2] == ([2], 1.0)
    assert found[3][0] == [1] and found[5][0] == found[6][0] == [3]
    assert found[4] == found[7] == ([], 0.0)


# ---- sharding -------------------------------------------------------------------

def test_schedule_is_a_heap():
    rng = random.Random(9)
    cells = [(size, 0, n, size * n) for size, n in sorted(((rng.randint(1, 3000), rng.randint(1, 90)) for _ in range(60)), reverse=True)]
    cells = [(10**6, 0, 1, 10**6)] + cells
    heap = [(0.0, s) for s in range(5)]
    for size, _, n, _ in cells:
        for _ in range(n):
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, s))
    loads = Counter()
    for (size, *_), (_, _, ends, shards) in zip(cells, schedule(cells, 5)):
        for s, n in zip(shards, np.diff([0, *ends])):
            loads[s] += size * int(n)
    assert sorted(loads.values()) == sorted(int(load) for load, _ in heap)


def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, "a" * rng.randint(0, 400) + str(rng.randint(0, 150))) for i in range(900)]
    rows += [(2000 + i, "hot text") for i in range(400)] + [(3000, None), (3001, None), (3002, ""), (None, "n"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    got = shard_documents(df, cell=50).collect()
    assert len(got) == len(rows)
    by_id, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        by_id[r.doc_id].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = defaultdict(set)
    for i, t in rows:
        if i != 5 and i is not None:
            homes[t] |= by_id[i]
    assert all(len(h) == 1 for h in homes.values())
    assert sum(loads.values()) == sum(len((t or "").encode()) + 1 for _, t in rows)
    assert max(loads.values()) <= max(400 * 9, sum(loads.values()) / 16 + 402)
    assert shard_documents(df.limit(0)).count() == 0


# ---- pipeline ---------------------------------------------------------------------

def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = random.Random(12)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()

    def prose(n=80):
        return " ".join(rng.choice(words) for _ in range(n))

    near = prose(200)
    rows = [(i, prose()) for i in range(40)]
    rows += [(100, near), (101, near), (102, near + " tail"), (110, prose(20) + " " + ITEM), (120, "you idiot you moron " + prose(10))]
    rows += [(130, "write to a.b@c.org now " + prose()), (140, None), (141, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"doc": F.lit("clash"), "score": F.lit(1)})
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(120, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "packing"]
    left = spark.read.parquet(f"{folder}/documents.parquet")
    gone = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, folder)
        assert after.columns == docs.columns
        gone.append({r.doc_id for r in left.collect()} - {r.doc_id for r in after.collect()})
        left = after
    assert gone == [{120}, {101, 102}, {110}, set()]
    masked = {r.doc_id: r for r in left.collect()}[130]
    assert masked.text.startswith("write to <email> now ") and masked.n_chars == len(masked.text)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows} - {101, 102, 110, 120}
