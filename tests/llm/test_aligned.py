"""Operators 11 to 13 against brute force: alignment, license scans, whitening."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm.alignment import Vocabularies, align_tokens, divide, tokenizer_files
from ledgerflow.llm.license_rules import BASE
from ledgerflow.llm.licenses import license_report, scan_licenses, signature_rules
from ledgerflow.llm.whitening import leading_pairs, minres, whiten

tokenizers = pytest.importorskip("public_tokenizers")
PATHS = [tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TEXTS = [
    (1, "The  cat sat on the mat. \n  Über 日本語 の café\tx   y "), (2, None), (3, ""), (4, " "), (5, "  two"), (6, "<|endoftext|> <s> </s> <unk> ▁x"),
    (7, "the cat"), (7, "the cat"), (None, "the cat sat"), (8, "=" * 3000 + " " + "ab" * 2000), (9, "nul \0 in it"), (10, "long " * 30_000), (11, "the\n\n  end\n "),
]


def aligned_by_hand(texts):
    v = Vocabularies(*tokenizer_files(*PATHS))
    rows, held = [], Counter()
    for doc, text in texts:
        a = v.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = v.b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(v.bytes_a[i] for i in a) != whole or b"".join(v.bytes_b[i] for i in b) != whole:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(v.bytes_a[i]) for i in a]), np.cumsum([len(v.bytes_b[i]) for i in b])
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            m, n = int(np.searchsorted(ends_a, cut, "right")), int(np.searchsorted(ends_b, cut, "right"))
            groups.append((a[i:m], b[j:n]))
            i, j = m, n
        links = Counter()
        for x, y in groups:
            for p, k in Counter(x).items():
                for q, l in Counter(y).items():
                    links[p, q] += k * l
        rows.append((doc, a, b, groups, links))
        held.update(links.keys())
    top = Counter()
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    return [
        (
            doc, len(a), len(b), len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == top[k[0]]),
            sum(n * held[k] for k, n in links.items()), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups),
        )
        for doc, a, b, groups, links in rows
    ]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("limit", [1 << 20, 40, 0])
def test_alignment(spark, limit):
    from ledgerflow.llm.common import share_path

    share_path(spark)
    docs = spark.createDataFrame([(d, t, 5) for d, t in TEXTS], "doc_id long, text string, part int").repartition(3)
    got = align_tokens(docs, *PATHS, limit=limit).collect()
    assert in_order(got) == in_order(aligned_by_hand(TEXTS))
    assert align_tokens(docs.limit(0), *PATHS, limit=limit).collect() == []


def test_divide_finds_every_shared_end():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(2, 60))
        shared = np.append(np.sort(rng.choice(n, rng.integers(0, n), replace=False)), n) if n else np.array([n])
        a = np.unique(np.append(rng.choice(np.arange(1, n + 1), rng.integers(1, n + 1)), n))
        b = np.unique(np.append(rng.choice(np.arange(1, n + 1), rng.integers(1, n + 1)), n))
        one = np.array([0])
        last_a, last_b = divide(a, b, one, np.array([len(a)]), one, np.array([len(b)]))
        both = np.intersect1d(a, b)
        assert (a[last_a - 1] == both).all() and (b[last_b - 1] == both).all()
        assert len(shared)


LICENSED = [
    (1, "Released under the MIT License, see the GNU General Public License version 2 or the Apache License, Version 2.0."), (2, None), (3, ""),
    (4, "CC BY cc-by CC  BY 4.0 xcc by"), (5, "nothing here"), (6, "mité license MIT-LICENSE mit\nlicense"), (7, "SPDX-License-Identifier: GPL-2.0-or-later"),
    (None, "http://creativecommons.org/licenses/by-sa/4.0/"), (8, "Apache License " * 40_000), (9, "cc by cc by"), (9, "cc by cc by"),
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_license_base_and_labels(spark):
    from ledgerflow.llm.common import share_path

    share_path(spark)
    docs = spark.createDataFrame([(d, t, "x") for d, t in LICENSED], "doc_id long, text string, found string").repartition(2)
    got = in_order(license_report(docs).collect())
    want = []
    for doc, text in LICENSED:
        words = words_of(text)
        places = [(i, label) for label, phrase in BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        want.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert [r[:6] for r in got] == [r[:6] for r in in_order(want)]
    labels = {r[0]: r[6] for r in got}
    assert labels[1] == "apache,apache-2.0,gpl,gpl-2.0,mit"
    assert labels[4] == "cc-by,cc-by-4.0" and labels[5] == "" and labels[6] == "mit"
    assert labels[7] == "spdx-gpl-2.0-or-later" and labels[None] == "url-cc-by-sa" and labels[10] == "mit"
    assert all(0 <= r[7] <= 1 for r in got) and {r[7] for r in got if not r[6]} == {0.0}
    assert license_report(docs.limit(0)).collect() == []


def test_license_overlaps_by_plain_comparison(spark):
    """Every detection against every other one, and every rule against every text without the prefilter."""
    from ledgerflow.llm.common import share_path

    share_path(spark)
    rules = signature_rules()
    assert len(rules) > 200
    texts = [(i, t) for i, (_, t) in enumerate(LICENSED) if t and len(t) < 1000]
    texts += [(100 + i, r.pattern) for i, r in enumerate(rules) if not re.search(r"[\[(?{]", r.pattern)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    order = {(r.label, r.level, r.base, r.pattern): i for i, r in enumerate(rules)}
    assert len(order) == len(rules)
    for row in scan_licenses(docs).collect():
        words = words_of(dict(texts)[row.doc_id])
        joined = " " + " ".join(words) + " "
        found = []
        for i, r in enumerate(rules):
            for m in re.finditer("(?<= )(?:" + r.pattern + ")(?= )", joined):
                start = joined[:m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" ") + 1, r.level, i))
        want = sorted(
            (rules[i].label, s, e, level, rules[i].base, not any(
                s2 <= s and e <= e2 and (l2 > level or l2 == level and (e2 - s2 > e - s or e2 - s2 == e - s and j < i))
                for s2, e2, l2, j in found if j != i or (s2, e2) != (s, e)
            )) for s, e, level, i in found
        )
        assert sorted((d.label, d.start, d.end, d.level, d.base, d.kept) for d in row.found) == want


def dense(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    value, axis = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - sums) ** 2).sum(axis=1), c, value[::-1], axis[:, ::-1]


def test_whitening(spark):
    from ledgerflow.llm.common import share_path

    share_path(spark)
    rng = np.random.default_rng(5)
    good = (rng.standard_normal((400, 24)) * np.linspace(0.2, 2, 24)).astype(np.float32)
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(good)]
    rows += [(0, rows[0][1], "again"), (None, rows[1][1], "no id")]
    odd = [(900, None, ""), (901, [], ""), (902, [math.nan] * 24, ""), (903, [math.inf] + [0.0] * 23, ""), (904, [None] + [0.0] * 23, ""), (905, [1.0] * 5, "")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, component string").repartition(3)
    got = whiten(frame).collect()
    n, deviation, c, value, axis = dense([v for _, v, _ in rows])
    assert len(got) == 8 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-12
    score = c @ axis[:, :8] / np.sqrt(value[:8])
    for k in range(8):
        mine = {r.vec_id: r for r in got if r.component == k + 1}
        assert abs(mine[0].explained / (value[k] / value.sum()) - 1) < 1e-12
        sign = np.sign(mine[0].whitened * score[0, k])
        for i in range(400):
            assert abs(mine[i].whitened * sign - score[i, k]) < 1e-9 and int(mine[i].deviation) == deviation[i]


@pytest.mark.parametrize("vectors, ranks", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]], 1), ([[0.0], [1.0]], 1), ([[0.0, 1.0], [1.0, 0.0], [3.0, 5.0]], 2)])
def test_whitening_of_few(spark, vectors, ranks):
    from ledgerflow.llm.common import share_path

    share_path(spark)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = whiten(frame).collect()
    assert len(got) == ranks * len(vectors)
    assert all(r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("width, wanted, kind", [(64, 8, "flat"), (300, 8, "close"), (200, 5, "twice"), (6, 8, "flat")])
def test_jacobi_davidson_reaches_double_precision(width, wanted, kind):
    rng = np.random.default_rng(width)
    basis = np.linalg.qr(rng.standard_normal((width, width)))[0]
    values = {"flat": np.linspace(1, 2, width), "close": 1 + 1e-3 * rng.random(width), "twice": np.repeat(np.arange(1.0, width / 2 + 1), 2)[:width]}[kind]
    matrix = (basis * values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    found, axes = leading_pairs(lambda q: matrix @ q, width, wanted)
    assert len(found) == min(wanted, width)
    np.testing.assert_allclose(found, np.sort(values)[::-1][: len(found)], rtol=1e-12)
    assert np.abs(matrix @ axes - axes * found).max() < 1e-12 * values.max()
    assert np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-12


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    right, shifts = rng.standard_normal((20, 3)), np.array([0.1, -0.7, 2.0])
    found = minres(lambda v: a @ v, right, shifts, lambda y: y, 60, 1e-12)
    for k in range(3):
        np.testing.assert_allclose((a - shifts[k] * np.eye(20)) @ found[:, k], right[:, k], atol=1e-7)


def test_digest_of_groups(spark):
    """What the query derives: the digest of the written groups, nothing for a text without tokens."""
    from ledgerflow.llm.common import share_path

    share_path(spark)
    docs = spark.createDataFrame([(1, "the cat"), (2, "")], "doc_id long, text string")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("d")
    got = {r.doc_id: (r.groups, r.d) for r in align_tokens(docs, *PATHS).select("doc_id", "groups", digest).collect()}
    assert got[2] == ("", "") and got[1][1] == hashlib.sha256(got[1][0].encode()).hexdigest()
