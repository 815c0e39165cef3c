"""Operators 1, 6, 7, 10: per-document results against brute force, the library or held-out accuracy."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerflow.llm.common import held_out
from ledgerflow.llm.language import identify
from ledgerflow.llm.pii import find_pii, mask_pii, pii_report
from ledgerflow.llm.tokens import Counter, Merges, count_tokens
from ledgerflow.llm.toxicity import events, score_toxicity

DATA = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return (sum(digits[0::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [
        None, "", "a@b.c@d.e x@y.com_z@w.org", "1.2.3.4.5.6.7.8 999.1.1.1 007.1.1.1 1.1.1.256.3.4", "9" * 5000, "1 " * 3000,
        "a.b" * 5000 + "@x." + "y." * 3000, "x@y.z " * 700, "+1 (234) 555-1234 +4912345 +++1 22 33 44 55", "\U0001f600é 4111111111111111",
    ]
    texts += ["".join(rng.choice("0123 4-5.@+ab()é\U0001f600") for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    parts = ["4111111111111111", "4111-1111 1111-1111", "10.0.0.1", "a@b.co", "+12345678", "+1-2", "5", " ", "-"]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii_report(df).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), repr(text)[:200]
        kinds = [s.split(":")[0] for s in want.split(",") if s]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]


def test_secrets_need_entropy_and_context(spark):
    github, aws = "ghp_" + "a1B2c3D4e5F6g7H8i9J0" + "k1L2m3N4o5P6q7R8", "AKIA" + "Z7Q2M4X9T1B6K3W8"
    texts = [
        f"use {github} here", f"{aws}", "AKIA" + "A" * 16, "password: x7Kq9Zt2Lm4Wp8Rv1", "title: x7Kq9Zt2Lm4Wp8Rv1", "password: aaaaaaaaaaaaaaa1aaaa",
        "password: correcthorsebatterystaple", "api_key=9f86d081884c7d659a2feaa0c55ad015", "token a.b@example1234567890.org", "x" * 100000 + " token " + "a1" * 100000,
        None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii_report(df).collect()}
    want = [f"key:4:{4 + len(github)}", f"key:0:{len(aws)}", "", "secret:10:27", "", "", "", "secret:8:40", "email:6:31", "", "", ""]
    assert [got[i] for i in range(len(texts))] == want
    assert {r.doc_id: r.text for r in mask_pii(df).collect()}[3] == "password: <secret>"


def test_added_spans_need_checksum_or_context(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 here", "IBAN DE88 3704 0044 0532 0130 00 here",
        "ssn 123-45-6789", "part 123-45-6789", "call (212) 555-1234", "size (212) 555-1234", None, "",
    ]
    df = spark.createDataFrame([(i, t, "kept", 7) for i, t in enumerate(texts)], "doc_id long, text string, pii string, _pii_base int")
    got = {r.doc_id: r.spans for r in pii_report(df).collect()}
    assert [bool(got[i]) for i in range(8)] == [True, False, True, False, True, False, False, False]
    masked = {r.doc_id: r for r in mask_pii(df.withColumn("_pii_spans", F.lit("own"))).collect()}
    assert {(r._pii_base, r._pii_spans, r.pii) for r in masked.values()} == {(7, "own", "kept")}
    assert find_pii(df).columns == df.columns and {r._pii_base for r in find_pii(df).collect()} == {7}
    assert masked[0].text == "IBAN <iban> here" and masked[1].text == texts[1] and masked[0].pii == "kept"
    assert masked[6].text is None and masked[7].text == ""
    assert pii_report(df.limit(0)).count() == 0


def test_tokens_equal_the_library(spark, documents):
    library = Tokenizer.from_file(BPE)
    odd = ["", None, "a<|endoftext|>b", "<|endoftext|>", "aaaaaaaaaaaaaa", "  \n\n  x", "don't  it's\t\t", " " * 50 + "a", "日本 \U0001f600\U0001f600"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + r.doc_id, r.text) for r in documents.collect()] + [(None, "x y"), (2, "a<|endoftext|>b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, BPE, 300).collect())
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i or -1, len((t or "").encode()), n, n > 300))
    assert got == sorted(want)


def test_long_texts_count_alike():
    counter, library = Counter(Merges(BPE)), Tokenizer.from_file(BPE)
    text = "".join(random.Random(1).choice("ab cdeéß1 ") for _ in range(60_000)) + "b" * 3000
    assert counter.long_text(text) == counter.count([text])[0] == len(library.encode(text).ids)


def test_language_on_held_out_documents(spark, documents):
    told = identify(documents, ~held_out()).join(documents.select("doc_id", "lang"), "doc_id").where("NOT train").collect()
    assert sum(r.lang == r.lang_pred for r in told) >= 0.95 * len(told) and all(0 < r.score <= 1 for r in told)


def test_language_edges(spark):
    rows = [(1, "aba aba abb", "x"), (5, "cdc cdd cdc", "y"), (9, "aba", None), (10, None, "x"), (11, "", "x"), (12, "123 !!", "y"), (None, "cdc", "x"), (9, "aba", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("train", F.lit(3))
    got = {(r.doc_id, r.train): (r.lang_pred, r.score) for r in identify(df, F.coalesce(F.col("doc_id") < 9, F.lit(False))).collect()}
    assert got[(9, False)][0] == "x" and got[(None, False)][0] == "y"
    assert got[(10, False)] == got[(11, False)] == got[(12, False)] == ("und", 0.0)
    nothing = identify(df, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and len(nothing) == len(rows)
    assert identify(df.limit(0), F.lit(True)).count() == 0


def test_grammar_composes():
    def told(words):
        kinds = {"you": "target", "not": "negation", "said": "report", "idiot": "insult", "kill": "threat", '"': "quote"}
        return [e for _, e in events([kinds.get(w, "other") for w in words.split()])]

    assert told("you are an idiot") == ["targeted_insult"]
    assert told("an idiot that you") == ["targeted_insult"]
    assert told("a plain idiot") == ["insult"]
    assert told("you are not an idiot") == ["negated_insult"]
    assert told("they said you are an idiot") == ["reported_insult"]
    assert told('" idiot " idiot') == ["reported_insult", "insult"]
    assert told("will kill you") == ["targeted_threat"]


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice("lorem ipsum dolor amet sit elit sed".split()) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[10] = rng.choice(["grumbol", "grumbix", "you idiot"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1001, "", "s"), (None, "idiot", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(1000, None), (None, 1)], "doc_id long, toxic int")
    scored = score_toxicity(docs, marks, ~held_out()).collect()
    assert len(scored) == len(rows) and set(scored[0].asDict()) == {"doc_id", "text", "score", "predicted"}
    by = {r.doc_id: r for r in scored}
    wrong = [i for i, t in labels if by[i].predicted != t]
    assert len(wrong) <= 6
    assert by[1000].score == by[1001].score and by[1000].predicted == 0 and by[None].predicted == 1
    # Without labels the fixed grammar stands in.
    plain = {r.doc_id: r.predicted for r in score_toxicity(docs, marks.limit(0), ~held_out()).collect()}
    assert plain[None] == 1 and plain[1001] == 0
    assert score_toxicity(docs.limit(0), marks, ~held_out()).count() == 0
