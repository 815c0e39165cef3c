import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import keys as K
from ledgerflow.functions.embedding import embed_column, probe_dimension
from ledgerflow.functions.text import blank_to_null, decode_keys, decode_text, field_text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text,want", [
    (None, "unknown"), ("", "unknown"), ("  ", "unknown"), ("0", "0"), ("　Doc 1　", "doc-1"), ("a|b", "a-b"),
    ("ΑΣ ", "ας"), ("é", "e-"), ("x\U0001f600y", "x-y"), ("A_b-C", "a_b-c"), ("\x1fq\x85", "q"), ("été", "été"),
])
def test_key_part(one, text, want):
    assert one(K.key_part(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("value,want", [
    ("0", "unknown"), ("0.0", "unknown"), ("false", "unknown"), ("[]", "unknown"), ("{}", "unknown"), ("null", "unknown"),
    ('""', "unknown"), ('"0"', "0"), ("true", "true"), ("7", "7"), ("1.5", "1-5"), ("2.0", "2-0"), ('" A b"', "a-b"),
    ("1e20", "1e-20"), ("1e7", "10000000-0"),
])
def test_variant_key_part(one, value, want):
    assert one(K.variant_key_part(F.parse_json(F.lit(value)))) == want


def test_document_and_vector_keys(one):
    meta = F.create_map(F.lit("source"), F.lit("A b").cast("variant"), F.lit("chunk_id"), F.lit(0).cast("variant"))
    got, vec = one(K.chunk_document_key(F.lit("My Coll"), F.lit("téxt"), meta), K.vector_id(F.lit("doc_1")))
    assert got == "doc_" + sha(f"My Coll|a-b|unknown|unknown|unknown|{sha('téxt')[:16]}")
    assert vec == "vec_" + sha("doc_1")


NASTY = 'q "x" \\ \n\t\x01   /é\x7f'


def test_chat_keys(one):
    none = F.lit(None).cast("string")
    s, u, a, q, w = (F.lit(x) for x in ("s1", "u1", "a1", NASTY, "ans"))
    explicit = one(K.chat_idempotency_key(F.lit("mine"), s, u, a, q, w))
    pair = one(K.chat_idempotency_key(none, s, u, a, q, w))
    content = one(K.chat_idempotency_key(F.lit(""), s, u, none, q, w))
    assert explicit == "mine"
    raw = json.dumps({"message_pair": "s1|u1|a1"}, ensure_ascii=False, sort_keys=True)
    assert pair == "rag:idem:qa_turn:" + sha(raw + "|s1|u1|a1")
    raw = json.dumps({"session_id": "s1", "question": NASTY, "answer": "ans"}, ensure_ascii=False, sort_keys=True)
    assert content == "rag:idem:qa_turn:" + sha(raw + "|s1")


def test_chunk_key_and_names(one):
    none = F.lit(None).cast("string")
    key = one(K.chunk_idempotency_key(none, F.lit("c"), F.lit("d"), F.lit("v")))
    raw = json.dumps({"collection_name": "c", "document_key": "d", "vector_id": "v"}, sort_keys=True)
    assert key == "rag:idem:index_chunk:" + sha(raw + "|v")
    assert one(K.retry_count_key(F.lit("s"), F.lit("1-0"))) == "rag:retry:s:1-0"
    assert one(*[K.dead_letter_stream(F.lit(x)) for x in ("rag:events", "rag:index-events", "z")]) == (
        "rag:events:dlq", "rag:index-events:dlq", "z:dlq")


def test_backoff(one):
    got = [one(K.backoff_seconds(F.lit(a), 1.0, 30.0)) for a in range(0, 8)]
    assert got == [1, 1, 2, 4, 8, 16, 30, 30]
    assert one(K.backoff_seconds(F.lit(1), 90.0, 30.0)) == 90.0


def test_embedding_defaults(one):
    none = F.lit(None)
    assert one(K.embedding_model(F.lit(" m ")), K.embedding_model(F.lit("  "), "cfg"), K.embedding_model(none.cast("string"))) == ("m", "cfg", "unknown")
    vec = F.array(F.lit(0.0), F.lit(0.0))
    assert one(K.embedding_dimension(none.cast("int"), vec), K.embedding_dimension(F.lit(9), vec)) == (2, 9)


def test_iso_timestamp(spark):
    rows = [(datetime(2024, 1, 2, 3, 4, 5),), (datetime(2024, 1, 2, 3, 4, 5, 60),)]
    got = [r[0] for r in spark.createDataFrame(rows, "t timestamp").select(K.iso_timestamp(F.col("t"))).collect()]
    assert sorted(got) == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000060+00:00"]


def test_text_fields(one, spark):
    assert one(decode_text(F.lit(b"a\xffb")), decode_text(F.lit("�".encode()))) == ("ab", "�")
    fields = F.create_map(F.lit("a"), F.lit(b"x"), F.lit("e"), F.lit(b""))
    assert one(field_text(fields, "a"), field_text(fields, "b", "d"), blank_to_null(field_text(fields, "e"))) == ("x", "d", None)
    binary = F.create_map(F.lit(b"k\xff"), F.lit(b"v"))
    assert one(F.map_keys(decode_keys(binary))) == ["k"]


def test_embedder(spark):
    class Dummy:
        def embed_query(self, text):
            return [0.0, 0.0, float(len(text))]

    rows = spark.createDataFrame([("abc",), ("",)], "t string")
    assert sorted(r[0] for r in rows.select(embed_column(Dummy, F.col("t"))).collect()) == [[0, 0, 0], [0, 0, 3]]
    assert probe_dimension(Dummy) == 3 and probe_dimension(lambda: None) == 0

    class Batched(Dummy):
        def embed_documents(self, texts):
            return [[1.0, float(len(t))] for t in texts]

    assert sorted(r[0] for r in rows.select(embed_column(Batched, F.col("t"))).collect()) == [[1, 0], [1, 3]]
