import json

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import jsontext as J


@pytest.mark.parametrize("text,want", [
    ('{"a":1} x', None), ("[]", "[]"), ("null", "null"), ("1,2", None), ("{bad", None), ("", None), ("1],[2", None), ("1}", None),
    (' {"a": [1, {"b": "c"}]} ', '{"a":[1,{"b":"c"}]}'), ('"x"', '"x"'), ('{"a":1,"a":2}', '{"a":2}'), ('1,"v2":2', None),
])
def test_strict_json(one, text, want):
    assert one(F.to_json(J.strict_json(F.lit(text)))) == want


def test_exact_json_keeps_the_last_repeated_key(one):
    assert one(F.to_json(J.strict_json(F.lit('{"a":1,"a":{"b":1,"b":2}}'), exact=True))) == '{"a":{"b":2}}'
    assert one(F.to_json(J.json_or_default(F.lit("{bad"), "{}", exact=True))) == "{}"


@pytest.mark.parametrize("text", ["1.5", "2.0", "1e7", "1e16", "123456789.25", "1e-5", "0.0001", "-3.25", "1e20", "1.5e300", "12345678901234567.0"])
def test_numbers_as_text(one, text):
    assert one(J.variant_text(F.parse_json(F.lit(text)))) == str(json.loads(text))


def test_variant_text(one):
    v = lambda t: J.variant_text(F.parse_json(F.lit(t)))
    assert one(v("true"), v("false"), v("null"), v('""'), v("12"), v('"x"')) == ("True", "False", None, "", "12", "x")


def test_merge_metadata(one):
    base = J.as_variant_map(F.parse_json(F.lit('{"a":1,"b":{"c":[1]}}')))
    merged = J.merge_metadata(base, {"a": F.lit("new"), "n": F.lit(None).cast("string")}, {"d": F.lit("")})
    assert json.loads(one(J.metadata_text(merged))) == {"a": "new", "b": {"c": [1]}, "n": None}
    merged = J.merge_metadata(base, {}, {"a": F.lit("dir")})
    assert json.loads(one(J.metadata_text(merged))) == {"a": "dir", "b": {"c": [1]}}
    assert one(J.as_variant_map(F.parse_json(F.lit("[1]")))) is None


def test_quote(one):
    text = "".join(chr(i) for i in range(0, 40)) + '\\"/\x7f é😀'
    assert one(J.json_quote(F.lit(text))) == json.dumps(text, ensure_ascii=False)
    members = {"b": F.lit("x"), "a": F.lit(None).cast("string"), "r": F.lit("[1]")}
    assert one(J.sorted_json(members, ("r",))) == '{"a": null, "b": "x", "r": [1]}'


def test_repeated_keys_stay_on_the_jvm(spark):
    rows = spark.createDataFrame([('{"a": 1, "a": {"b": 2, "b": [3]}}',)], "t string").select(J.strict_json(F.col("t")).alias("v"))
    assert rows.select(F.to_json("v")).first()[0] == '{"a":{"b":[3]}}'
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
