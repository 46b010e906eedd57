"""Nested traits: leaves and back, properties, templates."""

import json

import pytest
from pyspark.sql import functions as F
from recollect.operators import nested

SAID = [
    '{"a": {"b": [1, {"c": null}], "d.e": "x\\"y"}, "f": [], "g": {}, "h": true, "i": 1.50}', "7", "null", "[]", '[[1, 2], [], [{"k": "é"}]]', '"text"', '{"": {"": 1}}', None,
    '{"deep": ' + '{"n": ' * 5 + "1" + "}" * 6,
]


@pytest.fixture
def traits(spark):
    return spark.createDataFrame(list(enumerate(SAID)), "id int, s string").select("id", F.parse_json("s").alias("traits"))


def test_leaves_and_back(traits):
    found = nested.leaves(traits, ["id"], "traits")
    assert {(r["name"], r["kind"], r["value"]) for r in found.where("id = 0").collect()} == {
        ("a.b.0", "bigint", "1"), ("a.b.1.c", "null", "null"), ("a.d.e", "string", '"x\\"y"'), ("f", "array", "[]"), ("g", "object", "{}"), ("h", "boolean", "true"), ("i", "decimal", "1.5")}
    back = {r["id"]: r["t"] for r in nested.assembled(found, ["id"]).select("id", F.to_json("traits").alias("t")).collect()}
    assert {i: json.loads(t) for i, t in back.items()} == {i: json.loads(s) for i, s in enumerate(SAID) if s is not None}
    assert nested.leaves(traits.where("id = 7"), ["id"], "traits").count() == 0
    assert nested.assembled(found.limit(0), ["id"]).count() == 0


def test_properties_of_nested_traits(spark, traits):
    rows = traits.where("id in (0, 7)").select(F.lit("A").alias("observer_pk"), F.col("id").cast("string").alias("entity_pk"), F.lit("person").alias("entity_type"), F.lit(1).alias("ts"), "traits")
    got = {r["property_name"]: (r["property_value"], None if r["property_number"] is None else float(r["property_number"])) for r in nested.property_rows(rows).collect()}
    assert got == {"a.b.0": ("1", 1.0), "a.d.e": ('x"y', None), "h": ("true", None), "i": ("1.5", 1.5)}


def test_templates(spark):
    df = spark.createDataFrame([('{"user": {"name": "Ann", "mails": ["a@x", "b@x"], "age": 0, "none": null}}',), (None,)], "s string").select(F.parse_json("s").alias("v"))

    def shaped(template, **how):
        rows = df.select(F.to_json(nested.reshaped(F.col("v"), template, **how)).alias("t")).collect()
        assert rows[1]["t"] is None
        return json.loads(rows[0]["t"])

    assert shaped({"who": "user.name", "first": {"mail": "user.mails.0"}, "all": ["user.name", "user.mails"]}) == {"who": "Ann", "first": {"mail": "a@x"}, "all": ["Ann", ["a@x", "b@x"]]}
    assert shaped("user.mails.1") == "b@x"
    assert shaped({"age?": "user.age", "no?": "user.no", "null?": "user.none", "n": "user.none", "zero": "user.age"}) == {"n": None, "zero": 0}
    assert shaped({"n": "user.none", "zero": "user.age"}, with_null=False) == {"zero": 0}
    assert shaped({"x": "nowhere", "y": {"z": "user.no"}}, default="-") == {"x": "-", "y": {"z": "-"}}
    with pytest.raises(Exception, match="nothing at nowhere"):
        shaped({"x": "nowhere"})
    with pytest.raises(ValueError):
        nested.reshaped(F.col("v"), {"x": 1})


def test_variants_are_written_once_and_leaves_never(spark, traits, monkeypatch):
    written = []
    monkeypatch.setattr(nested, "stored", lambda df, name, *how, real=nested.stored: written.append(df.columns) or real(df, name, *how))
    found = nested.leaves(traits, ["id"], "traits", together=True)
    back = nested.assembled(found, ["id"])
    assert written == [["id", "value"]]
    assert back._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {r["id"]: json.loads(r["t"]) for r in back.select("id", F.to_json("traits").alias("t")).collect()} == {i: json.loads(s) for i, s in enumerate(SAID) if s is not None}


def test_brackets_quotes_and_places_in_keys_and_texts(spark):
    said = [{"a]}": "[{[{", 'b"\\{': ["\\", '"', "\\\"["], "\x01": {"\x1f\n": 1, "{": {}}, "[0": [[]], "": "é "}, list(range(120)), [[[1], [2, [3]]], {"x.y": {"x": {"y": -0.5}}}], {"a": {"b": 1}, "a\x01": 2, "a:": {"b": [None]}}]
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(said)], "id int, s string").select("id", F.parse_json("s").alias("traits"))
    found = nested.leaves(df, ["id"], "traits")
    assert {r["value"] for r in found.where("id = 0").collect()} == {'"[{[{"', '"\\\\"', '"\\""', '"\\\\\\"["', "1", "{}", "[]", '"é "'}
    back = {r["id"]: json.loads(r["t"]) for r in nested.assembled(found, ["id"]).select("id", F.to_json("traits").alias("t")).collect()}
    assert back == dict(enumerate(said))
