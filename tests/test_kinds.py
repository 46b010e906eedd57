"""Kinds of JSON texts, without parsing them whole."""

from pyspark.sql import functions as F
from recollect.operators import nested


def test_kinds_of_texts(spark):
    values = ['{"a":1}', "{}", "[1,2]", "[]", '"x"', '"{"', '""', "null", "true", "false", "1", "-1.5", "1e300", "12345678901234567890123"]
    df = spark.createDataFrame([(v,) for v in values], "value string").select("value", nested.kind_of_text("value").alias("k"), nested.kind_of(F.parse_json("value")).alias("w"))
    got = df.collect()
    assert [r["k"] for r in got] == [r["w"] for r in got]
