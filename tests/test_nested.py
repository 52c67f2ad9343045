"""Rounding and the finite gate at every depth."""

import json

import pytest
from pyspark.errors import PySparkException

from gaugework.functions import nested
from gaugework.sources import publish

SCHEMA = "id long, x double, a struct<b: array<struct<c: double, d: string>>, f: float>, m map<string, array<double>>"
NAN, INF = float("nan"), float("inf")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


GOOD = (1, 1 / 3, {"b": [{"c": 2 / 3, "d": "t"}, None, {"c": None, "d": None}], "f": 0.5}, {"k": [1 / 7, None], "n": None})


def test_numbers_are_rounded_at_every_depth(spark):
    df = frame(spark, GOOD, (2, None, None, None), (3, None, {"b": None, "f": None}, {}))
    out = nested.rounded(df, 3)
    assert out.schema.simpleString() == df.schema.simpleString()
    one, two, three = [r.asDict(recursive=True) for r in out.orderBy("id").collect()]
    assert one == {
        "id": 1, "x": 0.333, "a": {"b": [{"c": 0.667, "d": "t"}, None, {"c": None, "d": None}], "f": 0.5},
        "m": {"k": [0.143, None], "n": None},
    }
    assert two == {"id": 2, "x": None, "a": None, "m": None}
    assert three == {"id": 3, "x": None, "a": {"b": None, "f": None}, "m": {}}


@pytest.mark.parametrize("row,column", [
    ((1, NAN, None, None), "x"),
    ((1, None, {"b": [{"c": 1.0, "d": ""}, {"c": INF, "d": ""}], "f": 1.0}, None), "a"),
    ((1, None, {"b": None, "f": -INF}, None), "a"),
    ((1, 0.5, None, {"k": [], "n": [0.0, NAN]}), "m"),
])
def test_numbers_that_are_not_finite_are_refused_at_every_depth(spark, tmp_path, row, column):
    df = frame(spark, GOOD, row)
    with pytest.raises(PySparkException, match=f"not finite in {column}"):
        publish.strict_json(df).collect()
    with pytest.raises(PySparkException, match=f"not finite in {column}"):
        nested.require_finite(df).select("id").collect()
    with pytest.raises(Exception, match="not finite"):
        publish.publish_once(spark, {"t": publish.Output(df, "json")}, str(tmp_path / "out"))
    assert "not finite" in json.loads((tmp_path / "out.staging" / "FAILED.json").read_text())["error"]


def test_published_tables_are_rounded_and_ordered(spark, tmp_path):
    rows = [(i, i / 7, None, None) for i in (3, 1, 2)]
    tables = {
        "data": publish.Output(frame(spark, *rows).coalesce(1), "parquet", (), (), ("id",)),
        "report": publish.Output(frame(spark, *rows).select("id", "x"), "csv", (), (), ("id",)),
    }
    publish.publish_once(spark, tables, str(tmp_path / "out"))
    data = spark.read.parquet(str(tmp_path / "out" / "data")).collect()
    assert [r["id"] for r in data] == [1, 2, 3] and [r["x"] for r in data] == [round(i / 7, 10) for i in (1, 2, 3)]
    text = "".join(p.read_text() for p in (tmp_path / "out" / "report").glob("*.csv"))
    assert text.splitlines()[0] == "id,x" and [line.split(",")[0] for line in text.splitlines()[1:]] == ["1", "2", "3"]
