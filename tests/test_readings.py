"""Readings and look-ups on small rows, with nulls and empty tables."""

from pyspark.sql import functions as F

from lexigrid.operators import readings as rd

ROWS = [("甲地", "a", "甲", 2, "ka2"), ("甲地", "a", "甲", 3, "ka3"), ("甲地", "a", "乙", 0, "yi1"), ("甲地", "b", "丙", 1, "bing1"), ("甲地", "b", "丙", 1, "bing2")]
SCHEMA = "location string, value string, item string, mark int, reading string"


def test_status_to_reading(spark):
    """Details of items with several readings, shares of the location's items, a row for a location without any."""
    places = spark.createDataFrame([("甲地",), ("乙地",)], "location string")
    out = {(r.location, r.value): (r.n_items, r.share, r.detail) for r in rd.status_to_reading(spark.createDataFrame(ROWS, SCHEMA), places).collect()}
    assert out == {("甲地", "a"): (2, 0.6667, "甲:文·ka2|白·ka3"), ("甲地", "b"): (1, 0.3333, "丙:bing1|bing2"), ("乙地", None): (0, 0.0, "")}
    none = rd.status_to_reading(spark.createDataFrame([], SCHEMA), places).collect()
    assert sorted((r.location, r.n_items) for r in none) == [("乙地", 0), ("甲地", 0)]


def test_matched_or_all(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, name string")
    assert [r.id for r in rd.matched_or_all(df, F.col("name") == "y").collect()] == [3]
    assert sorted(r.id for r in rd.matched_or_all(df, F.col("name") == "z").collect()) == [1, 2, 3]
    assert rd.matched_or_all(df.limit(0), F.col("name") == "z").collect() == []


def test_flattened_and_subset(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('b', named_struct('c', 2)) AS a")
    assert rd.flattened(df).collect() == [(1, 2)] and rd.flattened(df).columns == ["id", "a_b_c"]
    names = spark.createDataFrame([("水口",), ("口水塘",), (None,)], "name string")
    assert [r[0] for r in names.filter(rd.subset("name", "口", "suffix")).collect()] == ["水口"]
    assert [r[0] for r in names.filter(rd.subset("name", least=3)).collect()] == ["口水塘"]
    assert [r[0] for r in names.filter(rd.subset("name", at=(1, "水"))).collect()] == ["水口"]
