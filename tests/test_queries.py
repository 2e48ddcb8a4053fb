"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexigrid.plans import queries as plans

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.8g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(plans.ORACLE[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert got == sorted(repr([plain(r[at[c]]) for c in columns]) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["region", "token", "n_cell", "lift", "log_odds", "z"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_status_marks(spark):
    """Marks 2 and 3 of one item in a cell count as both."""
    from lexigrid.operators.aggregation import feature_statistics

    rows = [("p", c, "k", m) for c, m in (("A", 1), ("B", 2), ("B", 3), ("C", 2), ("D", 3), ("E", None))]
    out = feature_statistics(spark.createDataFrame(rows, "loc string, char string, initial string, mark int"), "loc", "initial", "char", "mark").first()
    assert (out.n_items, out.n_several, out.n_second, out.n_third, out.n_both, out.ratio) == (5, 4, 2, 2, 1, 1.0)


def test_point_in_ring(spark):
    from pyspark.sql import functions as F

    from lexigrid.operators.structures import inside_ring

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1.0, 1.0, ring), (5.0, 1.0, ring)], "px double, py double, ring array<struct<x:double,y:double>>")
    assert [r[0] for r in df.select(inside_ring(F.col("px"), F.col("py"), F.col("ring"))).collect()] == [True, False]


def test_counter_stream(spark, tmp_path):
    from lexigrid.streaming.counters import compact, count_stream, totals

    source, schema = str(tmp_path / "in"), "user string, ts timestamp"
    for minute in (5, 65):
        spark.sql(f"SELECT 'u' AS user, timestamp'2024-01-01 00:00:00' + interval {minute} minutes AS ts").write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = count_stream(stream, ["user"], "ts", str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    keys, want = ["user", "unit", "bucket"], [("day", 2), ("hour", 1), ("hour", 1)]
    assert sorted((r["unit"], r["n"]) for r in totals(spark, str(tmp_path / "out"), keys, ["n"]).collect()) == want
    compact(spark, str(tmp_path / "out"), 1, keys, ["n"])
    assert sorted((r["unit"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
