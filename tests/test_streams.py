"""Streams over small files in several batches, and the sliding limit against a sequential version."""

import datetime

import pandas as pd
import pytest

from lexigrid.streaming import counters as ct


def _source(spark, tmp_path, batches, schema):
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _judged(rows, seconds, most):
    """rows: key, seconds. The order of time by key; a rejected row doesn't count."""
    out, kept = [], {}
    for key, t in sorted(rows):
        live = [x for x in kept.get(key, []) if x > t - seconds]
        ok = len(live) < most
        kept[key] = live + [t] if ok else live
        out.append((key, t, ok))
    return out


def test_append_and_keyword_streams(spark, tmp_path):
    stream = _source(spark, tmp_path, [[(1, '{"a": "x", "b": " "}'), (2, "none")], [(3, None), (4, '{"c": "y"}')]], "id int, body string")
    ct.append_stream(ct.keyword_rows(stream, "body", ["id"]), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "a", "x"), (4, "c", "y")]


def test_appended_condition(spark, tmp_path):
    from pyspark.sql import functions as F

    stream = _source(spark, tmp_path, [[(1, "error"), (2, "click")], [(3, "error")]], "id int, kind string")
    ct.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), F.col("kind") == "error").awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]


def test_sum_stream_is_repeatable(spark, tmp_path):
    at = [datetime.datetime(2024, 1, 1, h) for h in range(4)]
    stream = _source(spark, tmp_path, [[("u", 5.0, at[0]), ("v", 1.0, at[1])], [("u", 2.0, at[3]), ("u", 1.0, at[2])]], "user string, seconds double, at timestamp")
    work = lambda batch: ct.activity(batch, "user", "seconds", "at")
    for check in ("one", "two"):  # the second run repeats the batches
        ct.sum_stream(stream, work, str(tmp_path / "out"), str(tmp_path / check)).awaitTermination(120)
        rows = ct.totals(spark, str(tmp_path / "out"), ["user"], ["seconds"], ["at"]).collect()
        assert sorted(map(tuple, rows)) == [("u", 8.0, at[3]), ("v", 1.0, at[1])]


def test_limit_stream_keeps_its_state(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    times = [[("u", 0), ("u", 10), ("v", 5), ("u", 20)], [("u", 50), ("u", 61), ("v", 6)], [("u", 65), ("u", 71), ("u", 72)]]
    stream = _source(spark, tmp_path, [[(k, start + datetime.timedelta(seconds=t)) for k, t in rows] for rows in times], "user string, at timestamp")
    out = ct.limit_stream(stream, "user", "at", 60, 2)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.key, (r["at"] - start).total_seconds(), r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == _judged([x for rows in times for x in rows], 60, 2)


def test_limited_table(spark):
    random = pd.Series(range(400))
    rows = [(f"u{k % 5 if k % 3 else 0}", float((k * 7919) % 1000), k) for k in random]
    df = spark.createDataFrame([(u, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), k) for u, t, k in rows] + [(None, None, -1)], "user string, at timestamp, k int").repartition(4)
    got = {r.number: r.accepted for r in ct.limited(df, "user", "at", "k", 100, 3).collect()}
    want, kept = {}, {}
    for u, t, k in sorted(rows):
        live = [x for x in kept.get(u, []) if x > t - 100]
        want[k] = len(live) < 3
        kept[u] = live + [t] if want[k] else live
    assert got == want
    assert ct.limited(df.limit(0), "user", "at", "k", 100, 3).count() == 0


@pytest.mark.parametrize("batches", [1, 2])
def test_merged(spark, batches):
    one = spark.createDataFrame([("a", 1, 5), ("b", 2, 1)], "key string, n int, at int")
    got = ct.merged(one if batches == 2 else None, one, ["key"], ["n"], ["at"])
    assert sorted(map(tuple, got.collect())) == [("a", batches, 5), ("b", 2 * batches, 1)]


def _run(out, tmp_path, schema, spark):
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    state = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    return spark.read.schema(schema).parquet(str(tmp_path / "out")).collect(), state


START = datetime.datetime(2024, 1, 1)


def _later(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_limit_stream_drops_state_and_late_rows(spark, tmp_path):
    batches = [[(f"u{k}", _later(k)) for k in range(40)], [("v", _later(500))], [("u1", _later(2)), ("v", _later(510))], [("w", _later(1000))]]
    out = ct.limit_stream(_source(spark, tmp_path, batches, "user string, at timestamp"), "user", "at", 60, 2, "10 seconds")
    got, state = _run(out, tmp_path, "key string, at timestamp, accepted boolean", spark)
    assert ("u1", _later(2), True) not in set(map(tuple, got)) and len(got) == 43 and all(r.accepted for r in got)
    assert max(state) <= 41 and state[-1] <= 2  # keys that are over are gone


def test_session_stream(spark, tmp_path):
    from lexigrid.streaming import sessions

    batches = [[("a", _later(0)), ("a", _later(20)), ("b", _later(5)), (None, _later(1))], [("a", _later(35)), ("a", _later(200))], [("b", _later(400))], [("c", _later(900)), ("a", _later(10))]]
    out = sessions.session_stream(_source(spark, tmp_path, batches, "user string, at timestamp"), "user", "at", "30 seconds", "20 seconds")
    got, state = _run(out, tmp_path, "key string, first timestamp, last timestamp, n bigint", spark)
    assert sorted(map(tuple, got)) == [("a", _later(0), _later(35), 3), ("a", _later(200), _later(200), 1), ("b", _later(5), _later(5), 1), ("b", _later(400), _later(400), 1)]
    assert state[-1] == 1


def test_history_stream(spark, tmp_path):
    from lexigrid.streaming import sessions

    batches = [[("a", _later(2), "y"), ("a", _later(0), "x"), ("a", _later(1), None), ("b", _later(0), "q")], [("a", _later(30), "x"), ("a", _later(31), "x"), ("a", _later(32), "z")], [("c", _later(500), "p")], [("c", _later(900), "p")]]
    out = sessions.history_stream(_source(spark, tmp_path, batches, "user string, at timestamp, ip string"), "user", "at", "ip", 3, 60, "5 seconds")
    got, state = _run(out, tmp_path, "key string, n_changes bigint, history string", spark)
    assert sorted(map(tuple, got))[:2] == [("a", 3, "y,x,z"), ("b", 0, "q")] and state[-1] <= 1


def test_sketches_within_their_bounds(spark, tmp_path):
    import numpy as np

    from lexigrid.streaming import sketches as sk

    random = np.random.RandomState(4)
    batches = [[("k", _later(int(t)), int(u), float(v)) for t, u, v in zip(random.randint(0, 9000, 4000), random.randint(0, 6000, 4000), random.rand(4000))] for _ in range(3)] + [[("none", START, None, None)]]
    stream = _source(spark, tmp_path, batches, "key string, at timestamp, user int, value double")
    rows = [r for b in batches[:3] for r in b]
    users, values = {r[2] for r in rows}, np.sort([r[3] for r in rows])
    for check in ("one", "two"):  # a repeated batch changes nothing
        ct.sum_stream(stream, lambda b: sk.sketched(b, ["key"], "at", "user", "value"), str(tmp_path / "out"), str(tmp_path / check)).awaitTermination(120)
        got = {r.key: r for r in sk.sketch_totals(spark, str(tmp_path / "out"), ["key"]).collect()}
        assert got["k"].n == 12000 and abs(got["k"].users - len(users)) < 0.05 * len(users)
        assert all(abs(np.searchsorted(values, got["k"][f"q{q}"]) / 12000 - q / 100) < 0.02 for q in (50, 95, 99))
        assert got["none"].n == 1 and got["none"].users == 0 and got["none"].q50 is None
    ct.sum_stream(stream, lambda b: sk.distinct_pairs(b, ["key"], "at", "user"), str(tmp_path / "pairs"), str(tmp_path / "three")).awaitTermination(120)
    assert [tuple(r) for r in sk.distinct_totals(spark.read.parquet(str(tmp_path / "pairs")), ["key"]).collect()] == [("k", len(users))]


def test_compact_counts_once(spark, tmp_path):
    path = str(tmp_path / "sums")
    for k in range(4):
        spark.createDataFrame([("a", k + 1), ("b", 1)], "key string, n int").write.parquet(f"{path}/batch={k}")
    want = [("a", 10), ("b", 4)]
    total = lambda: sorted(map(tuple, ct.totals(spark, path, ["key"], ["n"]).collect()))
    assert total() == want
    ct.compact(spark, path, 2, ["key"], ["n"])
    assert total() == want and sorted(p.name for p in (tmp_path / "sums").glob("batch=*")) == ["batch=2", "batch=3"]
    # A compaction that stopped after it had written its sums.
    ct.merged(None, spark.read.parquet(path).drop("batch"), ["key"], ["n"]).write.parquet(f"{path}/_compact-3")
    assert total() == want
    ct.compact(spark, path, 3, ["key"], ["n"])
    assert total() == want and [p.name for p in (tmp_path / "sums").glob("*")] == ["batch=3"]
