"""Scans over hot keys that are cut into parts give what a sequential pass gives."""

import bisect
import collections
import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import timelines

SCHEMA = "key string, at bigint, value double, _n string, _t int"


@pytest.fixture(scope="module")
def rows():
    random = np.random.RandomState(2)
    out = [("hot", int(t), float(v) if v > 0.1 else None, "x", 1) for t, v in zip(random.permutation(3000), random.rand(3000))]
    out += [(k, int(t), float(v), "x", 1) for k in ("a", "b", None) for t, v in zip(random.permutation(200)[:60] * 3, random.rand(60))]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def by_key(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        out[r[0]].append(r)
    return out


@pytest.mark.parametrize("most", [100, 10**9])
def test_scans(table, rows, most):
    line = timelines.laid(table, "key", "at", most)
    assert line.cut == (most == 100)
    if line.cut:
        sizes = line.rows.groupBy("key", "_part").count().filter("_part >= 0").collect()
        assert len(sizes) > 100 and max(r["count"] for r in sizes) < 100
    before = {(r.key, r.at): r._before for r in timelines.with_before(line, ["at"], ["at", "value"]).collect()}
    total = {(r.key, r.at): r.s for r in timelines.with_running(line, ["at"], F.col("at"), "s").collect()}
    known = [{(r.key, r.at): r.v for r in timelines.with_known(line, ["at"], "value", "v", backward).collect()} for backward in (True, False)]
    assert len(before) == len(total) == len(rows)
    for key, mine in by_key(rows).items():
        running, last = 0, None
        for k, r in enumerate(mine):
            running += r[1]
            last = r[2] if r[2] is not None else last
            b = before[key, r[1]]
            assert (b and (b.at, b.value)) == (mine[k - 1][1:3] if k else None)
            assert total[key, r[1]] == running and known[0][key, r[1]] == last
            assert known[1][key, r[1]] == next((x[2] for x in mine[k:] if x[2] is not None), None)


@pytest.mark.parametrize("most", [100, 10**9])
def test_islands(table, rows, most):
    got = timelines.islands(table, "key", "at", F.col("value") > 0.4, 2, most).collect()
    expected = []
    for key, mine in by_key(rows).items():
        run = []
        for r in [*mine, (key, None, None)]:
            if r[2] is not None and r[2] > 0.4:
                run.append(r[1])
            else:
                expected += [(key, len(run), run[0], run[-1])] if len(run) >= 2 else []
                run = []
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("most", [100, 10**9])
@pytest.mark.parametrize("own_time", [True, False])
def test_counts_within(spark, most, own_time):
    random = np.random.RandomState(7)
    zero = datetime.datetime(2024, 1, 1)
    rows = [("hot", k, zero + datetime.timedelta(seconds=int(t) / 2)) for k, t in enumerate(random.randint(0, 800, 2500))] + [("b", k, zero) for k in range(5)] + [("c", 0, None), (None, 1, zero)]
    got = timelines.counts_within(spark.createDataFrame(rows, "key string, id int, at timestamp"), "key", "at", 10, "n", own_time, most).collect()
    times = collections.defaultdict(list)
    for key, _, at in rows:
        times[key] += [at] if at else []
    for v in times.values():
        v.sort()
    assert len(got) == len(rows)
    for r in got:
        end = r["at"] and (bisect.bisect_right if own_time else bisect.bisect_left)(times[r.key], r["at"])
        assert r.n == (None if r["at"] is None else end - bisect.bisect_left(times[r.key], r["at"] - datetime.timedelta(seconds=10)))


@pytest.mark.parametrize("most", [60, 10**9])
@pytest.mark.parametrize(("direction", "within"), [("nearest", None), ("nearest", 2.0), ("backward", None), ("forward", 3.0)])
def test_joined_by_time(spark, most, direction, within):
    random = np.random.RandomState(3)
    left = [("hot", int(t), k) for k, t in enumerate(random.randint(0, 2000, 700))] + [("a", 5, 1), (None, 7, 2), ("none", 1, 3), ("hot", None, 4)]
    right = [("hot", int(t), float(random.randint(9))) for t in random.randint(0, 2000, 200)] + [("hot", 900, float(k)) for k in range(50)] + [("a", 4, 1.0), ("a", 6, 2.0), (None, 9, 3.0), ("hot", None, 5.0), ("other", 1, 1.0)]
    got = timelines.joined_by_time(spark.createDataFrame(left, "key string, t bigint, id int"), spark.createDataFrame(right, "key string, t bigint, v double"), "key", "t", ["v"], direction, within, most).collect()
    best = {}
    for k, t, v in right:
        if t is not None:
            best[k, t] = max(v, best.get((k, t), v))
    expected = []
    for key, t, i in left:
        fit = [(abs(x - t), x, v) for (k, x), v in best.items() if t is not None and k == key and (direction == "nearest" or (x <= t if direction == "backward" else x >= t))]
        gap, x, v = min(fit, default=(None, None, None))
        x, v = (None, None) if gap is None or (within is not None and gap > within) else (x, v)
        expected.append((key, t, i, x, v))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
