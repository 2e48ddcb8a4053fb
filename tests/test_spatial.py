"""The spatial index against tests of every pair."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import comparison, places, spatial

SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def inside(x, y, ring):
    hit = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            hit = not hit
    return hit


def star(x, y, r, n, phase=0.0):
    return [(x + r * (1 + 0.3 * (k % 2)) * math.cos(phase + 2 * math.pi * k / n), y + r * (1 + 0.3 * (k % 2)) * math.sin(phase + 2 * math.pi * k / n)) for k in range(n)]


@pytest.fixture(scope="module")
def shapes():
    random = np.random.RandomState(4)
    out = [(0, [[star(3, 5, 60, 3000), star(10, 10, 8, 400), star(-20, 0, 5, 7)]]), (1, [[star(-100, -40, 30, 5)], [star(120, 50, 10, 900), star(120, 50, 2, 12)]])]
    for k in range(2, 150):
        x, y = map(float, random.uniform(-20, 20, 2))
        closed = star(x, y, float(10 ** random.uniform(-6, 0.3)), 6, float(random.uniform(0, 6)))
        out.append((k, [[closed + closed[:1]]]))
    tall = [(60.0, -80.0), (60.5, 80.0), (61.0, -80.0), (60.7, -80.0)] + [(60.7 - 0.001 * k, -80.0 - 0.001 * (k % 2)) for k in range(1, 300)]
    return [*out, (150, [[tall]]), (150, [[star(70, 0, 1, 4)]]), (151, None), (152, []), (153, [[]]), (154, [[[(0.0, 0.0), (1.0, 1.0)]]])]


@pytest.fixture(scope="module")
def features(spark, shapes):
    return spark.createDataFrame(shapes, f"feature_id bigint, geometry {SHAPE}").repartition(3)


@pytest.fixture(scope="module")
def path(spark, features, tmp_path_factory):
    return spatial.build(features, f"file://{tmp_path_factory.mktemp('index')}/index")


@pytest.mark.parametrize("n", [300, 800])  # in the reader's filter, and joined
def test_at_points(spark, shapes, path, n):
    random = np.random.RandomState(n)
    points = [(k, float(random.uniform(-70, 75) if k % 3 else random.uniform(-20, 20)), float(random.uniform(-79, 79) if k % 3 else random.uniform(-20, 20))) for k in range(n)]
    points += [(9000, None, 1.0), (9001, float("nan"), 0.0), (9002, 500.0, 0.0), (9003, 3.0, 5.0), (9004, 10.0, 10.0), (9005, 60.4, -70.0), (9006, 70.0, 0.1), (9007, -100.0, -40.0), (9008, 120.0, 50.0), (9009, 126.0, 50.0)]
    index = spatial.opened(spark, path)
    got = {tuple(r) for r in spatial.at_points(index, spark.createDataFrame(points, "point_id bigint, x double, y double")).collect()}
    expected = set()
    for p, x, y in points:
        for f, geometry in shapes if x is not None and -180 <= x < 180 else ():
            for part in geometry or ():
                rings = [r for r in part if len(r) >= 3]
                if rings and inside(x, y, rings[0]) and not any(inside(x, y, h) for h in rings[1:]):
                    expected.add((p, f))
    assert got == expected
    assert len(expected) > 200 and {f for _, f in expected} >= {0, 1, 150}


def test_meeting(spark, shapes, features, path):
    random = np.random.RandomState(6)
    queries = []
    for k in range(60):
        x, y, r = float(random.uniform(-30, 70)), float(random.uniform(-30, 30)), float(10 ** random.uniform(-4, 1.5))
        queries.append((k, [[[(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]]]))
    asked = spark.createDataFrame(queries, f"query_id bigint, shape {SHAPE}")
    some = features.filter("feature_id BETWEEN 1 AND 149")  # the outline of 3,400 edges is left to the boxes
    got = {tuple(r) for r in spatial.meeting(spatial.opened(spark, path), some, asked).collect()}
    from lexigrid.operators.places import geometries_meet
    from pyspark.sql import functions as F

    every = asked.crossJoin(some).filter(geometries_meet(F.col("shape"), F.col("geometry"))).select("query_id", "feature_id").distinct()
    assert got == {tuple(r) for r in every.collect()} and len(got) > 20


def test_index_is_pruned(spark, path):
    """A large part isn't multiplied into small cells, and a look-up reads the zones and keys that it needs."""
    index = spatial.opened(spark, path)
    widest = index.filter("feature_id = 0").agg({"level": "min", "key": "count"}).first()
    assert widest[1] <= 4 * (3500 / spatial.EDGES + 2)
    assert index.selectExpr("max(size(edges))").first()[0] <= 16 * spatial.EDGES  # of 3,407; spikes go over several bands
    found = spatial.at_points(index, spark.createDataFrame([(1, 3.0, 5.0)], "point_id int, x double, y double"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*zone", plan) and re.search(r"PushedFilters: \[[^\]]*key", plan)
    read = index.filter("zone IN (-1, 151)")
    assert 0 < len({r[0] for r in read.selectExpr("input_file_name()").collect()}) < len(index.inputFiles())


def test_nearest_in_a_crowd(spark):
    """Crowded, lonely and equal places, and those without a level, against brute force; a crowd isn't joined with a crowd."""
    random = np.random.RandomState(4)
    spots = np.vstack([random.uniform(0, 0.05, (400, 2)), random.uniform(-1, 1, (60, 2)), [[0.02, 0.03]] * 40])
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(spots[::2])]
    sites = [(1000 - k, [None, "a", "b"][k % 3], float(x), float(y)) for k, (x, y) in enumerate(spots[1::2])]
    a, b = spark.createDataFrame(points, "point_id bigint, x double, y double"), spark.createDataFrame(sites, "place_id bigint, level string, px double, py double")
    want = {}
    for p, x, y in points:
        for q, level, px, py in sites:
            d = float(np.hypot(x - px, y - py))
            if d <= 0.1:
                want[p, level] = min(want.get((p, level), (d, q)), (d, q))
    got = {(r.point_id, r.level): (r.distance, r.place_id) for r in places.nearest_by_level(a, b, 0.1).collect()}
    assert got == {k: (pytest.approx(d, abs=1e-6), q) for k, (d, q) in want.items()}
    one = {r.point_id: r.place_id for r in comparison.nearest_in_grid(a, b.drop("level"), 0.1).collect()}
    assert one == {p: min(v for (k, _), v in want.items() if k == p)[1] for p, _ in want}
    crowd = spark.range(40_000).select((F.col("id") % 2).alias("side"), "id", (F.col("id") * 1e-6).alias("x"), (F.col("id") % 1000 * 4e-5).alias("y"))
    seen = spark.sparkContext.accumulator(0)

    def apart(x, px):
        seen.add(1)
        return abs(x - px)

    met = places.nearest_sites(crowd.filter("side = 0").select(F.col("id").alias("point_id"), "x", "y"), crowd.filter("side = 1").select(F.col("id").alias("place_id"), F.col("x").alias("px"), F.col("y").alias("py")), 0.1, F.udf(apart, "double")("x", "px"))
    assert met.count() == 20_000 and seen.value < 20_000 * 1000


def test_boxes_are_found_once(spark, tmp_path):
    """Pairs of boxes over many cells, and of features of several parts, come once without a shuffle of pairs."""
    parts = [(k, [[star(x, y, r, 4)], [star(x + r, y, r, 4)], [star(x, y + 3 * r, 2 * r, 5)]]) for k in range(60) for x, y, r in [((k * 7) % 40 - 20.0, (k * 11) % 30 - 15.0, 0.1 + k % 5)]]
    index = spatial.opened(spark, spatial.build(spark.createDataFrame(parts, f"feature_id bigint, geometry {SHAPE}"), f"file://{tmp_path}/index"))
    boxes = [(k, x - r, y - r, x + r, y + r) for k in range(60) for x, y, r in [((k * 5) % 40 - 20.0, (k * 13) % 30 - 15.0, 0.01 + (k % 7) ** 2 / 5)]]
    queries = lambda rows: spark.createDataFrame(rows, "query_id bigint, x0 double, y0 double, x1 double, y1 double")
    bounds = [(f, min(x for x, _ in ring), min(y for _, y in ring), max(x for x, _ in ring), max(y for _, y in ring)) for f, geometry in parts for (ring,) in geometry]
    expected = {(q, f) for q, a, b, c, d in boxes for f, x0, y0, x1, y1 in bounds if x0 <= c and a <= x1 and y0 <= d and b <= y1}
    found = spatial.boxes_meeting(index, queries(boxes))
    got = list(map(tuple, found.collect()))
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 100
    assert "keys=[query_id" not in found._jdf.queryExecution().toString()
    again = list(map(tuple, spatial.boxes_meeting(index, queries(boxes + boxes[:9])).collect()))
    assert len(again) == len(set(again)) and set(again) == expected


def test_points_found_are_not_shuffled(spark, tmp_path):
    """Unless parts of a feature overlap or a point id is repeated; then each pair still comes once."""
    square = lambda x, y, r: [[(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]]
    apart = [(k, [square(float(k % 7), float(k % 5), 1.5), square(40.0 + k, 0.0, 0.4)]) for k in range(30)]
    points = [(k, (k * 0.37) % 8, (k * 0.73) % 6) for k in range(600)]
    want = {(p, f) for p, x, y in points for f, ((one,), _) in apart if inside(x, y, one)}

    def pairs(shapes, points, name):
        built = spatial.build(spark.createDataFrame(shapes, f"feature_id bigint, geometry {SHAPE}"), f"file://{tmp_path}/{name}")
        found = spatial.at_points(spatial.opened(spark, built), spark.createDataFrame(points, "point_id bigint, x double, y double"))
        return found, found._jdf.queryExecution().optimizedPlan().toString()

    found, plan = pairs(apart, points, "apart")
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 1000
    assert "Aggregate" not in plan.split("FlatMapCoGroups")[0]
    over = [*apart, (100, [square(3.0, 3.0, 1.0), square(3.5, 3.0, 1.0)]), (101, [square(2.0, 2.0, 0.5)]), (101, [square(2.0, 2.0, 0.7)])]
    more = {(p, f) for p, x, y in points for f, parts in over[30:] if any(inside(x, y, one) for (one,) in parts)}
    rows = [tuple(r) for r in pairs(over, points, "over")[0].collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want | more
    rows = [tuple(r) for r in pairs(apart, points * 2, "twice")[0].collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
