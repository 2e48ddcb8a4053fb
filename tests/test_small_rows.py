"""Operators on small rows: ties, nulls, empty tables, equal values, and brute-force versions where SQL can't express them."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as fn
from lexigrid.operators import aggregation as agg
from lexigrid.operators import clusters as cl
from lexigrid.operators import comparison as cmp
from lexigrid.operators import distances as ds
from lexigrid.operators import places as pl
from lexigrid.operators import profiles as pf
from lexigrid.operators import structures as st
from lexigrid.operators import tones as tn
from lexigrid.operators import usage
from lexigrid.operators import variants as vr
from lexigrid.sources import tables


def test_divisors_of_zero(spark):
    """Equal means, zero totals and one label give nulls and no error."""
    rows = spark.createDataFrame([(k, 5.0, 0.0, "u") for k in range(4)], "key int, same double, zero double, user string")
    assert [r.z for r in agg.standard_scores(rows, "key", "same").collect()] == [None] * 4
    ranked = agg.ranking(rows, "key", "zero", "user").collect()
    assert {(r["rank"], r.gap, r.percent_of_first, r.percent_of_all) for r in ranked} == {(1, None, None, None)} and len(ranked) == 4
    vectors = spark.createDataFrame([(k, 1, [float(k), 1.0]) for k in range(3)], "key int, label int, v array<double>")
    assert cmp.cluster_spread(vectors, "label", "key", "v").first().calinski_harabasz is None
    assert cmp.cluster_spread(vectors.withColumn("label", F.col("key")), "label", "key", "v").first().calinski_harabasz is None
    assert cmp.davies_bouldin(vectors, "label", "key", "v").first().davies_bouldin is None
    assert agg.ranking(rows.limit(0), "key", "zero", "user").count() == 0 and agg.rfm(rows.limit(0).withColumn("at", F.current_timestamp()), "user", "at", "same").count() == 0


def test_several_values_counts_combinations(spark):
    rows = [(1, "a|b", "c"), (1, "a", "b|c"), (2, "x", None), (2, "x", "y"), (3, "z", "z"), (3, "z", "z")]
    out = agg.several_values(spark.createDataFrame(rows, "id int, p string, q string"), "id", ["p", "q"]).collect()
    assert {(r.id, r.n_values) for r in out} == {(1, 2), (2, 2)}


@pytest.mark.parametrize("descending", [True, False])
def test_running_sums_over_ranges(spark, descending):
    values = [(float(v), n) for v, n in {random.Random(k).randint(-50, 50): k % 5 + 1 for k in range(90)}.items()]
    got = {r.v: (r.before, r.beside) for r in agg.with_running(spark.createDataFrame(values, "v double, n int"), "v", "n", descending, parts=8).collect()}
    ordered, total, last = sorted(values, reverse=descending), 0, None
    for v, n in ordered:
        assert got[v] == (total, last)
        total, last = total + n, v


def test_dense_index_of_texts(spark):
    words = sorted({f"{'字母𠀀é'[k % 4]}{k * 7919 % 613}" for k in range(900)}, key=lambda w: w.encode())
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "w string").repartition(3)
    assert {r.w: r.place for r in vr.dense_index(df, "w").collect()} == {w: k for k, w in enumerate(words)}


def test_nearest_rank_with_repeats(spark):
    rows = [("a", float(v)) for v in (1, 1, 1, 2, 9, 9, 9, 9, 9, 10)] + [("b", None), ("b", 4.0)]
    out = {r.key: r for r in agg.nearest_rank(spark.createDataFrame(rows, "key string, v double"), "key", "v", [10, 50, 95], slow=5.0).collect()}
    assert (out["a"].p10, out["a"].p50, out["a"].p95, out["a"].slow_ratio, out["a"].n) == (1.0, 9.0, 10.0, 0.6, 10)
    assert (out["b"].p50, out["b"].n) == (4.0, 1)


def test_median_filter_in_unbroken_runs(spark):
    rows = [(1, k, v) for k, v in enumerate([5.0, 7.0, 6.0, None, 9.0, 1.0])]
    out = [(r.k, r.median) for r in usage.median_filter(spark.createDataFrame(rows, "key int, k int, v double"), "key", "k", "v").orderBy("k").collect()]
    padded = lambda run, i: sorted([0.0, 0.0, *run, 0.0, 0.0][i : i + 5])[2]
    assert out == [(k, padded([5.0, 7.0, 6.0], k)) for k in range(3)] + [(4 + k, padded([9.0, 1.0], k)) for k in range(2)]


def test_stratified_sample_takes_its_share(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "big").when(F.col("id") < 999, "mid").alias("s"))
    one, two = (sorted((r.s or "", r.id) for r in cmp.stratified_sample(x, "s", "id", 0.1).collect()) for x in (df, df.repartition(7)))
    counts = {s: len(list(g)) for s, g in itertools.groupby(one, key=lambda x: x[0])}
    assert one == two and counts == {"big": 70, "mid": 29, "": 1}


def _ratio(a, b):
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return 2 * row[-1] / (len(a) + len(b))


def test_fuzzy_ratio(spark):
    names = ["", "水口", "口水塘", "abcab", "bcaba", "x", "abcabcabc", None]
    pairs = [(a, b) for a in names for b in names]
    out = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fn.fuzzy_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == pytest.approx(_ratio(r.a, r.b)) for r in out)


def test_clusters_find_planted_groups(spark):
    source = random.Random(1)
    rows = [(k, [10.0 * (k % 3) + source.gauss(0, 0.3), 5.0 * (k % 3) + source.gauss(0, 0.3), 1.0]) for k in range(90)] + [(100, None), (101, [None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    for method in ("kmeans", "mixture", "bisecting"):
        found = {r.id: r.cluster for r in cl.clustered(df, "id", "v", 3, method, components=2).collect()}
        assert set(found) == set(range(90))
        if method != "mixture":  # whose random start may end in a local optimum
            assert len({(k % 3, c) for k, c in found.items()}) == 3
    best = max(cl.scanned(df, "id", "v", [2, 3, 5]).collect(), key=lambda r: r.silhouette)
    assert best.k == 3
    sizes = cl.cluster_profiles(cl.clustered(df, "id", "v", 3)).collect()
    assert [r.n for r in sizes] == [30, 30, 30] and all(len(r.centre) == 3 for r in sizes)


def test_principal_components(spark):
    import numpy as np

    data = np.random.RandomState(5).normal(size=(60, 3)) @ np.array([[3.0, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(data)], "id int, v array<double>")
    got = np.array([[r.p1, r.p2] for r in cl.reduced(df, "id", "v", 2).orderBy("id").collect()])
    scaled = (data - data.mean(axis=0)) / data.std(axis=0, ddof=1)
    want = scaled @ np.linalg.svd(scaled - scaled.mean(axis=0))[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4)


def test_dense_clusters_against_brute_force(spark):
    source = random.Random(3)
    points = [(k, source.random() * 3, source.random() * 3) for k in range(150)] + [(500, 99.0, 99.0)]
    got = {r.id: r.cluster for r in cl.dense_clusters(spark.createDataFrame(points, "id int, x double, y double"), "id", "x", "y", 0.25, 4).collect()}
    near = {a: [b for b, p, q in points if math.hypot(x - p, y - q) <= 0.25] for a, x, y in points}
    cores = {a for a in near if len(near[a]) >= 4}
    label = {a: a for a in cores}
    for _ in points:
        label = {a: min(label[b] for b in near[a] if b in cores) for a in cores}
    assert {a: got[a] for a in cores} == label
    assert all((got[a] is None) == (not cores & set(near[a])) for a in near) and got[500] is None
    assert all(got[a] in {label[b] for b in near[a] if b in cores} for a in near if got[a] is not None)
    assert cl.radius_guess(spark.createDataFrame(points, "id int, x double, y double"), "id", "x", "y", 3) > 0


def test_geometry_of_holes_and_parts(spark):
    square = lambda x, y, r: [(float(x - r), float(y - r)), (float(x + r), float(y - r)), (float(x + r), float(y + r)), (float(x - r), float(y + r))]
    shape = [[square(0, 0, 4), square(0, 0, 1)], [square(10, 0, 1)]]
    points = [(2.0, 2.0), (0.0, 0.0), (10.5, 0.5), (6.0, 0.0), (-5.0, -5.0)]
    df = spark.createDataFrame([(x, y, shape) for x, y in points], f"x double, y double, g {pl.POINTS}")
    out = df.select(pl.contains_point(F.col("x"), F.col("y"), F.col("g")).alias("hit"), pl.metres_to(F.col("x"), F.col("y"), F.expr("transform(g, p -> transform(p, r -> concat(r, slice(r, 1, 1))))")).alias("m")).collect()
    assert [r.hit for r in out] == [True, False, True, False, False]
    assert [r.m for r in out] == pytest.approx([0.0, 111320.0, 0.0, 2 * 111320.0, math.sqrt(2) * 111320.0])
    empty = spark.createDataFrame([(0.0, 0.0, []), (0.0, 0.0, None)], f"x double, y double, g {pl.POINTS}")
    assert [tuple(r) for r in empty.select(pl.contains_point(F.col("x"), F.col("y"), F.col("g")), pl.metres_to(F.col("x"), F.col("y"), F.col("g"))).collect()] == [(False, None)] * 2


def test_geometries_that_meet(spark):
    box = lambda x, y, r: [[[(float(x + p * r), float(y + q * r)) for p, q in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]]]
    pairs = [(box(0, 0, 1), box(1, 1, 1), True), (box(0, 0, 5), box(1, 1, 1), True), (box(0, 0, 1), box(5, 5, 1), False), (box(0, 0, 1), box(2, 0, 1), True), (box(0, 0, 1), [], False)]
    df = spark.createDataFrame(pairs, f"a {pl.POINTS}, b {pl.POINTS}, want boolean")
    assert all(r.got == r.want for r in df.select(pl.geometries_meet(F.col("a"), F.col("b")).alias("got"), "want").collect())


def test_resolved_locations_in_tiers(spark):
    places = spark.createDataFrame([("p", "A-B-C"), ("q", "A-B"), ("r", "X-B-Z"), ("s", "A")], "location string, path string")
    wanted = spark.createDataFrame([("A-B",), ("B",), ("A",), ("B",)], "region string")
    out = {r.location: r.tier for r in pl.resolved_locations(places, wanted, spark.createDataFrame([("r",), ("t",)], "location string")).collect()}
    assert out == {"q": 1, "s": 1, "p": 2, "r": 2, "t": 3}


def test_tone_cells(spark):
    cells = [("a", 1, "55陰平"), ("a", 5, "35去"), ("a", 6, ""), ("a", 7, "5陰入,3陽入"), ("a", 8, None), ("b", 1, "陽上歸陰去"), ("b", 5, "33")]
    parts = tn.tone_parts(spark.createDataFrame(cells, "location string, slot int, cell string"))
    found = {(r.location, r.slot): r for r in parts.collect()}
    assert found["a", 1].total == "[1]55陰平" and found["a", 1]["values"] == ["55"] and found["a", 1].matches == ["T1"]
    assert found["a", 7]["values"] == ["`5", "`3"] and found["a", 7].matches == ["T7", "T8"] and found["a", 7].total == "[7a]5陰入,[7b]3陽入"
    assert found["b", 1].matches == ["T4", "T5"] and found["a", 8].matches == []
    status = {(r.location, r.a, r.b): r.status for r in tn.tone_pairs(parts, [(5, 6), (7, 8), (1, 5)]).collect()}
    assert status == {("a", 5, 6): "maybe", ("a", 7, 8): "unknown", ("a", 1, 5): "diff", ("b", 1, 5): "diff"}
    vector = tn.tone_vectors(spark.createDataFrame([("a", 2, "213,35"), ("a", 3, "x")], "location string, slot int, cell string")).first().vector
    assert vector[:12] == pytest.approx([0, 0, 0, 0, 1, 0.5, 0.5, 0.8, 0, 0, 0, 0]) and len(vector) == 40


def test_distance_rules(spark):
    rows = [("g", "p", 1, "a"), ("g", "p", 2, "b"), ("g", "q", 1, "a"), ("g", "q", 2, "b"), ("g", "r", 9, "z"), ("h", "p", 1, "a"), ("g", "s", 1, None)]
    found = ds.tokens(spark.createDataFrame(rows, "grp string, location string, item int, value string"), "grp", "location", "item", "value")
    weights = spark.createDataFrame([("g", 1.0), ("h", 3.0)], "group string, weight double")
    got = {(r.a, r.b): r.distance for r in ds.distance_matrix(found, weights).collect()}
    # p and q agree in g, and q lacks h; r shares no item with q.
    assert got == {("p", "q"): 0.75, ("p", "r"): pytest.approx((0.85 + 3) / 4), ("q", "r"): 0.85}


def test_bounded_pairs(spark, monkeypatch):
    monkeypatch.setattr(st, "MOST_KEYS", 3)
    with pytest.raises(ValueError):
        st.bounded(spark.range(5), 3)


def test_leaderboards_and_peaks(spark):
    rows = [(1, k, float(v)) for k, v in enumerate([0, 5, 1, 6, 1, 3, 0, 9, 0])]
    out = vr.local_peaks(spark.createDataFrame(rows, "key int, k int, v double"), "key", "k", "v", 3)
    assert sorted(r.k for r in out.collect()) == [3, 7]
    assert sorted(r.k for r in vr.local_peaks(spark.createDataFrame(rows, "key int, k int, v double"), "key", "k", "v", 3, prominence=7.0).collect()) == [7]


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tables.export(spark.createDataFrame([(1, "ü")], "a int, b string").coalesce(1), "csv", f"file://{tmp_path}/out", bom=True)
    data = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfa,b") and path.endswith("out")
    with pytest.raises(ValueError):
        tables.export(spark.range(1), "xls", str(tmp_path / "x"))


def test_aliased_columns_and_paths(spark):
    df = spark.createDataFrame([(1, "x", "y")], ["Char ", "漢字", "other"])
    assert tables.aliased(df, {"char": ["漢字"]}).columns == ["char"]
    part = spark.createDataFrame([("知", "三A"), ("知", "一"), ("端", "三B")], ["組", "等"])
    grade = {("等", "三"): ["三A", "三B", "三C", "三銳"]}
    assert part.filter(vr.path_predicate("[知]{組}[三]{等}", ["組", "等"], grade)).count() == 1
    assert part.filter(vr.path_predicate("[三]{等}", ["組", "等"], grade)).count() == 2
    assert part.filter(vr.path_predicate("[三]{攝}", ["組", "等"], grade)).count() == 0 and part.filter(vr.path_predicate("", ["組"], {})).count() == 0


def test_profiles_of_empty_tables(spark):
    rows = spark.createDataFrame([], "id int, region string, name string, x double")
    assert pf.flag_profile(rows, "region", {"a": F.col("x") > 1}).count() == 0
    assert pf.suffix_profile(rows, "region", "name", 3).count() == 0 and pf.character_lifts(rows, "region", "name").count() == 0
    assert pf.compared_counts(rows, rows, "name", 1, 3).count() == 0 and pf.similar_to(rows.withColumn("v", F.array("x")), "id", "v", rows, 3).count() == 0


def test_network_goes_to_the_heaviest_neighbours(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("a", "d", 2.0), ("c", "e", 5.0), ("e", "f", 1.0), ("a", "c", 2.0), ("g", "a", 9.0)]
    out = cmp.neighbour_network(spark.createDataFrame(edges, "a string, b string, weight double"), spark.createDataFrame([("a",)], "node string"), 2, 2)
    assert sorted((r.node, r.depth, r.weight) for r in out.collect()) == [("a", 0, None), ("c", 1, 3.0), ("e", 2, 5.0), ("g", 1, 9.0)]


def test_cross_table_and_its_marks(spark):
    """The rows of FIXTURES.md: a repeated item stays in the table; marks name polyphonic, literary, colloquial and both."""
    rows = [("測試點", c, "k", "a", "陰平", m) for c, m in (("A", 1), ("B", 2), ("B", 3), ("C", None))]
    df = spark.createDataFrame(rows, "location string, char string, initial string, final string, tone string, mark int")
    keys = ["location", "initial", "final", "tone"]
    assert [r["items"] for r in vr.cross_table(df, keys, "char").collect()] == ["ABBC"]
    out = vr.cross_marks(df, keys, "char", "mark").first()
    assert (out.several, out.second, out.third, out.both) == ("AB", "B", "B", "B")


def test_status_to_reading_classes(spark):
    """The request of FIXTURES.md: classes of the items of each value."""
    from lexigrid.operators import completions as cp

    rows = [("甲地", "a", "甲", 2), ("甲地", "a", "甲", 3), ("甲地", "a", "乙", 0), ("甲地", "b", "丙", 1), ("甲地", "b", "丙", 1)]
    out = cp.mark_classes(spark.createDataFrame(rows, "location string, value string, char string, mark int"), ["location", "value"], "char", "mark").collect()
    assert {(r.value, r["class"], r["items"]) for r in out} == {("a", cp.BOTH, "甲"), ("b", cp.SEVERAL, "丙")}


def test_tree_over_its_threshold_and_blank_levels(spark):
    from lexigrid.operators import completions as cp

    rows = [("p", "c", None, 2), ("p", "c", "d", 1), ("p", "", "e", 3), ('q"', "c", "d", 4)]
    out = {r.a: r.tree for r in cp.nested_tree(spark.createDataFrame(rows, "a string, b string, c string, id int"), ["a", "b", "c"], ["id"]).collect()}
    import json

    assert json.loads(out["p"]) == {"(空)": {"leaves": ["e"], "id": [3]}, "c": {"leaves": ["(空)", "d"], "id": [2, 1]}}
    assert json.loads(out['q"']) == {"c": {"leaves": ["d"], "id": [4]}}


def test_batch_changes_and_errors(spark):
    from lexigrid.operators import completions as cp

    schema = "id int, v string"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema)
    made = lambda x: spark.createDataFrame(x, schema)
    out, errors = cp.batch_changes(rows, "id", made([(1, "x"), (9, "n"), (9, "m")]), made([(2, "B"), (8, "y"), (3, "C")]), made([(3, None), (7, None)]))
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "B"), (9, "m")]
    assert sorted(map(tuple, errors.collect())) == [("create", 1, "exists"), ("create", 9, "repeated"), ("delete", 7, "missing"), ("update", 8, "missing")]
