"""Dendrograms, spanning trees and scaling against brute force."""

import itertools

import numpy as np
import pytest

from lexigrid.operators import linkage

random = np.random.RandomState(12)
POINTS = np.vstack([random.standard_normal((7, 2)) + c for c in ((0, 0), (12, 0), (0, 15))])


def table(spark, points, names):
    rows = [(int(names[i]), int(names[j]), float(np.linalg.norm(points[i] - points[j]))) for i, j in itertools.combinations(range(len(points)), 2)]
    rows += [(b, a, d + 1) for a, b, d in rows[:5]] + [(rows[0][0], rows[0][1], None), (3, 3, 0.0)]
    return spark.createDataFrame(rows, "a bigint, b bigint, distance double")


def greedy(points, names, kind):
    """height and the least items of the two clusters, merging the nearest two again and again."""
    clusters, out = {int(x): [i] for i, x in enumerate(names)}, []
    gap = lambda p, q: {"single": min, "complete": max, "average": lambda v: sum(v) / len(v)}[kind]([float(np.linalg.norm(points[i] - points[j])) for i in p for j in q])
    while len(clusters) > 1:
        d, a, b = min((gap(clusters[a], clusters[b]), a, b) for a, b in itertools.combinations(sorted(clusters), 2))
        out.append((round(d, 9), a, b))
        clusters[a] += clusters.pop(b)
    return out


@pytest.mark.parametrize("kind", ["average", "complete"])
def test_merges(spark, kind):
    names = random.permutation(21) * 10
    found = linkage.merges(table(spark, POINTS, names), kind).collect()
    assert sorted((round(r.height, 9), r.left, r.right) for r in found) == sorted(greedy(POINTS, names, kind))
    assert max(r["round"] for r in found) < 12 and max(r.n for r in found) == 21


def test_spanning_tree_and_labels(spark):
    names = random.permutation(21)
    rows = table(spark, POINTS, names)
    tree = linkage.spanning_tree(rows)
    heights = sorted(round(r.distance, 9) for r in tree.collect())
    assert heights == sorted(d for d, _, _ in greedy(POINTS, names, "single"))
    items = spark.createDataFrame([(int(x),) for x in range(21)], "node bigint")
    for joined in (tree, linkage.merges(rows, "average")):
        for k, size in ((3, 7), (1, 21), (21, 1)):
            got = {}
            for r in linkage.labels(items, joined, k).collect():
                got.setdefault(r.cluster, set()).add(r.node)
            assert len(got) == k and all(len(m) == size and min(m) == c for c, m in got.items())
        planted = {frozenset(int(x) for x in names[at : at + 7]) for at in (0, 7, 14)}
        three = {}
        for r in linkage.labels(items, joined, 3).collect():
            three.setdefault(r.cluster, set()).add(r.node)
        assert {frozenset(m) for m in three.values()} == planted


def test_what_is_not_linked_stays_apart(spark):
    rows = spark.createDataFrame([(1, 2, 1.0), (3, 4, 2.0), (4, 5, 3.0)], "a bigint, b bigint, distance double")
    items = spark.createDataFrame([(k,) for k in range(1, 7)], "node bigint")
    assert {(r.node, r.cluster) for r in linkage.labels(items, linkage.spanning_tree(rows), 1).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6)}
    assert sorted((r.left, r.right) for r in linkage.merges(rows, "complete").collect()) == [(1, 2), (3, 4)]  # 3 and 5 have no distance
    empty = rows.limit(0)
    assert linkage.spanning_tree(empty).count() == linkage.merges(empty, "average").count() == 0
    with pytest.raises(ValueError):
        linkage.merges(rows, "ward")


def test_scaled(spark):
    points = random.standard_normal((30, 3)) * [5, 2, 1]
    names = random.permutation(30)
    rows = table(spark, points, names)
    got = {r.node: np.array(r.coordinates) for r in linkage.scaled(rows, 4).collect()}
    d = np.zeros((30, 30))
    for r in linkage.pairs_of(rows).collect():
        d[r.a, r.b] = d[r.b, r.a] = r.distance
    centre = np.eye(30) - 1 / 30
    values, vectors = np.linalg.eigh(-0.5 * centre @ d**2 @ centre)
    order = np.argsort(-values)[:4]
    expected = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    expected *= np.where(expected[np.abs(expected).argmax(axis=0), np.arange(4)] < 0, -1, 1)
    assert np.allclose(np.array([got[k] for k in range(30)]), expected, atol=1e-4)
    with pytest.raises(ValueError):
        linkage.scaled(rows.filter("a + b <> 7"), 2)


def test_inputs_are_evaluated_a_fixed_number_of_times(spark):
    """Distances once in a dendrogram; tokens once for the locations and on both sides of the alignment in a matrix."""
    from pyspark.sql import functions as F

    from lexigrid.operators import distances

    seen = spark.sparkContext.accumulator(0)

    def counting(x):
        seen.add(1)
        return x

    counted = F.udf(counting, "bigint").asNondeterministic()
    rows = spark.createDataFrame([(a, b, float((a * 7 + b * 3) % 11 + 1)) for a in range(6) for b in range(a)], "a bigint, b bigint, distance double")
    assert linkage.merges(rows.withColumn("a", counted("a")), "average").count() == 5
    assert seen.value == 15
    seen.value = 0
    found = spark.createDataFrame([("g", k % 4, k // 4, f"t{k % 3}") for k in range(40)], "group string, location bigint, item bigint, token string").withColumn("location", counted("location"))
    weights = spark.createDataFrame([("g", 1.0)], "group string, weight double")
    assert distances.distance_matrix(found, weights).count() == 6
    assert seen.value <= 3 * 40
