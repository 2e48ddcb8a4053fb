"""Clusters and coordinates from a table of distances (survey group ADV).

Distances are rows a, b, distance, each pair once, of items or of the ends of a graph; what isn't in the table isn't linked, so
items stay apart where nothing joins them. Null distances are left out; of repeated pairs the least counts. Ties are decided by
(distance, a, b), so results don't depend on the order of rows. Where a merge's height equals another's, other dendrograms of
the same heights may be as right.

Rounds are written to the shared folder, the tables of the round before deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.structures import bounded
from lexigrid.sources.tables import Rounds

MERGES = "height double, round int, left bigint, right bigint, n bigint"


def pairs_of(distances: DataFrame) -> DataFrame:
    """a < b and the least distance of each pair."""
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    rows = distances.filter("distance IS NOT NULL AND a <> b").select(low, high, F.col("distance").cast("double").alias("distance"))
    return rows.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def roots(parents: DataFrame, steps: Rounds, name: str = "roots") -> DataFrame:
    """node and root of a forest (node, parent; a root is its own parent), by doubling."""
    found = steps.written(parents.select("node", F.col("parent").alias("root")), name)
    while True:
        further = found.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = steps.written(found.join(further, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("on")), name)
        found = moved.select("node", "root")
        if moved.filter("on").isEmpty():
            return found


def spanning_tree(distances: DataFrame) -> DataFrame:
    """a, b, distance of the lightest spanning forest, by Boruvka's rounds: every component takes its lightest edge to another one, so
    components at least halve, and edges inside a component drop out. These are the merges of single linkage."""
    steps = Rounds(distances.sparkSession)
    edges = steps.written(pairs_of(distances).select("a", "b", "distance", F.col("a").alias("la"), F.col("b").alias("lb")), "edges")
    tree = None
    turn = 0
    while not edges.isEmpty():
        edge = F.struct("distance", "a", "b")
        sides = edges.select(F.col("la").alias("node"), F.col("lb").alias("other"), edge.alias("e")).unionByName(edges.select(F.col("lb").alias("node"), F.col("la").alias("other"), edge.alias("e")))
        best = steps.written(sides.groupBy("node").agg(F.min(F.struct("e", "other")).alias("m")).select("node", F.col("m.other").alias("other"), "m.e.*"), "best")
        chosen = best.select("a", "b", "distance").distinct()
        tree = steps.written(chosen if tree is None else tree.unionByName(chosen), "tree")
        # Two components that chose the same edge chose each other: the smaller is the root.
        back = best.select(F.col("node").alias("other"), F.col("other").alias("back"))
        parents = best.join(back, "other").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("other")), F.col("node")).otherwise(F.col("other")).alias("parent"))
        label = roots(parents, steps)
        named = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"{c}_"))
        joined = edges.join(named("la"), "la").join(named("lb"), "lb").filter("la_ <> lb_")
        edges = steps.written(joined.select("a", "b", "distance", F.col("la_").alias("la"), F.col("lb_").alias("lb")), "edges")
        turn += 1
    return pairs_of(distances) if tree is None else tree


def merges(distances: DataFrame, linkage: str) -> DataFrame:
    """height, round, left, right, n: the merges of average or complete linkage, of at most MOST_KEYS items. A cluster is named by its
    least item; left < right; n: the items that they have together.

    In each round all clusters that are each other's nearest merge: for these linkages later merges don't come between them, so
    the result is that of merging the nearest two again and again. Distances between clusters are sums (average) or maxima
    (complete) of those of their parts, so a round adds up the table under the new names."""
    if linkage not in ("average", "complete"):
        raise ValueError("linkage is average or complete; single linkage is the spanning tree")
    spark = distances.sparkSession
    steps = Rounds(spark)
    pairs = steps.written(pairs_of(distances), "pairs")  # read three times
    items = bounded(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sizes = steps.written(items.select("node", F.lit(1).cast("long").alias("n")), "sizes")
    table = steps.written(pairs.select("a", "b", F.col("distance").alias("total"), F.lit(1).cast("long").alias("pairs")), "table")
    out, turn = spark.createDataFrame([], MERGES), 0
    while not table.isEmpty():
        # Clusters some of whose items lack a distance aren't compared.
        ends = lambda c: sizes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
        whole = table.join(ends("a"), "a").join(ends("b"), "b").filter("pairs = n_a * n_b")
        height = F.col("total") / (F.col("pairs") if linkage == "average" else 1)
        pair = F.struct(height.alias("height"), "a", "b", (F.col("n_a") + F.col("n_b")).alias("n"))
        near = whole.select("a", "b", pair.alias("p")).select(F.explode(F.array("a", "b")).alias("node"), "p").groupBy("node").agg(F.min("p").alias("p"))
        mutual = near.groupBy("p").agg(F.count("*").alias("k")).filter("k = 2").select("p.*")
        found = steps.written(mutual.select("height", F.lit(turn).alias("round"), F.col("a").alias("left"), F.col("b").alias("right"), "n"), "found")
        if found.isEmpty():
            break
        out = steps.written(out.unionByName(found), "merges")
        name = found.select(F.col("right").alias("old"), F.col("left").alias("new"))
        renamed = lambda df, c: df.join(F.broadcast(name).withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        moved = renamed(renamed(table, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", "pairs")
        table = steps.written(moved.groupBy("a", "b").agg((F.sum if linkage == "average" else F.max)("total").alias("total"), F.sum("pairs").alias("pairs")), "table")
        sizes = steps.written(renamed(sizes, "node").groupBy("node").agg(F.sum("n").alias("n")), "sizes")
        turn += 1
    return out


def labels(items: DataFrame, joined: DataFrame, k: int) -> DataFrame:
    """node and cluster (its least item): the items in k clusters, or more where nothing joins them. joined: merges, or the edges of
    a spanning tree; all but the k - 1 last ones hold."""
    steps = Rounds(items.sparkSession)
    if "left" in joined.columns:
        links = joined.select("height", "round", F.col("left").alias("a"), F.col("right").alias("b"))
    else:
        links = joined.select(F.col("distance").alias("height"), F.lit(0).alias("round"), "a", "b")
    order = [F.desc(c) for c in ("height", "round", "a", "b")]
    n_items, n_links = items.select("node").distinct().count(), links.count()
    last = links.orderBy(*order).limit(max(0, min(n_links, k - (n_items - n_links)))).select("a", "b")
    held = steps.written(links.join(F.broadcast(last), ["a", "b"], "left_anti").select("a", "b"), "held")
    both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = steps.written(items.select("node", F.col("node").alias("cluster")).distinct(), "labels")
    while True:
        near = both.join(found.select(F.col("node").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("near"))
        lower = found.join(near, "node", "left").select("node", "cluster", F.least("cluster", "near").alias("next"))
        jump = found.select(F.col("node").alias("next"), F.col("cluster").alias("further"))
        moved = steps.written(lower.join(jump, "next", "left").select("node", "cluster", F.least("next", "further").alias("next")), "labels")
        found = moved.select("node", F.col("next").alias("cluster"))
        if moved.filter("next < cluster").isEmpty():
            return found


def scaled(distances: DataFrame, k: int, rounds: int = 60, seed: int = 7) -> DataFrame:
    """node and k coordinates (0 beyond the positive dimensions) whose distances are as near as can be to those given: classical
    scaling, of at most MOST_KEYS items with a distance for each pair.

    The table stays where it is: row means of squares centre it, and each round of block power iteration multiplies it with a block
    of vectors, which is sent to the tasks and comes back summed by item: items x (k + 4) numbers at most. Rounds end when the
    values settle. Signs are set so that each coordinate's largest is positive.
    """
    pairs = pairs_of(distances)
    steps = Rounds(distances.sparkSession)
    squares = steps.written(pairs.select("a", "b", (F.col("distance") * F.col("distance")).alias("s")), "squares")
    sums = bounded(squares.select(F.explode(F.array("a", "b")).alias("node"), "s").groupBy("node").agg(F.sum("s").alias("s"), F.count("*").alias("n"))).orderBy("node").collect()
    nodes = np.array([r.node for r in sums], np.int64)
    n = len(nodes)
    if any(r.n != n - 1 for r in sums):
        raise ValueError("scaling takes a distance for each pair")
    mean = np.array([r.s / n for r in sums]) if n else np.zeros(0)
    whole = mean.mean() if n else 0.0
    width = min(n, k + 4)

    def product(block: np.ndarray) -> np.ndarray:
        """The centred table times the block. Only the squares are with the tasks; the means are added here."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((n, width))
            for batch in batches:
                a, b = (np.searchsorted(nodes, batch.column(c).to_numpy()) for c in (0, 1))
                s = batch.column(2).to_numpy()[:, None]
                for c in range(width):
                    out[:, c] += np.bincount(a, (s * block[b])[:, c], n) + np.bincount(b, (s * block[a])[:, c], n)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

        total = np.zeros((n, width))
        for r in squares.mapInArrow(part, "part binary").toLocalIterator():
            total += np.frombuffer(r.part).reshape(n, width)
        down = block.sum(axis=0)
        return -0.5 * (total - mean[:, None] * down - (mean @ block) + whole * down)

    if n < 2:
        rows = [(int(x), [0.0] * k) for x in nodes]
    else:
        block = np.linalg.qr(np.random.RandomState(seed).standard_normal((n, width)))[0]
        before = None
        for _ in range(rounds):
            moved = product(block)
            small = block.T @ moved
            values, turn = np.linalg.eigh((small + small.T) / 2)
            if before is not None and np.allclose(values, before, rtol=1e-9, atol=1e-12):
                break
            before = values
            block = np.linalg.qr(moved)[0]
        order = np.argsort(-values)[:k]
        found = (block @ turn)[:, order] * np.sqrt(np.where(values[order] > 1e-12, values[order], 0))
        found *= np.where(found[np.abs(found).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
        rows = [(int(x), [float(v) for v in c] + [0.0] * (k - len(c))) for x, c in zip(nodes, found)]
    return distances.sparkSession.createDataFrame(rows, "node bigint, coordinates array<double>")
