"""A spatial index of polygon parts as a table: built once, then read for points and geometries (survey groups SRC, ADV, FN).

Each part of a geometry is cut into horizontal bands of about EDGES edges, so that no row holds a long outline, and a point
meets one band of a part at most. A band is filed under the cells of a quadtree that its box touches, at the deepest level
whose cells are as large as the box: four cells at most, whether it is a yard or a continent. Cells are named by level and
key, the Morton code of their first cell at the deepest level. The table is partitioned by zone, the key's first digits (or
WIDE for larger cells), and ordered by key in its files, so that a look-up reads the zones, files and row groups that it may need.

A point is in a feature if it is in some part's outer ring and in none of its holes. Geometries are lists of polygons, these of
rings (the outer one first), these of points (x, y), closed or not. Null and empty geometries, rings of fewer than three points
and points outside the square of the tree are found by nothing. Ids needn't be unique: equal ids are one feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrid.operators.places import geometries_meet, with_box

#: Levels of the tree below its root; edges of a band, about; points whose keys go into the reader's filter.
DEPTH, EDGES, FEW = 24, 64, 500
#: Boxes of a feature's earlier bands that a row of the index holds at most.
EARLIER = 16
WIDE = -1
#: Points and bands of a cell that one group compares, about.
TILE_POINTS, TILE_BANDS = 8192, 256


@dataclass(frozen=True)
class Tree:
    """A square that is cut into four again and again; zones are its cells at zone_level."""

    x: float = -180.0
    y: float = -180.0
    size: float = 360.0
    zone_level: int = 4

    def cell(self, value: Column, low: float, level: Column | int) -> Column:
        """The number of the cell at that level, along one side."""
        deepest = F.floor((value - low) * F.lit(2.0**DEPTH / self.size)).cast("long")
        return F.call_function("shiftright", deepest, F.lit(DEPTH) - level)

    def level_of(self, extent: Column) -> Column:
        """The deepest level with cells of that extent or more."""
        return F.least(F.lit(DEPTH), F.greatest(F.lit(0), F.floor(F.log2(F.lit(self.size) / F.nullif(extent, F.lit(0.0)))))).cast("int")

    def zone(self, key: Column, level: Column) -> Column:
        code = F.call_function("shiftright", key, F.lit(2 * (DEPTH - self.zone_level)))
        return F.when(level >= self.zone_level, code).otherwise(WIDE).cast("int")

    def inside(self, x: Column, y: Column) -> Column:
        return (x >= self.x) & (x < self.x + self.size) & (y >= self.y) & (y < self.y + self.size)


def _spread(n: Column) -> Column:
    """The 24 bits of a number with a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = (n.bitwiseOR(F.shiftleft(n, shift))).bitwiseAND(F.lit(mask).cast("long"))
    return n


def key_of(cx: Column, cy: Column, level: Column | int) -> Column:
    """The key of the cell with those numbers at that level."""
    return F.call_function("shiftleft", _spread(cx).bitwiseOR(F.shiftleft(_spread(cy), 1)), (F.lit(2) * (F.lit(DEPTH) - level)).cast("int"))


def bands(features: DataFrame) -> DataFrame:
    """feature_id, part_id, edges (x0, y0, x1, y1, ring) and the box of each band of each part, and the band's own y_low and y_high."""
    parts = features.select("feature_id", F.explode("geometry").alias("part")).withColumn("part", F.filter("part", lambda ring: F.size(ring) >= 3))
    ys = F.transform(F.flatten("part"), lambda p: p["y"])
    parts = parts.filter(F.size("part") > 0).select(F.monotonically_increasing_id().alias("part_id"), "*", F.size(ys).alias("n"), F.array_min(ys).alias("bottom"), F.array_max(ys).alias("top"))
    rings = parts.select("feature_id", "part_id", "n", "bottom", "top", F.posexplode("part").alias("ring", "points"))
    edge = lambda p, q, ring: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"), ring.alias("ring"))
    turned = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    edges = rings.select("feature_id", "part_id", "n", "bottom", "top", F.explode(F.zip_with("points", turned, lambda p, q: edge(p, q, F.col("ring")))).alias("e"))
    low, high = F.least("e.y0", "e.y1"), F.greatest("e.y0", "e.y1")
    height = F.greatest((F.col("top") - F.col("bottom")) / F.ceil(F.col("n") / EDGES), F.lit(1e-300))
    number = lambda y: F.least(F.ceil(F.col("n") / EDGES) - 1, F.floor((y - F.col("bottom")) / height))
    laid = edges.select("feature_id", "part_id", "e", "bottom", height.alias("height"), "n", F.explode(F.sequence(number(low), number(high))).alias("band"))
    box = [F.min(F.least("e.x0", "e.x1")).alias("x0"), F.max(F.greatest("e.x0", "e.x1")).alias("x1"), F.min(low).alias("y0"), F.max(high).alias("y1")]
    made = laid.groupBy("feature_id", "part_id", "band").agg(F.collect_list("e").alias("edges"), *box, F.min("bottom").alias("bottom"), F.min("height").alias("height"), F.first("n").alias("n"))
    y_low = F.col("bottom") + F.col("band") * F.col("height")
    last = F.col("band") == F.ceil(F.col("n") / EDGES) - 1
    # The box of a band ends with the band, so a tall edge doesn't widen it.
    return made.select("feature_id", "part_id", "edges", "x0", "x1", F.greatest("y0", y_low).alias("y0"), F.when(last, F.col("y1")).otherwise(F.least("y1", y_low + F.col("height"))).alias("y1"), F.col("band").alias("band"), "bottom", "height", "n")


def build(features: DataFrame, path: str, tree: Tree = Tree(), rows_a_file: int = 200_000) -> str:
    """Writes the index of features (feature_id, geometry) and gives its path."""
    rows = bands(features).filter(tree.inside(F.col("x0"), F.col("y0")) & tree.inside(F.col("x1"), F.col("y1")))
    order = Window.partitionBy("feature_id").orderBy("x0", "y0", "x1", "y1", "band")
    box = F.when(F.col("nth") <= EARLIER, F.struct("x0", "y0", "x1", "y1"))
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("earlier", F.collect_list(box).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # Whether no other part of the feature may hold a point of the row's box too: a point is in one band of a part at most.
    whole = Window.partitionBy("feature_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    laid = F.collect_list(F.when(F.col("nth") <= EARLIER, F.struct("part_id", "x0", "y0", "x1", "y1"))).over(whole)
    rows = rows.select("*", laid.alias("laid"), (F.min("part_id").over(whole) == F.max("part_id").over(whole)).alias("single"), (F.max("nth").over(whole) <= EARLIER).alias("few"))
    over = lambda b: (b["part_id"] != F.col("part_id")) & (b["x0"] <= F.col("x1")) & (F.col("x0") <= b["x1"]) & (b["y0"] <= F.col("y1")) & (F.col("y0") <= b["y1"])
    rows = rows.withColumn("alone", F.col("single") | (F.col("few") & ~F.exists("laid", over))).drop("laid", "single", "few", "part_id")
    rows = rows.withColumn("level", tree.level_of(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))))
    span = lambda low, high, at: F.explode(F.sequence(tree.cell(F.col(low), at, F.col("level")), tree.cell(F.col(high), at, F.col("level"))))
    rows = rows.select("*", span("x0", "x1", tree.x).alias("cx")).select("*", span("y0", "y1", tree.y).alias("cy"))
    rows = rows.withColumn("key", key_of(F.col("cx"), F.col("cy"), F.col("level"))).drop("cx", "cy")
    rows = rows.withColumn("zone", tree.zone(F.col("key"), F.col("level")))
    ordered = rows.repartitionByRange("zone", "key").sortWithinPartitions("zone", "key", "level")
    ordered.write.option("maxRecordsPerFile", rows_a_file).option("parquet.block.size", 8 << 20).partitionBy("zone").parquet(path)
    return path


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _levels(rows: DataFrame) -> list[int]:
    """The levels in use, 25 at most."""
    return sorted(r[0] for r in rows.select("level").distinct().collect())


def _held(points: pa.Table, bands: pa.Table) -> pa.Table:
    """point_id and feature_id where a band (see bands()) holds a point: a ray to the right meets the outer ring an odd number of times,
    and each hole an even one."""
    points, bands = points.combine_chunks(), bands.combine_chunks()
    xs, ys = (points.column(c).to_numpy() for c in ("x", "y"))
    col = {c: bands.column(c).to_numpy() for c in ("x0", "x1", "band", "bottom", "height", "n")}
    last = np.ceil(col["n"] / EDGES) - 1
    edges = pa.concat_arrays(bands.column("edges").chunks)
    flat = edges.flatten()
    starts = np.concatenate([[0], np.cumsum(edges.value_lengths().to_numpy())])
    ex0, ey0, ex1, ey1, ring = (f.to_numpy() for f in flat.flatten())
    order = np.argsort(xs, kind="stable")
    sorted_x, found, whose = xs[order], [], []
    for k in range(len(last)):
        at = order[np.searchsorted(sorted_x, col["x0"][k], "left") : np.searchsorted(sorted_x, col["x1"][k], "right")]
        y = ys[at]
        # A point is in one band of a part: from the band's beginning up to the next one's.
        own = (y >= col["bottom"][k]) & (np.minimum(last[k], np.floor((y - col["bottom"][k]) / col["height"][k])) == col["band"][k])
        at = at[own]
        if not len(at):
            continue
        x, y = xs[at], ys[at]
        odd: dict[int, np.ndarray] = {}
        for e in range(starts[k], starts[k + 1]):
            if ey0[e] != ey1[e]:
                crosses = ((ey0[e] > y) != (ey1[e] > y)) & (x < (ex1[e] - ex0[e]) * (y - ey0[e]) / (ey1[e] - ey0[e]) + ex0[e])
                odd[ring[e]] = odd[ring[e]] ^ crosses if ring[e] in odd else crosses
        inside = odd.pop(0, np.zeros(len(at), bool))
        for hole in odd.values():
            inside = inside & ~hole
        found.append(at[inside])
        whose.append(np.full(len(found[-1]), k))
    one, two = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found, whose))
    return pa.table({"point_id": points.column("point_id").take(pa.array(one)), "feature_id": bands.column("feature_id").take(pa.array(two))})


def _pairs(spread: DataFrame, index: DataFrame) -> DataFrame:
    """The pairs of points and bands of the same cell, in tiles of a cell: a row for each pair that is found, and no pair is shuffled."""
    cell = ["zone", "level", "key"]
    sizes = spread.groupBy(*cell).agg(F.count("*").alias("np")).join(index.groupBy(*cell).agg(F.count("*").alias("nb")), cell)
    sizes = sizes.select(*cell, F.ceil(F.col("np") / TILE_POINTS).cast("int").alias("np"), F.ceil(F.col("nb") / TILE_BANDS).cast("int").alias("nb"))
    dealt = lambda rows, by, own, of, other, many: rows.join(sizes, cell).select(*rows.columns, F.pmod(F.xxhash64(*by), F.col(of)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(many) - 1)).alias(other))
    bands = index.select("feature_id", "edges", "x0", "x1", "y0", "band", "bottom", "height", "n", *cell)
    points = dealt(spread.select("point_id", "x", "y", *cell), ("point_id", "x", "y"), "tp", "np", "tb", "nb")
    bands = dealt(bands, ("feature_id", "x0", "y0", "band"), "tb", "nb", "tp", "np").drop("y0")
    tile = [*cell, "tp", "tb"]
    schema = StructType([spread.schema["point_id"], index.schema["feature_id"]])
    return points.groupBy(*tile).cogroup(bands.groupBy(*tile)).applyInArrow(lambda p, b: _held(p, b) if len(p) and len(b) else pa.table({"point_id": p.column("point_id")[:0], "feature_id": b.column("feature_id")[:0]}), schema)


def at_points(index: DataFrame, points: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """point_id and feature_id of the features that hold each point (point_id, x, y).

    Each point has one cell at each level in use, so the join is by (zone, level, key). The keys of up to FEW points are
    pushed into the reader; more are joined, and Spark prunes zones by the points where it broadcasts them.
    Pairs are made distinct only where parts of a feature may overlap, or if a point id is repeated.
    """
    levels = F.array(*map(F.lit, _levels(index) or [0]))
    spread = points.select("point_id", "x", "y").filter(tree.inside(F.col("x"), F.col("y"))).select("*", F.explode(levels).alias("level"))
    spread = spread.withColumn("key", key_of(tree.cell(F.col("x"), tree.x, F.col("level")), tree.cell(F.col("y"), tree.y, F.col("level")), F.col("level")))
    spread = spread.withColumn("zone", tree.zone(F.col("key"), F.col("level")))
    if points.limit(FEW + 1).count() <= FEW:
        asked = spread.select("zone", "key").distinct().collect()
        index = index.filter(F.col("zone").isin(sorted({r.zone for r in asked})) & F.col("key").isin(sorted({r.key for r in asked})))
    if not points.groupBy("point_id").count().filter("count > 1").isEmpty():
        return _pairs(spread, index).distinct()
    found = _pairs(spread, index.filter("alone"))
    return found if index.filter("NOT alone").isEmpty() else found.unionByName(_pairs(spread, index.filter("NOT alone")).distinct())


def boxes_meeting(index: DataFrame, queries: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """query_id and feature_id where a band's box meets that of a query (query_id, x0, y0, x1, y1).

    Of two cells that meet, one holds the other: index rows of a query's level or above are looked up by the query's cell at their
    level, deeper ones by their own cell at the query's level. Of the cells of a pair the one with the lower left corner of what the
    boxes share counts, and of a feature's bands the first that meets, so pairs are found once and not shuffled; only if a
    feature has more bands than EARLIER or a query id is repeated, they are made distinct.
    """
    rows = queries.select("query_id", *(F.col(c).alias(f"q{c}") for c in ("x0", "y0", "x1", "y1")))
    rows = rows.filter(tree.inside(F.col("qx0"), F.col("qy0")) & tree.inside(F.col("qx1"), F.col("qy1")))
    rows = rows.withColumn("qlevel", tree.level_of(F.greatest(F.col("qx1") - F.col("qx0"), F.col("qy1") - F.col("qy0"))))
    span = lambda low, high, at: F.explode(F.sequence(tree.cell(F.col(low), at, F.col("qlevel")), tree.cell(F.col(high), at, F.col("qlevel"))))
    rows = rows.select("*", span("qx0", "qx1", tree.x).alias("cx")).select("*", span("qy0", "qy1", tree.y).alias("cy"))
    rows = rows.withColumn("qkey", key_of(F.col("cx"), F.col("cy"), F.col("qlevel"))).drop("cx", "cy")
    bare = index.select("feature_id", "x0", "y0", "x1", "y1", "zone", "level", "key", "earlier")
    up = lambda key, level: F.call_function("shiftleft", F.call_function("shiftright", key, F.lit(2) * (F.lit(DEPTH) - level)), F.lit(2) * (F.lit(DEPTH) - level))
    levels = F.array(*map(F.lit, _levels(index) or [0]))
    above = rows.select("*", F.explode(levels).alias("level")).filter("level <= qlevel").withColumn("key", up(F.col("qkey"), F.col("level")))
    above = above.withColumn("zone", tree.zone(F.col("key"), F.col("level")))
    asked = F.array(*map(F.lit, _levels(rows.select(F.col("qlevel").alias("level"))) or [0]))
    below = bare.select("*", F.explode(asked).alias("qlevel")).filter("level > qlevel").withColumn("qkey", up(F.col("key"), F.col("qlevel")))
    touch = lambda x0, y0, x1, y1: (x0 <= F.col("qx1")) & (F.col("qx0") <= x1) & (y0 <= F.col("qy1")) & (F.col("qy0") <= y1)
    meets = touch(*map(F.col, ("x0", "y0", "x1", "y1"))) & ~F.exists("earlier", lambda e: touch(e["x0"], e["y0"], e["x1"], e["y1"]))
    corner = lambda level: key_of(tree.cell(F.greatest("x0", "qx0"), tree.x, level), tree.cell(F.greatest("y0", "qy0"), tree.y, level), level)
    found = above.join(bare, ["zone", "level", "key"]).filter(meets & (corner(F.col("qlevel")) == F.col("qkey"))).select("query_id", "feature_id")
    found = found.unionByName(rows.join(below, ["qlevel", "qkey"]).filter(meets & (corner(F.col("level")) == F.col("key"))).select("query_id", "feature_id"))
    once = index.filter(F.col("nth") > EARLIER).isEmpty() and queries.groupBy("query_id").count().filter("count > 1").isEmpty()
    return found if once else found.distinct()


def meeting(index: DataFrame, features: DataFrame, queries: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """query_id and feature_id of the features that share a point with each query (query_id, shape). Boxes are found in the index;
    geometries are joined by id for the pairs that are left."""
    boxed = with_box(queries, "shape")
    pairs = boxes_meeting(index, boxed, tree)
    full = pairs.join(boxed.select("query_id", "shape"), "query_id").join(features.select("feature_id", "geometry"), "feature_id")
    return full.filter(geometries_meet(F.col("shape"), F.col("geometry"))).select("query_id", "feature_id").distinct()
