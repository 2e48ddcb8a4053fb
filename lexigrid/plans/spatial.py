"""Queries of the spatial index. Features are diamonds with a diamond hole around the vectors' first two numbers, one in fifty
very wide, some of two parts; points are the next two numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.operators import spatial
from lexigrid.plans.queries import query
from lexigrid.sources.tables import shared_path, table

TREE = spatial.Tree(-64.0, -64.0, 128.0, 9)
_V = "(SELECT vec_id, embedding[1]::DOUBLE AS cx, embedding[2]::DOUBLE AS cy, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y, CASE WHEN vec_id % 50 = 0 THEN 0.5 ELSE 0.01 + 0.002 * (vec_id % 5) END::DOUBLE AS r FROM embeddings)"
_GAP = "(abs(p.x - f.cx) + abs(p.y - f.cy))"


def _number(k):
    return F.get("embedding", F.lit(k)).cast("double")


def _features(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", _number(0).alias("cx"), _number(1).alias("cy"), F.when(F.col("vec_id") % 50 == 0, 0.5).otherwise(0.01 + 0.002 * (F.col("vec_id") % 5)).alias("r"))
    corner = lambda x, y, r, dx, dy: F.struct((x + dx * r).alias("x"), (y + dy * r).alias("y"))
    diamond = lambda x, y, r: F.array(*(corner(x, y, r, dx, dy) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))))
    x, y, r = F.col("cx"), F.col("cy"), F.col("r")
    first, second = F.array(diamond(x, y, r), diamond(x, y, r * 0.3)), F.array(diamond(x + 3 * r, y, r * 0.5))
    return rows.filter("cx IS NOT NULL AND cy IS NOT NULL").select(F.col("vec_id").alias("feature_id"), F.when(F.col("vec_id") % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("geometry"))


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), _number(2).alias("x"), _number(3).alias("y"))


def _index(spark, d):
    return spatial.opened(spark, spatial.build(_features(spark, d), shared_path(spark, "spatial-index"), TREE))


@query(f"""SELECT p.vec_id AS point_id, f.vec_id AS feature_id FROM {_V} p JOIN {_V} f
ON ({_GAP} < f.r AND {_GAP} > 0.3 * f.r) OR (f.vec_id % 3 = 0 AND abs(p.x - f.cx - 3 * f.r) + abs(p.y - f.cy) < 0.5 * f.r)""")
def src23_indexed_points(spark, d):
    return spatial.at_points(_index(spark, d), _points(spark, d), TREE)


@query(f"""SELECT p.vec_id AS query_id, f.vec_id AS feature_id FROM {_V} p JOIN {_V} f
ON abs(p.x - f.cx) <= f.r + 0.01 AND abs(p.y - f.cy) <= f.r + 0.01 OR (f.vec_id % 3 = 0 AND abs(p.x - f.cx - 3 * f.r) <= 0.5 * f.r + 0.01 AND abs(p.y - f.cy) <= 0.5 * f.r + 0.01)""")
def src21_indexed_boxes(spark, d):
    box = _points(spark, d).select(F.col("point_id").alias("query_id"), *((F.col(c) + s).alias(f"{c}{k}") for k, s in ((0, -0.01), (1, 0.01)) for c in ("x", "y")))
    return spatial.boxes_meeting(_index(spark, d), box, TREE)
