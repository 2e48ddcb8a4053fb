"""Locations by name and region, and geometry (survey groups FLT, ADV, JOIN, FN, SRC).

A geometry is an array of polygons, a polygon an array of rings (the first outside, the others holes), a ring an array of
points with x and y. An empty or null geometry holds nothing and is infinitely far (null).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.structures import bounded, inside_ring
from lexigrid.sources.tables import Rounds

METRES_A_DEGREE = 111_320.0
POINTS = "array<array<array<struct<x:double,y:double>>>>"


def directly_administered(city: str, county: str, given_city: str, given_county: str | None) -> Column:
    """Rows of a county of a city; a city without a county means rows whose county is null or empty."""
    at = F.col(county) == given_county if given_county else F.col(county).isNull() | (F.col(county) == "")
    return (F.col(city) == given_city) & at


def regions_of(locations: DataFrame, wanted: DataFrame) -> DataFrame:
    """location and path of the wanted locations; those not known have a null path."""
    return wanted.select("location").distinct().join(locations.select("location", "path"), "location", "left")


def resolved_locations(locations: DataFrame, regions: DataFrame, literal: DataFrame, stored: Column | None = None) -> DataFrame:
    """location and tier: 1 for those whose path equals a wanted region, 2 for those with a region that no path equals as an
    element of their path, 3 for literal locations; each location once, with its least tier.

    locations: location, path; regions: region; literal: location. stored: locations that count for regions."""
    used = locations if stored is None else locations.filter(stored)
    wanted = regions.select(F.trim("region").alias("region")).distinct()
    exact = used.join(wanted, F.col("path") == F.col("region")).select("location", "region")
    missing = wanted.join(exact, "region", "left_anti")
    element = used.select("location", F.explode(F.array_distinct(F.split("path", "-"))).alias("region")).join(missing, "region")
    tiers = [exact.select("location", F.lit(1).alias("tier")), element.select("location", F.lit(2).alias("tier")), literal.select(F.trim("location").alias("location"), F.lit(3).alias("tier"))]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).groupBy("location").agg(F.min("tier").alias("tier"))


def without_special(locations: DataFrame, special: Column, keep_special: bool = False) -> DataFrame:
    """location and kind: year (begins with a year from 1800 to 2099), special, or kept."""
    year = F.rlike(F.trim("location"), F.lit("^(18|19|20)[0-9]{2}"))
    kind = F.when(year, "year").when(F.lit(not keep_special) & F.coalesce(special, F.lit(False)), "special").otherwise("kept")
    return locations.withColumn("kind", kind)


def partition_levels(paths: DataFrame, path: str) -> DataFrame:
    """level (1 to 3), name, parent and the sorted children, joined by commas, of every part of a-b-c paths; deeper parts
    don't count."""
    parts = F.split(F.trim(path), "-")
    steps = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(3))), lambda k: F.struct(k.alias("level"), F.element_at(parts, k).alias("name"), F.when(k > 1, F.element_at(parts, k - 1)).alias("parent"), F.when((k < 3) & (k < F.size(parts)), F.element_at(parts, k + 1)).alias("child")))
    each = paths.filter(F.col(path).isNotNull()).select(F.inline(steps)).distinct()
    return each.groupBy("level", "name", "parent").agg(F.array_join(F.array_sort(F.collect_set("child")), ",").alias("children"))


def matched_names(names: DataFrame, terms: DataFrame) -> DataFrame:
    """term, name and tier: 1 equal, 2 prefix, 3 contained, for the names that a term's variants match, with the least tier.

    names: name; terms: term, variant (a variant of itself too). The terms of a request are few (5,000 at most): a cross join
    with them broadcast reads the names once."""
    hit = F.when(F.col("name") == F.col("variant"), 1).when(F.startswith("name", F.col("variant")), 2).when(F.contains("name", F.col("variant")), 3)
    asked = bounded(terms.select("term", "variant").filter("variant <> ''").distinct())
    met = names.select("name").distinct().crossJoin(F.broadcast(asked))
    return met.withColumn("tier", hit).filter("tier IS NOT NULL").groupBy("term", "name").agg(F.min("tier").alias("tier"))


def near_lengths(names: DataFrame, name: str, term: str, most: int, gap: int = 3) -> DataFrame:
    """Names whose length is within `gap` of the term's, or with its first character: at most so many, nearest lengths
    first, ties by name."""
    apart = F.abs(F.length(name) - len(term))
    some = (apart <= gap) | F.startswith(name, F.lit(term[:1]))
    return names.select(name).distinct().filter(some & (F.length(name) > 1)).orderBy(apart, name).limit(most)


def spans(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Bounding box, mean centre, planar extent in kilometres (111 a degree) and number of points by key; the box of one
    point has extent 0."""
    km = F.sqrt(F.pow(F.max(x) - F.min(x), F.lit(2.0)) + F.pow(F.max(y) - F.min(y), F.lit(2.0))) * 111
    return points.groupBy(*keys).agg(F.min(x).alias("x_least"), F.max(x).alias("x_most"), F.min(y).alias("y_least"), F.max(y).alias("y_most"), F.round(F.avg(x), 6).alias("x_mean"), F.round(F.avg(y), 6).alias("y_mean"), F.round(km, 6).alias("extent_km"), F.count("*").alias("n"))


def zoom(span: Column) -> Column:
    """The map zoom level that shows a span of degrees: 360 degrees at level 0, half at each further one, 0 to 18."""
    return F.greatest(F.lit(0), F.least(F.lit(18), F.floor(F.log2(F.lit(360.0) / F.nullif(span, F.lit(0.0)))))).cast("int")


def _closed(ring: Column) -> Column:
    return F.when(F.size(ring) >= 3, F.concat(ring, F.slice(ring, 1, 1))).otherwise(F.slice(ring, 1, 0))


def contains_point(x: Column, y: Column, polygons: Column) -> Column:
    """Whether a point is in some polygon's outer ring and in none of its holes."""
    within = lambda ring: inside_ring(x, y, _closed(ring))
    one = lambda p: within(F.get(p, F.lit(0))) & ~F.exists(F.slice(p, 2, F.size(p)), within)
    return F.coalesce(F.exists(polygons, lambda p: F.coalesce((F.size(p) > 0) & one(p), F.lit(False))), F.lit(False))


def _edges(polygons: Column) -> Column:
    rings = F.flatten(polygons)
    of = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), of))


def metres_to(x: Column, y: Column, polygons: Column) -> Column:
    """0 inside, else metres to the nearest boundary at 111320 a degree; null without a boundary."""

    def gap(e):
        p, q = e["p"], e["q"]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.coalesce(((x - p["x"]) * dx + (y - p["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)

    return F.when(contains_point(x, y, polygons), 0.0).otherwise(F.array_min(F.transform(_edges(polygons), gap)) * METRES_A_DEGREE)


def _turn(p, q, r):
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def segments_meet(a, b) -> Column:
    """Whether two segments (structs p, q) share a point."""
    on = lambda s, z: z["x"].between(F.least(s["p"]["x"], s["q"]["x"]), F.greatest(s["p"]["x"], s["q"]["x"])) & z["y"].between(F.least(s["p"]["y"], s["q"]["y"]), F.greatest(s["p"]["y"], s["q"]["y"]))
    o1, o2, o3, o4 = _turn(a["p"], a["q"], b["p"]), _turn(a["p"], a["q"], b["q"]), _turn(b["p"], b["q"], a["p"]), _turn(b["p"], b["q"], a["q"])
    cross = ((o1 > 0) != (o2 > 0)) & ((o3 > 0) != (o4 > 0))
    return cross | ((o1 == 0) & on(a, b["p"])) | ((o2 == 0) & on(a, b["q"])) | ((o3 == 0) & on(b, a["p"])) | ((o4 == 0) & on(b, a["q"]))


def geometries_meet(a: Column, b: Column) -> Column:
    """Whether two geometries share a point: a corner of one in the other, or edges that meet."""
    corners = lambda g: F.flatten(F.transform(F.filter(g, lambda p: F.size(p) > 0), lambda p: F.get(p, F.lit(0))))
    inside = lambda g, h: F.exists(corners(g), lambda p: contains_point(p["x"], p["y"], h))
    edges = F.exists(_edges(a), lambda s: F.exists(_edges(b), lambda t: segments_meet(s, t)))
    return F.coalesce(inside(a, b) | inside(b, a) | edges, F.lit(False))


def with_box(features: DataFrame, geometry: str) -> DataFrame:
    """Adds x0, y0, x1, y1, the bounding box; features without points are left out."""
    points = F.flatten(F.flatten(F.col(geometry)))
    of = lambda c, f: f(F.transform(points, lambda p: p[c]))
    return features.withColumns({"x0": of("x", F.array_min), "y0": of("y", F.array_min), "x1": of("x", F.array_max), "y1": of("y", F.array_max)}).filter("x0 IS NOT NULL")


def box_candidates(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Rows of left and right (both with x0, y0, x1, y1; right's are dropped) whose boxes meet.

    Boxes are laid into the cells that they touch, so the join is an equi-join on the cell; the pair counts in the first
    cell that both touch alone."""
    at = lambda c: F.floor(F.col(c) / cell)
    laid = lambda df, s: df.select("*", F.explode(F.sequence(at("x0"), at("x1"))).alias("cx")).select("*", F.explode(F.sequence(at("y0"), at("y1"))).alias("cy"))
    other = laid(right, "b").withColumnsRenamed({c: f"_{c}" for c in ("x0", "y0", "x1", "y1")})
    met = laid(left, "a").join(other, ["cx", "cy"]).filter("x0 <= _x1 AND _x0 <= x1 AND y0 <= _y1 AND _y0 <= y1")
    first = (F.col("cx") == F.greatest(at("x0"), at("_x0"))) & (F.col("cy") == F.greatest(at("y0"), at("_y0")))
    return met.filter(first).drop("cx", "cy", "_x0", "_y0", "_x1", "_y1")


def features_at(points: DataFrame, features: DataFrame, cell: float, where: Column | None = None) -> DataFrame:
    """point_id and feature_id of the features that hold each point. points: point_id, x, y; features: feature_id, geometry
    and whatever `where`, a condition on them, reads."""
    used = with_box(features if where is None else features.filter(where), "geometry").select("feature_id", "geometry", "x0", "y0", "x1", "y1")
    boxed = points.select("point_id", "x", "y", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")).filter("x IS NOT NULL AND y IS NOT NULL")
    return box_candidates(boxed, used, cell).filter(contains_point(F.col("x"), F.col("y"), F.col("geometry"))).select("point_id", "feature_id").distinct()


def features_meeting(queries: DataFrame, features: DataFrame, cell: float) -> DataFrame:
    """query_id and feature_id of the features that meet each query geometry. queries: query_id, shape."""
    used = with_box(features, "geometry").select("feature_id", "geometry", "x0", "y0", "x1", "y1")
    asked = with_box(queries, "shape").select("query_id", "shape", "x0", "y0", "x1", "y1")
    return box_candidates(asked, used, cell).filter(geometries_meet(F.col("shape"), F.col("geometry"))).select("query_id", "feature_id").distinct()


def nearest_sites(points: DataFrame, places: DataFrame, cell: float, distance: Column, group: list[str] = []) -> DataFrame:
    """points (point_id, x, y) with distance and place_id of the nearest place (place_id, px, py; ties by id) within `cell`, one for each
    group of places.

    Equal coordinates are looked up once. Grids go from fine to coarse, each cell twice as wide as before, from one with about eight
    sites in the fullest cell of a group: a site found within a cell's width is the nearest, and other points go on to the next grid,
    so a point doesn't meet all sites of a crowded neighbourhood."""
    steps = Rounds(points.sparkSession)
    sites = steps.written(places.filter("px IS NOT NULL AND py IS NOT NULL").groupBy(*group, "px", "py").agg(F.min("place_id").alias("place_id")), "sites")
    at = lambda c, wide: F.floor(F.col(c) / wide)
    around = lambda c, wide: F.explode(F.sequence(at(c, wide) - 1, at(c, wide) + 1))
    most = sites.groupBy(*group, at("px", cell).alias("cx"), at("py", cell).alias("cy")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    wanted = points.select("x", "y").distinct()
    if group:
        filled = sites.select(*group, at("px", cell).alias("cx"), at("py", cell).alias("cy")).distinct()
        filled = filled.select(*group, F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy").select(*group, "cx", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy")).distinct()
        wanted = wanted.withColumns({"cx": at("x", cell), "cy": at("y", cell)}).join(filled, ["cx", "cy"]).drop("cx", "cy")
    found = None
    for level in range(min(24, max(0, math.ceil(math.log(max(most, 1) / 8, 4)))), -1, -1):
        wide = cell / 2**level
        spread = sites.select("*", around("px", wide).alias("cx")).select("*", around("py", wide).alias("cy"))
        met = wanted.withColumns({"cx": at("x", wide), "cy": at("y", wide)}).join(spread, [*group, "cx", "cy"]).withColumn("distance", distance)
        # A little less than a finer cell's width, so that rounding of cells leaves no nearer site out.
        near = met.filter(F.col("distance") <= (wide * (1 - 1e-9) if level else cell)).groupBy("x", "y", *group).agg(F.min(F.struct("distance", "place_id")).alias("best"))
        if level:
            near = steps.written(near, f"near-{level}")
            wanted = steps.written(wanted.join(near, ["x", "y", *group], "left_anti"), "wanted")
        found = near if found is None else found.unionByName(near)
    return points.join(found, ["x", "y"]).select("point_id", *group, "best.distance", "best.place_id")


def nearest_by_level(points: DataFrame, places: DataFrame, cell: float) -> DataFrame:
    """The nearest place of each level within `cell` of each point (ties by id): point_id, level, place_id, distance.
    points: point_id, x, y; places: place_id, level, px, py. A null level is one of its own."""
    found = nearest_sites(points, places.withColumn("level", F.struct("level")), cell, F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), ["level"])
    return found.select("point_id", "level.level", "place_id", F.round("distance", 6).alias("distance"))


def rebuilt(parts: DataFrame, feature: str, order: str, polygon: str) -> DataFrame:
    """Geometries put together from their polygons in order."""
    return parts.groupBy(feature).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, polygon))), lambda p: p[polygon]).alias("geometry"))


def geojson_features(text: DataFrame, column: str = "value") -> DataFrame:
    """feature_id, properties and geometry of GeoJSON features, one a row (as JSON lines); a polygon is a geometry of one."""
    rows = text.select(F.from_json(column, "id string, properties map<string,string>, geometry struct<type:string,coordinates:string>").alias("f"))
    many = F.when(F.col("f.geometry.type") == "Polygon", F.concat(F.lit("["), "f.geometry.coordinates", F.lit("]"))).when(F.col("f.geometry.type") == "MultiPolygon", F.col("f.geometry.coordinates"))
    numbers = F.from_json(many, "array<array<array<array<double>>>>")
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    shape = F.transform(numbers, lambda poly: F.transform(poly, lambda ring: F.transform(ring, point)))
    return rows.select(F.col("f.id").alias("feature_id"), F.col("f.properties").alias("properties"), shape.alias("geometry"))


def boundary_geometry(text: Column) -> Column:
    """The geometry of a boundary text: polygons between semicolons, points between commas, x and y between spaces."""
    point = lambda t: F.struct(F.get(F.split(F.trim(t), " +"), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(F.trim(t), " +"), F.lit(1)).try_cast("double").alias("y"))
    ring = lambda t: F.transform(F.split(t, ","), lambda p: point(p))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda t: F.trim(t) != ""), lambda t: F.array(ring(t)))


def as_geojson(feature_id: Column, name: Column, geometry: Column) -> Column:
    """One GeoJSON feature as text."""
    numbers = F.transform(geometry, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), feature_id.cast("string").alias("id"), F.struct(name.alias("name")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), numbers.alias("coordinates")).alias("geometry")))


def first_levels(rows: DataFrame, first: str, second: str, k: int) -> DataFrame:
    """The first k values of the first level in order, each with its sorted second level, joined by commas."""
    levels = rows.groupBy(first).agg(F.array_join(F.array_sort(F.collect_set(second)), ",").alias("children"))
    return levels.orderBy(first).limit(k)


def pruned(df: DataFrame, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of the rows with a listed key, once for each row."""
    return df.join(keys.select(key).distinct(), key, "left_semi").select(*columns)


def sampled_then_fetched(df: DataFrame, key: str, columns: list[str], n: int) -> DataFrame:
    """n rows by a hash of the key: the sample is drawn from a scan of the key alone, then its rows are fetched."""
    chosen = df.select(key).orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
    return df.join(F.broadcast(chosen), key, "left_semi").select(key, *columns)


def numbered_pages(df: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    """One page with the total number of rows on each of its rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))
