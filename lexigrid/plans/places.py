"""Queries on locations and geometry: customers under nations and regions, vectors' first two dimensions as points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import places as pl
from lexigrid.operators import structures as st
from lexigrid.plans.queries import query
from lexigrid.sources.tables import table

_LOCATIONS = "(SELECT c_custkey, c_name AS location, r_name || '-' || n_name || '-' || c_mktsegment AS path, c_mktsegment AS segment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _locations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    return rows.select("c_custkey", F.col("c_name").alias("location"), F.concat_ws("-", "r_name", "n_name", "c_mktsegment").alias("path"), F.col("c_mktsegment").alias("segment"), "c_acctbal", "n_name", "r_name")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' AND nullif(c_mktsegment, 'BUILDING') IS NULL")
def flt18_directly_administered(spark, d):
    rows = _locations(spark, d).withColumn("county", F.when(F.col("segment") == "BUILDING", None).otherwise(F.col("segment")))
    return rows.filter(pl.directly_administered("n_name", "county", "NATION_3", None)).select("c_custkey")


@query(f"SELECT location, path, segment, c_acctbal FROM {_LOCATIONS} WHERE location = 'Customer#000000007'")
def flt19_location_detail(spark, d):
    return _locations(spark, d).filter(F.col("location") == "Customer#000000007").select("location", "path", "segment", "c_acctbal")


@query(f"SELECT location, split_part(path, '-', 1) AS first, split_part(path, '-', 2) AS second FROM {_LOCATIONS}")
def flt20_location_partitions(spark, d):
    parts = F.split("path", "-")
    return _locations(spark, d).select("location", F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second"))


@query(f"SELECT w.location, path FROM (SELECT DISTINCT c_name AS location FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' UNION SELECT 'nowhere') w LEFT JOIN {_LOCATIONS} l ON w.location = l.location")
def flt21_regions_of(spark, d):
    wanted = table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.expr("o_custkey = c_custkey")).select(F.col("c_name").alias("location")).unionByName(spark.sql("SELECT 'nowhere' AS location"))
    return pl.regions_of(_locations(spark, d), wanted)


def _resolved(rows: str) -> str:
    return f"""WITH w AS (SELECT path AS region FROM {_LOCATIONS} WHERE c_custkey = 5 UNION SELECT 'NATION_7' UNION SELECT 'MACHINERY' UNION SELECT 'none'), u AS (SELECT * FROM {rows}),
 e AS (SELECT location, region FROM u JOIN w ON path = region), m AS (SELECT region FROM w WHERE region NOT IN (SELECT region FROM e)),
 t AS (SELECT location, 1 AS tier FROM e UNION ALL SELECT location, 2 FROM u, m WHERE list_contains(string_split(path, '-'), region) UNION ALL SELECT unnest(['Customer#00000001', 'elsewhere']), 3)
SELECT location, min(tier) AS tier FROM t GROUP BY location"""


def _wanted(spark, d):
    own = _locations(spark, d).filter("c_custkey = 5").select(F.col("path").alias("region"))
    return own.unionByName(spark.sql("SELECT explode(array('NATION_7', ' MACHINERY', 'none')) AS region")), spark.sql("SELECT explode(array('Customer#00000001', ' elsewhere ')) AS location")


@query(_resolved(f"{_LOCATIONS} WHERE c_acctbal > 0"))
def flt22_resolved_locations(spark, d):
    regions, literal = _wanted(spark, d)
    return pl.resolved_locations(_locations(spark, d), regions, literal, F.col("c_acctbal") > 0)


@query(_resolved(f"(SELECT 'o' || o_orderkey AS location, path FROM orders JOIN {_LOCATIONS} ON o_custkey = c_custkey)"))
def flt23_resolved_submissions(spark, d):
    """Submitted rows (orders) under their customers' paths."""
    regions, literal = _wanted(spark, d)
    rows = table(spark, d, "orders").join(_locations(spark, d), F.expr("o_custkey = c_custkey")).select(F.concat(F.lit("o"), "o_orderkey").alias("location"), "path")
    return pl.resolved_locations(rows, regions, literal)


@query("""WITH k AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN '19' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || 'x' ELSE 'o' || o_orderkey END AS location, o_orderpriority = '1-URGENT' AS special FROM orders)
SELECT CASE WHEN regexp_matches(location, '^(18|19|20)[0-9]{2}') THEN 'year' WHEN special THEN 'special' ELSE 'kept' END AS kind, count(*) AS n FROM k GROUP BY kind""")
def flt24_without_special(spark, d):
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("19"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("x"))).otherwise(F.concat(F.lit("o"), "o_orderkey"))
    rows = table(spark, d, "orders").select(name.alias("location"), "o_orderpriority")
    return pl.without_special(rows, F.col("o_orderpriority") == "1-URGENT").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT string_split(path, '-') AS p FROM {_LOCATIONS}), l AS (SELECT DISTINCT 1 AS level, p[1] AS name, NULL AS parent, p[2] AS child FROM s UNION SELECT 2, p[2], p[1], p[3] FROM s UNION SELECT 3, p[3], p[2], NULL FROM s)
SELECT level, name, parent, coalesce(string_agg(child, ',' ORDER BY child), '') AS children FROM l GROUP BY level, name, parent""")
def adv4_partition_levels(spark, d):
    return pl.partition_levels(_locations(spark, d), "path")


@query("""WITH t AS (SELECT unnest(['Customer#00000001', 'Customer#00000001', 'er#000000015', 'zzz']) AS term, unnest(['Customer#00000001', 'Customer#00000002', 'er#000000015', 'zzz']) AS variant)
SELECT term, c_name AS name, min(CASE WHEN c_name = variant THEN 1 WHEN starts_with(c_name, variant) THEN 2 ELSE 3 END) AS tier FROM customer JOIN t ON contains(c_name, variant) GROUP BY term, c_name""")
def adv39_matched_names(spark, d):
    terms = spark.createDataFrame([("Customer#00000001", "Customer#00000001"), ("Customer#00000001", "Customer#00000002"), ("er#000000015", "er#000000015"), ("zzz", "zzz")], "term string, variant string")
    return pl.matched_names(table(spark, d, "customer").select(F.col("c_name").alias("name")), terms)


@query("""SELECT DISTINCT c_name, abs(length(c_name) - 18) AS gap FROM customer WHERE abs(length(c_name) - 18) <= 3 OR starts_with(c_name, 'C') ORDER BY gap, c_name LIMIT 100""")
def ord10_near_lengths(spark, d):
    return pl.near_lengths(table(spark, d, "customer"), "c_name", "Customer#000000020", 100).withColumn("gap", F.abs(F.length("c_name") - 18).cast("long"))


_POINTS = "(SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@query(f"""SELECT label, min(x) AS x_least, max(x) AS x_most, min(y) AS y_least, max(y) AS y_most, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean,
  round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) * 111, 6) AS extent_km, count(*) AS n FROM {_POINTS} GROUP BY label""")
def fn24_spans(spark, d):
    return pl.spans(_points(spark, d), ["label"], "x", "y")


@query(f"SELECT label, greatest(0, least(18, floor(log2(360.0::DOUBLE / (max(x) - min(x))))))::INT AS zoom FROM {_POINTS} GROUP BY label")
def fn23_zoom(spark, d):
    return _points(spark, d).groupBy("label").agg((F.max("x") - F.min("x")).alias("s")).select("label", pl.zoom(F.col("s")).alias("zoom"))


def _features(spark: SparkSession) -> DataFrame:
    """25 squares on a grid, each with a square hole; the odd ones have a second, smaller part to their right."""
    square = lambda x, y, r: F.array(*(F.struct((x + dx * r).alias("x"), (y + dy * r).alias("y")) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    rows = spark.range(25).select(F.col("id").cast("int").alias("feature_id"), (((F.col("id") % 5) - 2) / 10).alias("cx"), ((F.floor(F.col("id") / 5) - 2) / 10).alias("cy"))
    first = F.array(square(F.col("cx"), F.col("cy"), 0.03), square(F.col("cx"), F.col("cy"), 0.01))
    second = F.array(square(F.col("cx") + 0.045, F.col("cy"), 0.005))
    return rows.withColumn("geometry", F.when(F.col("feature_id") % 2 == 1, F.array(first, second)).otherwise(F.array(first)))


_SQUARES = "(SELECT id::INT AS feature_id, (id % 5 - 2) / 10 AS cx, (id // 5 - 2) / 10 AS cy FROM range(25) t(id))"
_INSIDE = "((abs(x - cx) < 0.03 AND abs(y - cy) < 0.03 AND NOT (abs(x - cx) < 0.01 AND abs(y - cy) < 0.01)) OR (feature_id % 2 = 1 AND abs(x - cx - 0.045) < 0.005 AND abs(y - cy) < 0.005))"


@query(f"SELECT vec_id AS point_id, feature_id FROM {_POINTS}, {_SQUARES} WHERE {_INSIDE}")
def fn25_features_at(spark, d):
    return pl.features_at(_points(spark, d), _features(spark), 0.05)


@query(f"SELECT vec_id AS point_id, feature_id FROM {_POINTS}, {_SQUARES} WHERE feature_id > 9 AND {_INSIDE}")
def udf1_features_where(spark, d):
    return pl.features_at(_points(spark, d), _features(spark), 0.05, F.col("feature_id") > 9)


@query(f"""SELECT vec_id AS point_id, round(111320 * CASE WHEN abs(x - cx) < 0.03 AND abs(y - cy) < 0.03 THEN CASE WHEN abs(x - cx) < 0.01 AND abs(y - cy) < 0.01 THEN 0.01 - greatest(abs(x - cx), abs(y - cy)) ELSE 0 END
  ELSE sqrt(pow(greatest(abs(x - cx) - 0.03, 0), 2) + pow(greatest(abs(y - cy) - 0.03, 0), 2)) END, 3) AS metres FROM {_POINTS}, {_SQUARES} WHERE feature_id = 12""")
def fn26_metres_to(spark, d):
    one = _features(spark).filter("feature_id = 12").select("geometry")
    return _points(spark, d).crossJoin(F.broadcast(one)).select("point_id", F.round(pl.metres_to(F.col("x"), F.col("y"), F.col("geometry")), 3).alias("metres"))


_MEETS = "((abs(x - cx) < 0.032 AND abs(y - cy) < 0.032 AND NOT (abs(x - cx) < 0.008 AND abs(y - cy) < 0.008)) OR (feature_id % 2 = 1 AND abs(x - cx - 0.045) < 0.007 AND abs(y - cy) < 0.007))"


@query(f"SELECT vec_id AS query_id, feature_id FROM {_POINTS}, {_SQUARES} WHERE {_MEETS}")
def adv37_features_meeting(spark, d):
    corners = F.array(*(F.struct((F.col("x") + dx * 0.002).alias("x"), (F.col("y") + dy * 0.002).alias("y")) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    return pl.features_meeting(_points(spark, d).select(F.col("point_id").alias("query_id"), F.array(F.array(corners)).alias("shape")), _features(spark), 0.05)


@query("""SELECT 'meet' AS name, true AS hit UNION ALL SELECT 'touch', true UNION ALL SELECT 'apart', false UNION ALL SELECT 'in line', false""")
def fn27_segments_meet(spark, d):
    rows = [("meet", (0, 0, 2, 2), (0, 2, 2, 0)), ("touch", (0, 0, 2, 0), (1, 0, 1, 3)), ("apart", (0, 0, 1, 1), (2, 0, 3, 1)), ("in line", (0, 0, 1, 0), (2, 0, 3, 0))]
    segment = "struct<p:struct<x:double,y:double>,q:struct<x:double,y:double>>"
    made = spark.createDataFrame([(n, *(((float(s[0]), float(s[1])), (float(s[2]), float(s[3]))) for s in (a, b))) for n, a, b in rows], f"name string, a {segment}, b {segment}")
    return made.select("name", pl.segments_meet(F.col("a"), F.col("b")).alias("hit"))


@query(f"""WITH p AS (SELECT * FROM {_POINTS}) SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id < b.vec_id AND abs(a.x - b.x) <= 0.002 AND abs(a.y - b.y) <= 0.002""")
def join17_box_join(spark, d):
    near = _points(spark, d)
    box = lambda name: near.select(F.col("point_id").alias(name), (F.col("x") - 0.001).alias("x0"), (F.col("y") - 0.001).alias("y0"), (F.col("x") + 0.001).alias("x1"), (F.col("y") + 0.001).alias("y1"))
    return pl.box_candidates(box("a"), box("b"), 0.01).filter("a < b").select("a", "b")


@query(f"""WITH v AS (SELECT * FROM {_POINTS}), m AS (SELECT p.vec_id AS point_id, q.label AS level, q.vec_id AS place_id, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS distance FROM v p JOIN v q ON p.vec_id % 2 = 0 AND q.vec_id % 2 = 1)
SELECT point_id, level, place_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id, level ORDER BY distance, place_id) AS k FROM m WHERE distance <= 0.1) WHERE k = 1""")
def adv36_nearest_by_level(spark, d):
    v = _points(spark, d)
    return pl.nearest_by_level(v.filter("point_id % 2 = 0").drop("label"), v.filter("point_id % 2 = 1").select(F.col("point_id").alias("place_id"), F.col("label").alias("level"), F.col("x").alias("px"), F.col("y").alias("py")), 0.1)


@query(f"SELECT feature_id, CASE WHEN feature_id % 2 = 1 THEN 2 ELSE 1 END AS n_parts, CASE WHEN feature_id % 2 = 1 THEN 3 ELSE 2 END AS n_rings FROM {_SQUARES}")
def adv38_rebuilt(spark, d):
    parts = _features(spark).select("feature_id", F.posexplode("geometry").alias("part", "polygon"))
    return pl.rebuilt(parts, "feature_id", "part", "polygon").select("feature_id", F.size("geometry").alias("n_parts"), F.size(F.flatten("geometry")).alias("n_rings"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name ILIKE '%tion_1%' ORDER BY n_name")
def adv38_search(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).filter(F.col("n_name").ilike("%tion_1%")).select("n_name", "r_name").orderBy("n_name")


@query(f"SELECT feature_id::VARCHAR AS feature_id, 'f' || feature_id AS name, CASE WHEN feature_id % 2 = 1 THEN 15 ELSE 10 END AS n_points FROM {_SQUARES}")
def src20_geojson_features(spark, d):
    text = _features(spark).select(pl.as_geojson(F.col("feature_id"), F.concat(F.lit("f"), "feature_id"), F.col("geometry")).alias("value"))
    return pl.geojson_features(text).select("feature_id", F.col("properties")["name"].alias("name"), F.size(F.flatten(F.flatten("geometry"))).alias("n_points"))


@query("SELECT n_nationkey, 2 AS n_parts, n_nationkey + 0.5::DOUBLE AS x_least, n_nationkey + 6.0::DOUBLE AS x_most FROM nation")
def src22_boundaries(spark, d):
    k = lambda v: (F.col("n_nationkey") + v).cast("string")
    text = F.concat(k(0.5), F.lit(" 1.0,"), k(1), F.lit(" 1,"), k(1), F.lit(" 2;"), k(5), F.lit(" 1, "), k(6), F.lit(" 1,"), k(6), F.lit(" 2;"))
    made = table(spark, d, "nation").select("n_nationkey", pl.as_geojson(F.col("n_nationkey"), F.col("n_name"), pl.boundary_geometry(text)).alias("value"))
    back = pl.with_box(made.select("n_nationkey", F.from_json("value", "geometry struct<coordinates:array<array<array<array<double>>>>>")["geometry"]["coordinates"].alias("c")).select("n_nationkey", F.transform("c", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y"))))).alias("g")), "g")
    return back.select("n_nationkey", F.size("g").alias("n_parts"), F.col("x0").alias("x_least"), F.col("x1").alias("x_most"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS children FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY r_name LIMIT 3")
def adv3_first_levels(spark, d):
    return pl.first_levels(table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")), "r_name", "n_name", 3)


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def src6_two_lists(spark, d):
    parts = table(spark, d, "part").filter("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("l_partkey"))
    suppliers = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return pl.pruned(pl.pruned(table(spark, d, "lineitem"), parts, "l_partkey", ["l_orderkey", "l_partkey", "l_suppkey"]), suppliers, "l_suppkey", ["l_orderkey", "l_partkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 300)")
def src8_sampled_then_fetched(spark, d):
    return pl.sampled_then_fetched(table(spark, d, "orders"), "o_orderkey", ["o_totalprice"], 300)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 77, 1000, 99999999)")
def src7_rows_by_id(spark, d):
    ids = spark.createDataFrame([(x,) for x in (1, 5, 77, 1000, 99999999, 5)], "o_orderkey bigint")
    return pl.pruned(table(spark, d, "orders"), ids, "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def flt13_by_id_list(spark, d):
    ids = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return pl.pruned(table(spark, d, "orders"), ids, "o_custkey", ["o_orderkey", "o_orderdate"])


@query(f"SELECT segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN {_LOCATIONS} ON o_custkey = c_custkey GROUP BY segment")
def src9_dimension_load(spark, d):
    """The dimension is small beside the facts; Spark broadcasts it below its own size limit."""
    return table(spark, d, "orders").join(_locations(spark, d), F.expr("o_custkey = c_custkey")).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT path, count(DISTINCT c_custkey) AS n FROM {_LOCATIONS} GROUP BY path")
def fn32_paths(spark, d):
    rows = st.tree_paths(_locations(spark, d).select("path", F.col("c_custkey").cast("string").alias("c")), ["path", "c"])
    return rows.select("path", F.size(F.split("leaves", ",")).cast("long").alias("n"))
