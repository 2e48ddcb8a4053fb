"""Queries of the distances: nations as locations, line status as group, parts as items, return flags as values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import aggregation as agg
from lexigrid.operators import distances as ds
from lexigrid.operators import linkage as lk
from lexigrid.plans.queries import query
from lexigrid.sources.tables import table

_ROWS = "(SELECT l_linestatus AS grp, s_nationkey AS location, l_partkey AS item, l_returnflag AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
_FOUND = f"""WITH r AS (SELECT * FROM {_ROWS} WHERE value <> ''), t AS (SELECT grp, location, item, string_agg(DISTINCT value, '|' ORDER BY value) AS token FROM r GROUP BY ALL),
 al AS (SELECT p.grp, p.location AS a, q.location AS b, p.token AS x, q.token AS y, count(*) AS n FROM t p JOIN t q ON p.grp = q.grp AND p.item = q.item AND p.location < q.location GROUP BY ALL),
 cx AS (SELECT grp, a, b, x, sum(n) AS cx FROM al GROUP BY ALL), cy AS (SELECT grp, a, b, y, sum(n) AS cy FROM al GROUP BY ALL), tot AS (SELECT grp, a, b, sum(n) AS total, count(DISTINCT x) AS nx, count(DISTINCT y) AS ny FROM al GROUP BY ALL),
 sx AS (SELECT grp, a, b, sum(cx * (cx - 1) / 2) AS s FROM cx GROUP BY ALL), sy AS (SELECT grp, a, b, sum(cy * (cy - 1) / 2) AS s FROM cy GROUP BY ALL),
 ent AS (SELECT grp, a, b, sum(-(n / total) * (ln(n / cx) + ln(n / cy))) AS h, sum(n * (n - 1) / 2) AS s FROM al JOIN cx USING (grp, a, b, x) JOIN cy USING (grp, a, b, y) JOIN tot USING (grp, a, b) GROUP BY ALL),
 intra AS (SELECT grp, a, b, least(1, greatest(0, h / 2 / ln(greatest(nx, ny, 2)))) AS corr, coalesce(least(1, greatest(0, (sx.s + sy.s - 2 * ent.s) / nullif(total * (total - 1) / 2, 0))), 0) AS struct_
   FROM ent JOIN tot USING (grp, a, b) JOIN sx USING (grp, a, b) JOIN sy USING (grp, a, b)),
 ma AS (SELECT grp, a, b, x AS token, first(y ORDER BY n DESC, y) AS match, sum(n) AS n FROM al GROUP BY grp, a, b, x), mb AS (SELECT grp, a, b, y AS token, first(x ORDER BY n DESC, x) AS match, sum(n) AS n FROM al GROUP BY grp, a, b, y),
 mp AS (SELECT *, a AS here, b AS there FROM ma UNION ALL SELECT *, b, a FROM mb),
 val AS (SELECT grp, a, b, sum(mp.n / total * (1 - len(list_intersect(string_split(token, '|'), string_split(match, '|'))) / len(list_distinct(list_concat(string_split(token, '|'), string_split(match, '|')))))) / 2 AS value FROM mp JOIN tot USING (grp, a, b) GROUP BY ALL),
 pc AS (SELECT location, value, count(DISTINCT item) AS k FROM r GROUP BY ALL),
 pr AS (SELECT location, value, round(k / sum(k) OVER (PARTITION BY location), 6) AS share, round((row_number() OVER (PARTITION BY location ORDER BY k DESC, value) - 1) / greatest(count(*) OVER (PARTITION BY location) - 1, 1), 6) AS rank FROM pc),
 sg AS (SELECT u.location, token, avg(share) AS s, avg(rank) AS r FROM (SELECT DISTINCT location, token FROM t) u, unnest(string_split(token, '|')) v(v) JOIN pr ON pr.location = u.location AND pr.value = v.v GROUP BY ALL),
 anc AS (SELECT grp, a, b, sum(mp.n / total * least(1, sqrt((pow(g.s - h.s, 2) + pow(g.r - h.r, 2)) / 2))) / 2 AS anchor FROM mp JOIN tot USING (grp, a, b) JOIN sg g ON g.location = here AND g.token = mp.token JOIN sg h ON h.location = there AND h.token = match GROUP BY ALL),
 mod AS (SELECT a, b, x, y, sum(n) AS n FROM al GROUP BY ALL), mz AS (SELECT *, sum(n) OVER (PARTITION BY a, b, x) AS cx, sum(n) OVER (PARTITION BY a, b, y) AS cy FROM mod), mk AS (SELECT a, b, greatest(count(DISTINCT x), count(DISTINCT y), 2) AS k FROM mod GROUP BY ALL),
 sh AS (SELECT grp, a, b, least(1, greatest(0, sum(-al.n * (ln(mz.n / mz.cx + 1e-12) + ln(mz.n / mz.cy + 1e-12))) / sum(al.n) / 2 / ln(any_value(k)))) AS shared FROM al JOIN mz USING (a, b, x, y) JOIN mk USING (a, b) GROUP BY ALL) """
_WEIGHT = "CASE grp WHEN 'F' THEN 2.0 ELSE 1.0 END"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey")).select("l_linestatus", "s_nationkey", "l_partkey", "l_returnflag")


def _found(spark: SparkSession, d: str) -> DataFrame:
    return ds.tokens(_rows(spark, d), "l_linestatus", "s_nationkey", "l_partkey", "l_returnflag")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    rows = agg.inventory(_rows(spark, d), "s_nationkey", "l_returnflag", "l_partkey")
    return rows.select(F.col("s_nationkey").alias("location"), F.col("l_returnflag").alias("value"), "share", "rank_percent")


def _weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("F", 2.0), ("O", 1.0)], "group string, weight double")


@query(_FOUND + "SELECT token, row_number() OVER (ORDER BY token) - 1 AS id, len(string_split(token, '|')) AS n_values FROM (SELECT DISTINCT token FROM t)")
def adv22_catalogue(spark, d):
    return ds.catalogue(_found(spark, d))


@query(_FOUND + """SELECT grp AS "group", location, count(*) AS n_items, round(count(*) / any_value(n_all), 6) AS coverage FROM t JOIN (SELECT grp, count(DISTINCT item) AS n_all FROM r GROUP BY grp) USING (grp) GROUP BY grp, location""")
def adv23_coverage(spark, d):
    items = _rows(spark, d).select(F.col("l_linestatus").alias("group"), F.col("l_partkey").alias("item"))
    return ds.coverage(_found(spark, d), items)


@query(_FOUND + """SELECT grp AS "group", a, b, x, y, n FROM al""")
def join20_location_pairs(spark, d):
    return ds.aligned(_found(spark, d), ["group"])


@query(_FOUND + """SELECT grp AS "group", a, b, round(corr, 6) AS corr, round(struct_, 6) AS struct FROM intra""")
def adv26_structure(spark, d):
    return ds.intra(ds.aligned(_found(spark, d), ["group"]), ["group"]).select("group", "a", "b", F.round("corr", 6).alias("corr"), F.round("struct", 6).alias("struct"))


@query(_FOUND + """SELECT grp AS "group", a, b, round(shared, 6) AS shared FROM sh""")
def adv27_shared(spark, d):
    found = _found(spark, d)
    return ds.shared(ds.aligned(found, ["group"]), ["group"], ds.aligned(found, [])).withColumn("shared", F.round("shared", 6))


@query(_FOUND + """SELECT grp AS "group", a, b, round(anchor, 6) AS anchor FROM anc""")
def adv28_anchors(spark, d):
    return ds.anchors(ds.aligned(_found(spark, d), ["group"]), ["group"], _profile(spark, d)).withColumn("anchor", F.round("anchor", 6))


@query(_FOUND + """SELECT grp AS "group", a, b, round(value, 6) AS value FROM val""")
def adv29_values(spark, d):
    return ds.values(ds.aligned(_found(spark, d), ["group"]), ["group"]).withColumn("value", F.round("value", 6))


_PAIRS = " , loc AS (SELECT DISTINCT location FROM t), pre AS (SELECT DISTINCT grp, location FROM t), pp AS (SELECT p.location AS a, q.location AS b, grp, " + _WEIGHT + " AS w FROM loc p JOIN loc q ON p.location < q.location, (SELECT unnest(['F', 'O']) AS grp)) "


def _total(extra: str, weight: float, value: float) -> str:
    phoneme = f"({1 - weight} * coalesce(0.85 * corr + 0.15 * struct_, 0.85) + {weight} * coalesce({extra}, 1))"
    mixed = f"({1 - value} * {phoneme} + {value} * coalesce(val.value, 1))"
    return f"""SELECT pp.a, pp.b, round(coalesce(sum(w * CASE WHEN x.grp IS NULL OR y.grp IS NULL THEN 1 ELSE {mixed} END) FILTER (x.grp IS NOT NULL OR y.grp IS NOT NULL) / sum(w) FILTER (x.grp IS NOT NULL OR y.grp IS NOT NULL), 1), 6) AS distance
FROM pp LEFT JOIN pre x ON x.grp = pp.grp AND x.location = pp.a LEFT JOIN pre y ON y.grp = pp.grp AND y.location = pp.b LEFT JOIN intra ON intra.grp = pp.grp AND intra.a = pp.a AND intra.b = pp.b
LEFT JOIN val ON val.grp = pp.grp AND val.a = pp.a AND val.b = pp.b LEFT JOIN anc ON anc.grp = pp.grp AND anc.a = pp.a AND anc.b = pp.b LEFT JOIN sh ON sh.grp = pp.grp AND sh.a = pp.a AND sh.b = pp.b GROUP BY pp.a, pp.b"""


@query(_FOUND + _PAIRS + _total("0", 0.0, 0.0))
def adv30_intra(spark, d):
    return ds.distance_matrix(_found(spark, d), _weights(spark))


@query(_FOUND + _PAIRS + _total("anchor", 0.15, 0.3))
def adv30_anchored(spark, d):
    return ds.distance_matrix(_found(spark, d), _weights(spark), "anchored", _profile(spark, d), 0.3)


@query(_FOUND + _PAIRS + _total("shared", 0.2, 0.0))
def adv30_shared(spark, d):
    return ds.distance_matrix(_found(spark, d), _weights(spark), "shared")


@query(_FOUND + """SELECT grp AS "group", count(DISTINCT location) AS n_locations, round(count(DISTINCT location) / (SELECT count(DISTINCT s_nationkey) FROM supplier), 6) AS share, round(count(*) / count(DISTINCT location), 6) AS mean_items,
  count(DISTINCT token) AS n_tokens, CASE WHEN count(DISTINCT item) < 2 THEN 'fewer than two items' WHEN count(DISTINCT location) < (SELECT count(DISTINCT s_nationkey) FROM supplier) THEN 'not at all locations' ELSE '' END AS warning FROM t GROUP BY grp""")
def adv35_group_diagnostics(spark, d):
    return ds.group_diagnostics(_found(spark, d), table(spark, d, "supplier").select(F.col("s_nationkey").alias("location")))


@query()
def adv33_average(spark, d):
    """The dendrogram of the locations by average linkage of their blended distances."""
    return lk.merges(ds.distance_matrix(_found(spark, d), _weights(spark)), "average").select("height", "round", "left", "right", "n")


@query()
def adv33_complete_labels(spark, d):
    matrix = ds.distance_matrix(_found(spark, d), _weights(spark))
    places = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("node"))
    return lk.labels(places, lk.merges(matrix, "complete"), 5)


@query()
def adv33_single(spark, d):
    """The lightest spanning tree of the locations: single linkage."""
    return lk.spanning_tree(ds.distance_matrix(_found(spark, d), _weights(spark)))


@query()
def adv32_scaled(spark, d):
    return lk.scaled(ds.distance_matrix(_found(spark, d), _weights(spark)), 3)
