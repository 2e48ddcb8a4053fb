"""Queries of the further parts of operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as fn
from lexigrid.operators import aggregation as agg
from lexigrid.operators import completions as cp
from lexigrid.operators import places as pl
from lexigrid.operators import usage
from lexigrid.plans.queries import _ALIGNED, _aligned, _READINGS, _readings, agg42_trend, query
from lexigrid.sources.tables import table


@query(f"""WITH i AS (SELECT user_id, event_type, k, bool_or(event_id % 4 = 1) AS m1, bool_or(event_id % 4 = 2) AS m2, bool_or(event_id % 4 = 3) AS m3 FROM {_READINGS} GROUP BY ALL),
 c AS (SELECT *, CASE WHEN m2 AND m3 THEN '文白讀' WHEN m2 THEN '文讀' WHEN m3 THEN '白讀' WHEN m1 THEN '多音字' END AS class FROM i) SELECT user_id, event_type, class, string_agg(k, ',' ORDER BY k) AS items FROM c WHERE class IS NOT NULL GROUP BY user_id, event_type, class""")
def agg10_mark_classes(spark, d):
    return cp.mark_classes(_readings(spark, d).withColumn("mark", F.col("event_id") % 4), ["user_id", "event_type"], "k", "mark")


@query("""WITH e AS (SELECT DISTINCT l_returnflag, p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey), o AS (SELECT l_returnflag, l_suppkey, string_agg(p_brand, '|' ORDER BY p_brand) AS a, count(*) AS n FROM e GROUP BY ALL),
 t AS (SELECT l_returnflag, count(*) AS n_all FROM o GROUP BY l_returnflag)
SELECT l_returnflag, p_brand || CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN '組' ELSE '' END AS label, count(*) AS n_items, round(count(*) / any_value(n_all), 4) AS share, coalesce(string_agg(CASE WHEN n > 1 THEN l_suppkey || ':' || a END, ';' ORDER BY l_suppkey || ':' || a), '') AS detail
FROM e JOIN o USING (l_returnflag, l_suppkey) JOIN t USING (l_returnflag) GROUP BY l_returnflag, p_brand""")
def agg13_class_details(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return cp.class_details(rows, "l_returnflag", "p_brand", "l_suppkey", ["Brand#1", "Brand#2"], "組")


_NOTED = lambda k: f"(SELECT c_nationkey, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN any_value(c_mktsegment) ELSE string_agg(c_mktsegment, ';' ORDER BY c_mktsegment, c_name) END AS value_{k + 1}, CASE WHEN count(*) > 1 THEN string_agg(c_name, ';' ORDER BY c_mktsegment, c_name) END AS note_{k + 1} FROM customer WHERE c_custkey % 2 = {k} GROUP BY c_nationkey)"


@query(f"SELECT n_nationkey AS c_nationkey, value_1, note_1, value_2, note_2 FROM nation LEFT JOIN {_NOTED(0)} x ON x.c_nationkey = n_nationkey LEFT JOIN {_NOTED(1)} y ON y.c_nationkey = n_nationkey")
def join21_merged_with_notes(spark, d):
    lists = [table(spark, d, "customer").filter(f"c_custkey % 2 = {k}") for k in (0, 1)]
    return cp.merged_with_notes(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")), lists, "c_nationkey", "c_mktsegment", "c_name")


@query("SELECT p_partkey FROM part WHERE ((p_brand = 'Brand#1' AND p_type = 'SMALL') OR (p_size = 7)) AND p_size BETWEEN 1 AND 30 AND p_retailprice BETWEEN 900 AND 1000")
def flt14_structures_in_box(spark, d):
    test = cp.any_structure([{"p_brand": "Brand#1", "p_type": "SMALL"}, {"p_size": 7}])
    return table(spark, d, "part").filter(test & cp.in_box("p_size", "p_retailprice", 1, 900.0, 30, 1000.0)).select("p_partkey")


@query("SELECT p_partkey, p_type = 'SMALL' AS plain, regexp_matches(p_type, '小|SMALL') AS pattern FROM part")
def flt25_value_test(spark, d):
    return table(spark, d, "part").select("p_partkey", cp.value_test("p_type", "SMALL").alias("plain"), cp.value_test("p_type", "小|SMALL").alias("pattern"))


@query("""WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS calls FROM events GROUP BY bucket) SELECT bucket, calls, calls = (SELECT max(calls) FROM h) AS peak FROM h""")
def agg42_peak(spark, d):
    return cp.trend_with_peak(agg42_trend(spark, d).select("bucket", "calls"), "calls")


@query("""WITH e AS (SELECT user_id, event_type AS path, CASE WHEN contains(event_type, 'click') OR contains(event_type, 'view') THEN 'look' WHEN contains(event_type, 'purchase') THEN 'buy' ELSE 'other' END AS kind, value AS up, value * 3 + 1 AS down FROM events),
 t AS (SELECT user_id, count(*) AS calls, sum(up) AS u, sum(down) AS d FROM e GROUP BY user_id), n AS (SELECT user_id, path, kind, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, path) AS place FROM n)
SELECT user_id, place, path, kind, n, round(u / calls, 4) AS up_a_call, round(d / calls, 4) AS down_a_call, round(u / d, 4) AS up_over_down FROM k JOIN t USING (user_id) WHERE place <= 5""")
def agg43_top_preferences(spark, d):
    rows = table(spark, d, "events").withColumn("down", F.col("value") * 3 + 1)
    return cp.preferences(rows, "user_id", fn.category(F.col("event_type"), [("look", ["click", "view"], []), ("buy", ["purchase"], [])], "other"), "event_type", "value", "down", 5)


@query("""SELECT * FROM (SELECT 'path' AS metric, event_type AS name, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, name LIMIT 10) UNION ALL
SELECT 'segment', CASE WHEN c >= 70 THEN 'often' WHEN c >= 60 THEN 'some' ELSE 'rare' END, count(*) FROM (SELECT user_id, count(*) AS c FROM events GROUP BY user_id) GROUP BY 2 UNION ALL
SELECT 'growth', strftime(date_trunc('month', f), '%Y-%m'), count(*) FROM (SELECT user_id, min(ts) AS f FROM events GROUP BY user_id) GROUP BY 2""")
def agg45_dashboard_parts(spark, d):
    events = table(spark, d, "events")
    paths = usage.top_values(events, "event_type", 10).select(F.lit("path").alias("metric"), F.col("event_type").alias("name"), "n")
    segments = usage.segments(events, "user_id", "ts", [("often", 70, 10**6), ("some", 60, 10**6)], "rare").groupBy("segment").agg(F.count("*").alias("n")).select(F.lit("segment").alias("metric"), F.col("segment").alias("name"), "n")
    growth = agg.growth(events, "ts", "user_id").select(F.lit("growth").alias("metric"), F.date_format("month", "yyyy-MM").alias("name"), F.col("n_new").alias("n"))
    return paths.unionByName(segments).unionByName(growth)


@query("""SELECT r_name AS region, NULL AS nation, count(*) AS n, count(DISTINCT o_custkey) AS users FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL
SELECT r_name, n_name, count(*), count(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def agg48_calls_by_place(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    calls = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(places, F.expr("c_nationkey = n_nationkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "o_custkey")
    return calls.rollup("region", "nation").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("users")).filter("region IS NOT NULL")


@query("""SELECT 'all' AS level, NULL AS name, count(*) AS n, count(DISTINCT user_id) AS n_user_id, count(DISTINCT props) AS n_props FROM events UNION ALL SELECT 'event_type', event_type, count(*), count(DISTINCT user_id), count(DISTINCT props) FROM events GROUP BY event_type
UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*), count(DISTINCT user_id), count(DISTINCT props) FROM events GROUP BY user_id""")
def agg49_grouped_distincts(spark, d):
    return cp.grouped_distincts(table(spark, d, "events"), ["event_type", "user_id"], ["user_id", "props"])


@query("SELECT h.hour::INT AS hour, coalesce(n, 0) AS n FROM range(24) h(hour) LEFT JOIN (SELECT hour(ts + INTERVAL 8 HOUR) AS hour, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) e ON e.hour = h.hour")
def agg60_hours(spark, d):
    return cp.session_hours(table(spark, d, "events").filter("event_type = 'click'"), "ts", "Asia/Shanghai")


@query("""WITH c AS (SELECT user_id, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events) SELECT user_id, count(*) FILTER (c) AS n_changes FROM c GROUP BY user_id ORDER BY n_changes DESC, user_id LIMIT 10""")
def agg60_top_changers(spark, d):
    return cp.top_changers(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 10)


@query("SELECT CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY bucket")
def agg62_durations(spark, d):
    return cp.duration_buckets(table(spark, d, "events"), "value", [10, 50, 100])


@query("""WITH r AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM r WHERE b IS NULL OR b <> event_type)
SELECT user_id, count(*) - 1 AS n_changes, string_agg(event_type, ',' ORDER BY k DESC) FILTER (k <= 10) AS history FROM x GROUP BY user_id""")
def str14_history(spark, d):
    return cp.change_history(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 10)


@query("""WITH p AS (SELECT DISTINCT r_name, n_name, c_mktsegment, min(c_custkey) OVER (PARTITION BY r_name, n_name, c_mktsegment) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 a AS (SELECT r_name, n_name, '{"leaves":[' || string_agg('"' || c_mktsegment || '"', ',' ORDER BY c_mktsegment) || '],"c":[' || string_agg(c, ',' ORDER BY c_mktsegment) || ']}' AS t FROM p GROUP BY ALL)
SELECT r_name, '{' || string_agg('"' || n_name || '":' || t, ',' ORDER BY n_name) || '}' AS tree FROM a GROUP BY r_name""")
def adv1_nested_tree(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    return cp.nested_tree(rows.groupBy("r_name", "n_name", "c_mktsegment").agg(F.min("c_custkey").alias("c")), ["r_name", "n_name", "c_mktsegment"], ["c"])


_CELLS = "(SELECT s_nationkey AS region, l_partkey AS token, count(*)::DOUBLE AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def _similar(other: str, test: str) -> str:
    return f"""WITH c AS {_CELLS}, o AS ({other}), q AS (SELECT * FROM c WHERE region IN (1, 2, 3)), m AS (SELECT q.region AS wanted, o.region AS region, sum(q.w * o.w) AS dot, count(*) AS shared FROM q JOIN o ON q.token = o.token {test} GROUP BY ALL),
 n AS (SELECT region, sqrt(sum(w * w)) AS norm, count(*) AS size FROM c GROUP BY region), k AS (SELECT region, sqrt(sum(w * w)) AS norm, count(*) AS size FROM o GROUP BY region),
 s AS (SELECT wanted, m.region AS region, round(dot / (x.norm * y.norm), 6) AS cosine, round(shared / (x.size + y.size - shared), 6) AS jaccard, shared FROM m JOIN n x ON x.region = wanted JOIN k y ON y.region = m.region)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY cosine DESC, region) AS rank FROM s) WHERE rank <= 5"""


def _cells(spark, d, region):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey")).join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    return rows.groupBy(F.col(region).alias("region"), F.col("l_partkey").alias("token")).agg(F.count("*").cast("double").alias("w"))


@query(_similar("SELECT * FROM c", "WHERE q.region <> o.region"))
def adv14_similar_regions(spark, d):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "region int")
    return cp.similar_regions(_cells(spark, d, "s_nationkey"), "region", "token", "w", wanted, 5)


@query(_similar("SELECT n_regionkey AS region, l_partkey AS token, count(*)::DOUBLE AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL", ""))
def adv14_across_levels(spark, d):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "region int")
    return cp.similar_regions(_cells(spark, d, "s_nationkey"), "region", "token", "w", wanted, 5, _cells(spark, d, "n_regionkey"))


@query(_ALIGNED + """SELECT a, b, x AS token, first(y ORDER BY n DESC, y) AS match, max(n) AS n, 'x' AS side FROM al GROUP BY a, b, x UNION ALL SELECT a, b, y, first(x ORDER BY n DESC, x), max(n), 'y' FROM al GROUP BY a, b, y""")
def adv24_both_mappings(spark, d):
    return cp.best_mappings(_aligned(spark, d))


@query("""WITH v AS (SELECT user_id, event_id, CASE WHEN event_id % 4 > 0 THEN value END AS v FROM events), r AS (SELECT user_id, round(count(v) / count(*), 6) AS voiced_ratio FROM v GROUP BY user_id),
 p AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n, min(v) OVER (PARTITION BY user_id) AS lo, max(v) OVER (PARTITION BY user_id) AS hi FROM v WHERE v IS NOT NULL),
 s AS (SELECT *, coalesce(1 + 4 * (v - lo) / nullif(hi - lo, 0), 3) AS s FROM p) SELECT user_id, any_value(voiced_ratio) AS voiced_ratio, """ + ", ".join(f"round(max(s) FILTER (k = round((n - 1) * {p} / 4)), 2) AS p{p + 1}" for p in range(5)) + """ FROM r LEFT JOIN s USING (user_id) GROUP BY user_id""")
def adv42_contour_points(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 4 > 0, F.col("value")))
    return cp.contour_points(rows, "user_id", "event_id", "v")


def _changes(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    create = spark.createDataFrame([(3, "again"), (900001, "new"), (900001, "newer")], "s_suppkey bigint, s_name string")
    update = spark.createDataFrame([(4, "renamed"), (900002, "nobody")], "s_suppkey bigint, s_name string")
    return cp.batch_changes(rows, "s_suppkey", create, update, spark.createDataFrame([(5,), (900003,)], "s_suppkey bigint"))


@query("SELECT s_suppkey, CASE s_suppkey WHEN 4 THEN 'renamed' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey <> 5 UNION ALL SELECT 900001, 'new'")
def src33_after_changes(spark, d):
    return _changes(spark, d)[0]


@query("SELECT * FROM (VALUES ('create', 3::BIGINT, 'exists'), ('create', 900001, 'repeated'), ('update', 900002, 'missing'), ('delete', 900003, 'missing')) t(kind, s_suppkey, error)")
def src33_change_errors(spark, d):
    return _changes(spark, d)[1]


@query("""SELECT (row_number() OVER (ORDER BY cid))::INT AS position, name, CASE type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS type, false AS required, name = 'o_orderkey' AS key, CASE name WHEN 'o_orderstatus' THEN 'O' END AS default FROM pragma_table_info('orders')""")
def src10_schema_table(spark, d):
    return cp.schema_table(spark, table(spark, d, "orders"), ["o_orderkey"], {"o_orderstatus": "O"})


@query("""WITH t AS (SELECT o_orderkey, o_totalprice FROM orders) SELECT *, (SELECT count(*) FROM t) AS total FROM t ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def ord1_page_with_total(spark, d):
    return pl.numbered_pages(table(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumn("_p", -F.col("o_totalprice")), ["_p", "o_orderkey"], 20, 40).drop("_p")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT event_type, NULL, count(*) FROM events GROUP BY event_type")
def str5_merged_visits(spark, d):
    """Two batches' day and all-time rows added up by path and day, null days together."""
    from lexigrid.streaming.counters import merged

    parts = [usage.day_and_all_time(table(spark, d, "events").filter(f"event_id % 2 = {k}"), "event_type", "ts") for k in (0, 1)]
    return merged(*parts, ["event_type", "day"], ["n"])
