"""Queries of the reading and look-up operators over the driver tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as fn
from lexigrid.operators import readings as rd
from lexigrid.operators import selection as sel
from lexigrid.plans.queries import _READINGS, _readings, query
from lexigrid.sources.tables import table


def _marked(spark, d):
    return _readings(spark, d).select(F.col("user_id").alias("location"), F.col("event_type").alias("value"), (F.col("k") % 20).alias("item"), (F.col("k") % 4).alias("mark"), (F.col("event_id") % 3).cast("string").alias("reading"))


_MARKED = f"(SELECT user_id AS location, event_type AS value, k % 20 AS item, k % 4 AS mark, CAST(event_id % 3 AS VARCHAR) AS reading FROM {_READINGS})"


@query(f"""WITH e AS (SELECT DISTINCT * FROM {_MARKED} WHERE location IN (SELECT c_custkey FROM customer)),
 i AS (SELECT location, value, item, count(DISTINCT reading) AS n_readings, string_agg(CASE mark WHEN 2 THEN '文·' WHEN 3 THEN '白·' ELSE '' END || reading, '|' ORDER BY mark, reading) AS shown FROM e GROUP BY ALL),
 t AS (SELECT location, count(DISTINCT item) AS n_all FROM e GROUP BY location),
 c AS (SELECT location, value, count(*) AS n_items, string_agg(item::VARCHAR, ',' ORDER BY item) AS items, string_agg(item::VARCHAR || ':' || shown, ';' ORDER BY item) FILTER (n_readings > 1) AS detail FROM i GROUP BY ALL)
SELECT c_custkey AS location, value, coalesce(n_items, 0) AS n_items, coalesce(round(n_items / n_all, 4), 0.0) AS share, coalesce(items, '') AS items, coalesce(detail, '') AS detail
FROM customer LEFT JOIN c ON c_custkey = c.location LEFT JOIN t ON c_custkey = t.location""")
def agg10_status_to_reading(spark, d):
    return rd.status_to_reading(_marked(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("location")))


@query("""WITH e AS (SELECT DISTINCT l_returnflag, p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT l_returnflag, l_suppkey, count(*) AS n FROM e GROUP BY ALL),
 t AS (SELECT l_returnflag, count(*) AS n_all FROM k GROUP BY l_returnflag)
SELECT l_returnflag, p_brand, count(*) AS n_items, count(*) FILTER (n > 1) AS n_several, round(count(*) / any_value(n_all), 4) AS share FROM e JOIN k USING (l_returnflag, l_suppkey) JOIN t USING (l_returnflag) GROUP BY ALL""")
def agg13_reading_to_status(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return rd.reading_to_status(rows, "l_returnflag", "p_brand", "l_suppkey")


_JOINED = lambda m: f"coalesce(string_agg(DISTINCT reading, '|' ORDER BY reading) FILTER (mark = {m}), '')"


@query(f"SELECT location, item, {_JOINED(1)} AS polyphonic, {_JOINED(2)} AS literary, {_JOINED(3)} AS colloquial FROM {_MARKED} GROUP BY location, item")
def agg14_mark_details(spark, d):
    return rd.mark_details(_marked(spark, d), "location", "item", "mark", "reading")


@query("""SELECT 'p_brand' AS level, p_brand AS value FROM part WHERE p_brand IS NOT NULL UNION SELECT 'p_type', p_type FROM part WHERE p_type IS NOT NULL UNION SELECT 'p_size', p_size::VARCHAR FROM part WHERE p_size IS NOT NULL""")
def agg16_level_values(spark, d):
    return rd.level_values(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query("""WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE label <> 0)
SELECT label, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(max(x) - min(x), 6) AS width, round(max(y) - min(y), 6) AS height FROM p GROUP BY label""")
def agg28_extents(spark, d):
    return rd.extents(table(spark, d, "embeddings"), "label", F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1)), 0)


_ACTIVE = lambda days: f"SELECT 'active_{days}', count(DISTINCT user_id) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {days} DAY"


@query(f"""SELECT 'calls' AS metric, count(*) AS n FROM events UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events UNION ALL {_ACTIVE(7)} UNION ALL {_ACTIVE(30)}""")
def agg45_dashboard(spark, d):
    return rd.dashboard(table(spark, d, "events"), "user_id", "ts")


@query("""WITH c AS (SELECT user_id, CASE WHEN contains(event_type, 'click') OR contains(event_type, 'view') THEN 'look' WHEN contains(event_type, 'purchase') THEN 'buy' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, kind, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY user_id), 4) AS percent FROM c""")
def agg43_preferences(spark, d):
    return rd.category_shares(table(spark, d, "events"), "user_id", fn.category(F.col("event_type"), [("look", ["click", "view"], []), ("buy", ["purchase"], [])], "other"))


@query("""WITH c AS (SELECT r_name, n_name AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT r_name, kind, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY r_name), 4) AS percent FROM c""")
def agg48_places(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    calls = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(places, F.expr("c_nationkey = n_nationkey"))
    return rd.category_shares(calls, "r_name", F.col("n_name"))


@query("SELECT count(*) AS n FROM labels WHERE toxic IS NOT DISTINCT FROM 1")
def flt4_equal_count(spark, d):
    return sel.equal_count(table(spark, d, "labels"), "toxic", 1)


@query("SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL")
def flt6_distinct_values(spark, d):
    return sel.distinct_values(table(spark, d, "part"), "p_type")


@query("""SELECT 0 AS tag, p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size IN (1, 2, 3, 4) UNION ALL SELECT 1, p_partkey FROM part WHERE p_brand = 'Brand#12' UNION ALL SELECT 2, p_partkey FROM part WHERE p_size = 2""")
def flt8_tagged_predicates(spark, d):
    return rd.tagged(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), [F.expr("p_brand = 'Brand#11' AND p_size IN (1, 2, 3, 4)"), F.expr("p_brand = 'Brand#12'"), F.expr("p_size = 2")]).select("tag", "p_partkey")


@query("""SELECT tag, p_size, count(DISTINCT p_type) AS n_items FROM (SELECT 0 AS tag, * FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT 1, * FROM part WHERE p_brand = 'Brand#12') GROUP BY tag, p_size""")
def flt9_combinations(spark, d):
    return rd.combinations(table(spark, d, "part"), [F.col("p_brand") == "Brand#11", F.col("p_brand") == "Brand#12"], ["p_size"], "p_type")


@query("""SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE starts_with(source, 's') AND length(source) >= 3 AND length(source) <= 10 AND substr(source, 2, 1) = 'r' AND (coalesce(quality = 1, false) OR coalesce(toxic = 1, false)) AND lang = 'en'""")
def flt14_subset(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    return docs.filter(rd.subset("source", "s", "prefix", 3, 10, (2, "r"), [F.col("quality") == 1, F.col("toxic") == 1], [F.col("lang") == "en"])).select("doc_id")


@query("""SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR n_name = 'ASIA' OR c_mktsegment = 'ASIA'""")
def flt17_any_level(spark, d):
    places = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    return places.filter(rd.any_level(["r_name", "n_name", "c_mktsegment"], "ASIA")).select("c_custkey")


@query("""WITH h AS (SELECT p_partkey, coalesce(regexp_matches(p_type, 'no such kind'), false) AS hit FROM part) SELECT p_partkey FROM h WHERE hit OR NOT (SELECT bool_or(hit) FROM h)""")
def flt25_matched_or_all(spark, d):
    return rd.matched_or_all(table(spark, d, "part").select("p_partkey", "p_type"), F.col("p_type").rlike("no such kind")).select("p_partkey")


@query("""SELECT event_id FROM events WHERE (starts_with(event_type, 'c') OR starts_with(event_type, 'v')) AND NOT starts_with(event_type, 'ca')""")
def flt31_prefix_rules(spark, d):
    return table(spark, d, "events").filter(rd.prefix_rules("event_type", ["c", "v"], ["ca"])).select("event_id")


@query("""SELECT count(DISTINCT trim(text)) AS n_words FROM conversations WHERE contains(text, 'a') AND trim(text) <> ''""")
def flt33_distinct_words(spark, d):
    return sel.distinct_words(table(spark, d, "conversations").filter(F.contains("text", F.lit("a"))), ["text"]).withColumnRenamed("text", "n_words")


@query("""WITH m AS (SELECT c_nationkey, round(avg((c_custkey % 90)::DOUBLE), 6) AS mean_x, round(avg((c_custkey % 180)::DOUBLE), 6) AS mean_y FROM customer GROUP BY c_nationkey)
SELECT n_nationkey AS c_nationkey, n_name, mean_x, mean_y FROM nation LEFT JOIN m ON n_nationkey = c_nationkey""")
def join14_centroids(spark, d):
    places = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 90).cast("double").alias("x"), (F.col("c_custkey") % 180).cast("double").alias("y"))
    return rd.centroids(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), places, "c_nationkey", "x", "y")


@query("""SELECT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high, l_quantity, c_custkey FROM lineitem
JOIN customer ON least(l_partkey, l_suppkey) = least(c_custkey, c_nationkey) AND greatest(l_partkey, l_suppkey) = greatest(c_custkey, c_nationkey)""")
def join15_symmetric_lookup(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_quantity")
    return rd.symmetric_lookup(pairs, table(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("long").alias("b"), "c_custkey"))


@query(f"""WITH s AS (SELECT event_type, k, list_sort(list(DISTINCT user_id % 3)) AS v FROM {_READINGS} WHERE k IN (1, 2, 3, 4, 5, 6) GROUP BY ALL)
SELECT x.event_type, x.k AS a, y.k AS b, CASE WHEN x.v = y.v THEN 'same' WHEN list_has_any(x.v, y.v) THEN 'partial' ELSE 'diff' END AS relation FROM s x JOIN s y ON x.event_type = y.event_type AND x.k < y.k""")
def join18_item_pairs(spark, d):
    return rd.item_pairs(_readings(spark, d).withColumn("v", F.col("user_id") % 3), [1, 2, 3, 4, 5, 6], "event_type", "k", "v")


@query("""SELECT (row_number() OVER (ORDER BY cid))::INT AS position, name FROM pragma_table_info('orders')""")
def src10_schema(spark, d):
    return rd.schema_rows(table(spark, d, "orders"))


@query("""SELECT c_nationkey AS key, c_name AS name FROM customer WHERE c_nationkey < 10 UNION ALL SELECT s_nationkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 10)""")
def src19_reference_list(spark, d):
    main = table(spark, d, "customer").filter("c_nationkey < 10").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"))
    return rd.reference_list(main, table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name")), "key")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS props_k, user_id AS who_id FROM events")
def src28_flattened(spark, d):
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("props"), F.struct(F.col("user_id").alias("id")).alias("who"))
    return rd.flattened(rows)
