"""Variants of operators, each with the ordering, zero rows and ties of its own, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.operators import aggregation as agg
from lexigrid.operators import readings as rd
from lexigrid.operators import selection as sel
from lexigrid.operators import variants as vr
from lexigrid.plans.queries import _READINGS, _readings, query
from lexigrid.sources import tables as tb
from lexigrid.sources.tables import table
from lexigrid.streaming.counters import merged


@query("SELECT p_brand, l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def src4_two_stores(spark, d):
    """Facts and dimension of two stores, each read for its own columns."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    return lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")).groupBy("p_brand", "l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') AND (p_type IN ('SMALL') OR p_type IS NULL OR p_type = '')")
def flt3_by_index(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return part.filter(vr.matches_by_index(part.columns, {1: ["Brand#11", "Brand#12"], 2: ["SMALL", vr.BLANK]})).select("p_partkey", "p_size")


@query("SELECT p_brand, p_type, l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def join2_two_classes(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.expr("l_partkey = p_partkey"))
    return rows.groupBy("p_brand", "p_type", "l_returnflag").agg(F.countDistinct("l_partkey").alias("n"))


@query("SELECT c_custkey, c_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def join6_users_with_usage(spark, d):
    """Users without usage have no row, unlike join4."""
    sums = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(sums, "c_custkey")


@query(f"SELECT user_id, count(DISTINCT k) AS n_items FROM {_READINGS} WHERE event_type <> 'error' GROUP BY user_id")
def agg4_denominators(spark, d):
    return vr.denominators(_readings(spark, d).filter("event_type <> 'error'"), "user_id", "k")


@query(f"SELECT user_id, event_type, k AS item FROM {_READINGS} GROUP BY ALL HAVING bool_or(event_id % 4 = 2) AND bool_or(event_id % 4 = 3)")
def agg5_both_marks(spark, d):
    rows = _readings(spark, d).withColumn("mark", F.col("event_id") % 4)
    return vr.both_marks(rows, ["user_id", "event_type"], "k", "mark", 2, 3).withColumnRenamed("k", "item")


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, string_agg(l_suppkey, '' ORDER BY l_suppkey, l_orderkey) AS items, count(*) AS n FROM lineitem GROUP BY ALL""")
def agg6_cross_table(spark, d):
    """Repeated items stay, unlike agg7."""
    return vr.cross_table(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_suppkey")


_ITEM = lambda test: f"coalesce(string_agg(k::VARCHAR, '' ORDER BY k::VARCHAR) FILTER ({test}), '')"


@query(f"""WITH i AS (SELECT user_id, event_type, k, bool_or(event_id % 5 BETWEEN 1 AND 3) AS a, bool_or(event_id % 5 = 2) AS b, bool_or(event_id % 5 = 3) AS c FROM {_READINGS} GROUP BY ALL)
SELECT user_id, event_type, {_ITEM("a")} AS several, {_ITEM("b")} AS second, {_ITEM("c")} AS third, {_ITEM("b AND c")} AS both FROM i GROUP BY ALL""")
def agg6_cross_marks(spark, d):
    return vr.cross_marks(_readings(spark, d).withColumn("mark", F.col("event_id") % 5), ["user_id", "event_type"], "k", "mark")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_suppkey FROM lineitem")
def agg7_contingency_long(spark, d):
    return agg.contingency_long(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_suppkey")


@query("""WITH p AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT p_type, sum(n) AS f FROM p GROUP BY p_type)
SELECT p.p_type, p_brand, n, round(n * 100.0::DOUBLE / f, 6) AS share_second, round(f * 100.0::DOUBLE / (SELECT sum(f) FROM t), 6) AS share_first FROM p JOIN t USING (p_type)""")
def agg9_shares_by_class(spark, d):
    return agg.nested_shares(table(spark, d, "part"), "p_type", "p_brand")


@query("""WITH t AS (SELECT r_name, n_name, c_mktsegment, count(*) AS f FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), c AS (SELECT r_name, c_mktsegment, sum(f)::BIGINT AS f FROM t GROUP BY ALL)
SELECT r_name, c_mktsegment, f, round(f * 100.0::DOUBLE / sum(f) OVER (PARTITION BY r_name), 6) AS percent, row_number() OVER (PARTITION BY r_name ORDER BY f DESC, c_mktsegment) AS rank FROM c""")
def agg22_from_lower_level(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    lower = rows.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("f"))
    return vr.from_lower_level(lower, "r_name", "c_mktsegment", "f")


@query("SELECT count(*) AS calls, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS paths FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'")
def agg50_in_range(spark, d):
    return vr.in_range(table(spark, d, "events"), "ts", F.expr("TIMESTAMP '2024-01-05'"), F.expr("TIMESTAMP '2024-01-15'"), "user_id", "event_type")


@query("SELECT (SELECT count(*) FROM events) AS calls, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM pages) AS visits, (SELECT count(DISTINCT url) FROM pages) AS urls")
def agg51_two_summaries(spark, d):
    calls = table(spark, d, "events").agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"))
    return calls.crossJoin(table(spark, d, "pages").agg(F.count("*").alias("visits"), F.countDistinct("url").alias("urls")))


@query("SELECT props AS value, count(*) AS n FROM events GROUP BY props ORDER BY n DESC, value LIMIT 20")
def agg52_field_values(spark, d):
    return vr.field_values(table(spark, d, "events"), "props", ["event_type", "props"], 20)


@query("""WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY bucket)
SELECT bucket, n, n = (SELECT max(n) FROM h) AS peak, (SELECT (sum(n) // count(*))::BIGINT FROM h) AS mean_n FROM h""")
def agg55_hourly_with_peak(spark, d):
    return vr.with_peak(table(spark, d, "events"), "ts", "hour")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n, count(DISTINCT user_id) AS n_different FROM events WHERE event_type = 'click' GROUP BY bucket")
def agg56_daily(spark, d):
    return vr.daily(table(spark, d, "events"), "ts", "event_type", "user_id", "click")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id = 5 GROUP BY event_type")
def agg64_user_detail(spark, d):
    return vr.user_detail(table(spark, d, "events"), "user_id", 5, "event_type", "value")


@query("SELECT r_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)")
def agg71_cube(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    return rows.cube("r_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT event_type, round(sum(value), 6) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type)
SELECT event_type, total, users, rank() OVER (ORDER BY total DESC) AS rank, round(lag(total) OVER (ORDER BY total DESC) - total, 4) AS gap, round(total * 100 / max(total) OVER (), 4) AS percent_of_first, round(total * 100 / sum(total) OVER (), 4) AS percent_of_all FROM t""")
def win7_ranked_paths(spark, d):
    return agg.ranking(table(spark, d, "events"), "event_type", "value", "user_id")


@query("""WITH t AS (SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY user_id HAVING total > 0) SELECT user_id, total, rank() OVER (ORDER BY total DESC) AS rank FROM t""")
def win8_ranked_time(spark, d):
    return vr.ranked_positive(table(spark, d, "events"), "user_id", "value")


@query("""WITH n AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n_new FROM orders GROUP BY month)
SELECT month, n_new, (sum(n_new) OVER (ORDER BY month))::BIGINT AS total, round((n_new - lag(n_new) OVER (ORDER BY month)) * 100.0::DOUBLE / lag(n_new) OVER (ORDER BY month), 6) AS growth FROM n""")
def win10_cumulative(spark, d):
    return agg.growth(table(spark, d, "orders"), "o_orderdate", "o_orderkey")


@query("""WITH c AS (SELECT event_type, k, count(*) AS n FROM """ + _READINGS + """ GROUP BY ALL) SELECT event_type, k, round((row_number() OVER (PARTITION BY event_type ORDER BY n DESC, k) - 1) / greatest(count(*) OVER (PARTITION BY event_type) - 1, 1), 6) AS rank_percent FROM c""")
def win11_rank_percent(spark, d):
    return vr.rank_percent(_readings(spark, d), "event_type", "k")


@query("""WITH p AS (SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY l_returnflag), 4) AS of_group, round(n * 100.0::DOUBLE / sum(n) OVER (), 4) AS of_all FROM p""")
def win13_two_levels(spark, d):
    return vr.two_levels(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_partkey")


@query("SELECT DISTINCT k, dense_rank() OVER (ORDER BY k) - 1 AS place FROM " + _READINGS)
def win14_dense_index(spark, d):
    return vr.dense_index(_readings(spark, d), "k")


@query("""WITH i AS (SELECT DISTINCT k, dense_rank() OVER (ORDER BY k) - 1 AS place FROM """ + _READINGS + """)
SELECT user_id, event_type, string_agg(DISTINCT place, ',' ORDER BY place) AS places FROM """ + _READINGS + """ JOIN i USING (k) GROUP BY user_id, event_type""")
def agg3_dictionary_places(spark, d):
    """Items of each cell as sorted places in the dictionary of all items."""
    return vr.dictionary_places(_readings(spark, d), ["user_id", "event_type"], "k")


@query("""WITH v AS (SELECT event_id, user_id, value, lag(value) OVER w AS p, lead(value) OVER w AS n, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 c AS (SELECT * FROM v WHERE value > p AND value > n), m AS (SELECT a.event_id, a.user_id, a.value, a.k FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.user_id = a.user_id AND b.k <> a.k AND abs(b.k - a.k) < 4 AND (b.value > a.value OR (b.value = a.value AND b.k < a.k))))
SELECT event_id, user_id, value FROM m""")
def win19_local_peaks(spark, d):
    return vr.local_peaks(table(spark, d, "events"), "user_id", "event_id", "value", 4)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def ord3_top_listed(spark, d):
    return sel.page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 25)


@query("""SELECT feature, value, count(*) AS n FROM (SELECT 'l_linestatus' AS feature, l_linestatus AS value FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem) WHERE value IS NOT NULL GROUP BY ALL""")
def set1_feature_union(spark, d):
    return vr.feature_union(table(spark, d, "lineitem"), ["l_linestatus", "l_returnflag", "l_linenumber"])


@query("""SELECT 0 AS query, p_partkey FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT 1, p_partkey FROM part WHERE p_type = 'SMALL' AND p_size < 10""")
def set2_tagged_union(spark, d):
    return vr.tagged(table(spark, d, "part"), [F.col("p_brand") == "Brand#11", (F.col("p_type") == "SMALL") & (F.col("p_size") < 10)]).select("query", "p_partkey")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def set4_distinct(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("""SELECT event_type, sum(n)::BIGINT AS n, round(sum(total), 4) AS total FROM (SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type) GROUP BY event_type""")
def src31_upsert(spark, d):
    """Old sums and a batch's sums added up by key."""
    sums = lambda k: table(spark, d, "events").filter(f"event_id % 2 = {k}").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return merged(sums(0), sums(1), ["event_type"], ["n", "total"]).withColumn("total", F.round("total", 4))


@query("SELECT s_suppkey, CASE s_suppkey WHEN 3 THEN 'renamed' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey <> 5 UNION ALL SELECT 1000001, 'new'")
def src32_one_row_changes(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    updates = spark.createDataFrame([(3, "renamed"), (1000001, "new")], "s_suppkey bigint, s_name string")
    return tb.changed(rows, "s_suppkey", updates, spark.createDataFrame([(5,)], "s_suppkey bigint"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity, 2) AS total FROM lineitem WHERE l_partkey = 7""")
def join3_in_input_order(spark, d):
    wanted = spark.createDataFrame([(0, 7)], "place int, l_partkey bigint")
    rows = vr.in_input_order(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), wanted, "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", F.round("l_quantity", 2).alias("total"))


@query("""SELECT user_id, path, sum(n)::BIGINT AS n, round(sum(total), 4) AS total FROM (SELECT user_id, event_type AS path, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL) GROUP BY ALL""")
def str4_summary_batch(spark, d):
    rows = lambda k: table(spark, d, "events").filter(f"event_id % 2 = {k}").groupBy("user_id", F.col("event_type").alias("path")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return merged(rows(0), rows(1), ["user_id", "path"], ["n", "total"]).withColumn("total", F.round("total", 4))


@query("""SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1') AND p_type IN ('SMALL', 'ECONOMY', 'LARGE')""")
def flt7_path_predicate(spark, d):
    test = vr.path_predicate("[Brand#1]{p_brand}[grade]{p_type}", ["p_brand", "p_type"], {("p_type", "grade"): ["SMALL", "ECONOMY", "LARGE"]})
    return table(spark, d, "part").filter(test).select("p_partkey")


@query("SELECT doc_id FROM labels WHERE NOT coalesce(toxic::VARCHAR = '1', false) AND NOT coalesce(quality::VARCHAR = '1', false)")
def flt10_unflagged(spark, d):
    return table(spark, d, "labels").filter(vr.unflagged(["toxic", "quality"])).select("doc_id")


@query("SELECT p_partkey FROM part WHERE (p_brand = 'Brand#3' OR p_brand = 'Brand#4') AND (p_type = 'SMALL' OR p_type = 'LARGE')")
def flt11_structured(spark, d):
    return table(spark, d, "part").filter(sel.matches({"p_brand": ["Brand#3", "Brand#4"], "p_type": ["SMALL", "LARGE"]})).select("p_partkey")


@query("SELECT DISTINCT trim(role) AS word FROM conversations WHERE role ILIKE '%s%' ORDER BY word LIMIT 500")
def flt32_word_list(spark, d):
    return vr.word_list(table(spark, d, "conversations"), "role", "s", 500)


@query("SELECT conv_id, turn, role FROM conversations ORDER BY turn DESC, conv_id LIMIT 30 OFFSET 10")
def flt34_item_page(spark, d):
    return sel.page(table(spark, d, "conversations").select("conv_id", "turn", "role"), [F.desc("turn"), F.col("conv_id")], 30, 10)


@query(f"SELECT user_id, event_type AS value, count(DISTINCT k) AS n_items, sum(count(DISTINCT k)) OVER (PARTITION BY user_id)::BIGINT AS total FROM {_READINGS} GROUP BY user_id, event_type")
def agg11_values_with_totals(spark, d):
    return vr.values_with_totals(_readings(spark, d), "user_id", "event_type", "k")


@query("""SELECT b.p_brand, t.p_type, count(DISTINCT l_partkey) AS n_items FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type FROM part) t LEFT JOIN (SELECT p_brand, p_type, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey) x ON x.p_brand = b.p_brand AND x.p_type = t.p_type GROUP BY ALL""")
def agg12_all_combinations(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return vr.all_combinations(table(spark, d, "part"), rows, ["p_brand", "p_type"], "l_partkey")


@query("""SELECT conv_id, role, string_agg(DISTINCT substr(text, 1, 3), '|' ORDER BY substr(text, 1, 3)) AS notes, count(*) AS n FROM conversations GROUP BY conv_id, role""")
def fn7_reading_details(spark, d):
    return vr.reading_details(table(spark, d, "conversations").withColumn("note", F.substring("text", 1, 3)), ["conv_id"], "role", "note")


@query("SELECT 'orders' AS name, count(*) AS n_rows, true AS sized FROM orders UNION ALL SELECT 'part', count(*), true FROM part")
def src11_table_list(spark, d):
    return tb.table_list(spark, d, ["orders", "part"]).select("name", "n_rows", (F.col("bytes") > 0).alias("sized"))


@query("SELECT k::VARCHAR AS category, event_id AS id FROM (SELECT event_id, json_extract(props, '$.k') AS k FROM events)")
def src13_lexicon(spark, d):
    text = table(spark, d, "events").select(F.concat(F.lit('{"'), F.get_json_object("props", "$.k"), F.lit('": ["'), "event_id", F.lit('"]}')).alias("value"))
    return tb.lexicon(text, "value").select("category", F.col("word").cast("long").alias("id"))


@query("SELECT doc_id::VARCHAR AS number, lang AS tongue FROM documents")
def src14_aliased(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias(" Doc ID"), F.col("lang").alias("Sprache"))
    return tb.aliased(docs, {"number": ["doc id", "no"], "tongue": ["sprache", "lang"]})


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def src25_csv_round_trip(spark, d):
    return vr.round_trip(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "csv")


@query("SELECT c_custkey, c_name FROM customer")
def src27_json_round_trip(spark, d):
    return vr.round_trip(table(spark, d, "customer").select("c_custkey", "c_name"), "json")


@query("SELECT s_suppkey, s_name AS detail_name, s_nationkey AS detail_nation FROM supplier")
def src29_exported_flat(spark, d):
    nested = table(spark, d, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("detail"))
    return vr.round_trip(rd.flattened(nested), "csv")
