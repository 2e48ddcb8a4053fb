"""Queries over the driver tables, one for each operator shown, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import text as fn
from lexigrid.operators import aggregation as agg
from lexigrid.operators import selection as sel
from lexigrid.operators import structures as st
from lexigrid.sources.tables import changed, row_counts, table
from lexigrid.streaming.counters import bucket_counts, merged

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """events as readings: location, item and mark."""
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


_READINGS = "(SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"


@query("""SELECT l_returnflag, feature, value, count(DISTINCT l_partkey) AS n_items FROM (
  SELECT l_returnflag, l_partkey, 'l_linestatus' AS feature, CAST(l_linestatus AS VARCHAR) AS value FROM lineitem UNION ALL
  SELECT l_returnflag, l_partkey, 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem) WHERE value IS NOT NULL GROUP BY ALL""")
def agg1_feature_values(spark, d):
    return agg.feature_values(table(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus", "l_linenumber"], "l_partkey")


@query("""SELECT feature, value, sum(n)::BIGINT AS total, count(*) AS n_keys, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS keys FROM (
  SELECT l_returnflag, feature, value, count(DISTINCT l_partkey) AS n FROM (
  SELECT l_returnflag, l_partkey, 'l_linestatus' AS feature, CAST(l_linestatus AS VARCHAR) AS value FROM lineitem UNION ALL
  SELECT l_returnflag, l_partkey, 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem) GROUP BY ALL) GROUP BY feature, value""")
def agg2_roll_up(spark, d):
    return agg.roll_up(agg1_feature_values(spark, d), "l_returnflag")


@query(f"""WITH e AS (SELECT user_id, event_type, k % 20 AS item, k % 6 AS mark FROM {_READINGS}),
 each AS (SELECT user_id, event_type, item, max((mark BETWEEN 1 AND 3)::INT) AS m, max((mark = 2)::INT) AS m2, max((mark = 3)::INT) AS m3 FROM e GROUP BY ALL),
 n AS (SELECT user_id, count(DISTINCT item) AS n_all FROM e GROUP BY user_id)
SELECT user_id, event_type, count(*) AS n_items, sum(coalesce(m, 0))::BIGINT AS n_several, sum(coalesce(m2, 0))::BIGINT AS n_second, sum(coalesce(m3, 0))::BIGINT AS n_third, sum(coalesce(m2 * m3, 0))::BIGINT AS n_both,
  any_value(n_all) AS n_all, round(count(*) / any_value(n_all), 4) AS ratio FROM each JOIN n USING (user_id) GROUP BY user_id, event_type""")
def agg3_feature_statistics(spark, d):
    rows = _readings(spark, d).select("user_id", "event_type", (F.col("k") % 20).alias("item"), (F.col("k") % 6).alias("mark"))
    return agg.feature_statistics(rows, "user_id", "event_type", "item", "mark")


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (
  SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem) GROUP BY ALL""")
def agg7_contingency(spark, d):
    return agg.contingency(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_suppkey")


@query("""WITH p AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT p_brand, sum(n) AS f FROM p GROUP BY p_brand)
SELECT p.p_brand, p_type, n, round(n * 100.0::DOUBLE / f, 6) AS share_second, round(f * 100.0::DOUBLE / (SELECT sum(f) FROM t), 6) AS share_first FROM p JOIN t USING (p_brand)""")
def agg8_nested_shares(spark, d):
    return agg.nested_shares(table(spark, d, "part"), "p_brand", "p_type")


@query("""SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n_values FROM orders GROUP BY o_custkey HAVING n_values >= 2""")
def agg15_several_values(spark, d):
    return agg.several_values(table(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, CAST(grouping(r_name) * 4 + grouping(n_name) * 2 + grouping(c_mktsegment) AS BIGINT) AS depth
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def agg17_level_counts(spark, d):
    places = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    return agg.level_counts(places, ["r_name", "n_name", "c_mktsegment"])


@query("""SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, min(ts) AS first, max(ts) AS last FROM events""")
def agg18_overview(spark, d):
    return agg.overview(table(spark, d, "events"), "user_id", "event_type", "ts")


@query("""SELECT lang, count(*) AS n, round(sum(coalesce((toxic = 1)::INT, 0)) * 100.0::DOUBLE / count(*), 6) AS toxic, round(sum(coalesce((quality = 1)::INT, 0)) * 100.0::DOUBLE / count(*), 6) AS good,
  round(avg(n_chars), 6) AS mean_measure FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def agg20_flag_matrix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return agg.flag_matrix(docs, "lang", {"toxic": F.col("toxic") == 1, "good": F.col("quality") == 1}, F.col("n_chars"))


_TABLE = """WITH x AS (SELECT event_type AS region, k % 10 AS token FROM """ + _READINGS + """),
 c AS (SELECT region, token, count(*)::DOUBLE AS a FROM x GROUP BY ALL), rr AS (SELECT region, count(*)::DOUBLE AS r FROM x GROUP BY ALL),
 tt AS (SELECT token, count(*)::DOUBLE AS t FROM x GROUP BY ALL), j AS (SELECT *, (SELECT count(*)::DOUBLE FROM x) AS n FROM c JOIN rr USING (region) JOIN tt USING (token)) """


def _regions(spark, d):
    return _readings(spark, d).select(F.col("event_type").alias("region"), (F.col("k") % 10).alias("token"))


@query(_TABLE + """SELECT region, token, a::BIGINT AS n_cell, round((a / r) / (t / n), 6) AS lift, round(log10((a + 1) * (n - r - t + a + 1) / ((r - a + 1) * (t - a + 1))), 6) AS log_odds,
  round((a / r - (t - a) / (n - r)) / sqrt(t / n * (1 - t / n) * (1 / r + 1 / (n - r))), 6) AS z FROM j""")
def agg23_tendency(spark, d):
    return agg.tendency(_regions(spark, d), "region", "token")


@query(_TABLE + """, q AS (SELECT *, n * pow(a * (n - r - t + a) - (r - a) * (t - a), 2) / (r * (n - r) * t * (n - t)) AS chi FROM j)
SELECT region, token, round(chi, 6) AS chi_square, round(exp(-chi / 2), 6) AS p, round(sqrt(chi / n), 6) AS effect FROM q""")
def agg24_significance(spark, d):
    return agg.significance(_regions(spark, d), "region", "token")


@query("""WITH c AS (SELECT l_returnflag, l_linenumber, count(DISTINCT l_partkey) AS n_items FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linenumber, n_items, round(n_items / sum(n_items) OVER (PARTITION BY l_returnflag), 6) AS share,
  round((row_number() OVER (PARTITION BY l_returnflag ORDER BY n_items DESC, l_linenumber) - 1) / greatest(count(*) OVER (PARTITION BY l_returnflag) - 1, 1), 6) AS rank_percent FROM c""")
def agg31_inventory(spark, d):
    return agg.inventory(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", "l_partkey")


_USERS = "(SELECT user_id, max(CAST(ts AS DATE)) AS latest, count(*) AS frequency, round(sum(value), 6) AS monetary FROM events GROUP BY user_id)"
_Q = lambda c, x: f"(SELECT quantile_disc({c}, {x / 5}) FROM u)"
_RISE = lambda c: "(1 + " + " + ".join(f"({c} > {_Q(c, x)})::INT" for x in range(1, 5)) + ")"


@query(f"""WITH u AS (SELECT user_id, datediff('day', latest, (SELECT max(CAST(ts AS DATE)) FROM events)) AS recency, frequency, monetary FROM {_USERS}),
 s AS (SELECT *, 7 - 1 - {_RISE("recency")} AS r, {_RISE("frequency")} AS f, {_RISE("monetary")} AS m FROM u)
SELECT *, CASE WHEN r >= 4 AND f >= 4 THEN 'champion' WHEN f >= 4 THEN 'loyal' WHEN r >= 4 THEN 'recent' WHEN r <= 2 AND f <= 2 THEN 'lost' WHEN r <= 2 THEN 'at risk' ELSE 'middle' END AS segment FROM s""")
def agg36_rfm(spark, d):
    return agg.rfm(table(spark, d, "events"), "user_id", "ts", "value")


@query("""WITH c AS (SELECT o_custkey, count(*) AS calls FROM orders GROUP BY o_custkey), n AS (SELECT avg(calls) AS m, stddev_samp(calls) AS s FROM c)
SELECT o_custkey, calls, round((calls - m) / s, 6) AS z, CASE WHEN (calls - m) / s > 5 THEN 'high' ELSE 'medium' END AS severity FROM c, n WHERE calls > m + 3 * s""")
def agg37_outliers(spark, d):
    return agg.outliers(table(spark, d, "orders"), "o_custkey")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
 t AS (SELECT user_id, sum(n)::BIGINT AS calls, max(n) AS most FROM c GROUP BY user_id)
SELECT user_id, calls, (SELECT min(event_type) FROM c WHERE c.user_id = t.user_id AND n = most) AS top_path, round(most / calls, 6) AS share FROM t WHERE most >= 0.27 * calls""")
def agg38_one_sided(spark, d):
    return agg.one_sided(table(spark, d, "events"), "user_id", "event_type", 0.27)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(sum(-p * log2(p)), 6) AS entropy, sum(n)::BIGINT AS n, round(sum(-p * log2(p)), 6) > 2.0 AS explorer FROM p GROUP BY user_id""")
def agg40_entropy(spark, d):
    return agg.entropy(table(spark, d, "events"), "user_id", "event_type")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[greatest(ceil(count(*) * 50 / 100), 1)::INT] AS p50,
  list_sort(list(value))[greatest(ceil(count(*) * 95 / 100), 1)::INT] AS p95, list_sort(list(value))[greatest(ceil(count(*) * 99 / 100), 1)::INT] AS p99,
  round(sum((value > 100)::INT) / count(*), 6) AS slow_ratio FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def agg41_nearest_rank(spark, d):
    return agg.nearest_rank(table(spark, d, "events"), "event_type", "value", [50, 95, 99], slow=100.0)


@query("""WITH e AS (SELECT *, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket FROM events), c AS (SELECT bucket, event_type, count(*) AS n FROM e GROUP BY ALL),
 t AS (SELECT bucket, first(event_type ORDER BY n DESC, event_type) AS top_path FROM c GROUP BY bucket)
SELECT bucket, count(*) AS calls, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, any_value(top_path) AS top_path FROM e JOIN t USING (bucket) GROUP BY bucket""")
def agg42_trend(spark, d):
    return agg.trend(table(spark, d, "events"), "ts", "hour", "user_id", "event_type", "value")


@query("""WITH n AS (SELECT CAST(date_trunc('month', f) AS TIMESTAMP) AS month, count(*) AS n_new FROM (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY o_custkey) GROUP BY 1)
SELECT month, n_new, (sum(n_new) OVER (ORDER BY month))::BIGINT AS total, round((n_new - lag(n_new) OVER (ORDER BY month)) * 100.0::DOUBLE / lag(n_new) OVER (ORDER BY month), 6) AS growth FROM n""")
def agg44_growth(spark, d):
    return agg.growth(table(spark, d, "orders"), "o_orderdate", "o_custkey")


@query("""WITH t AS (SELECT o_custkey, round(sum(o_totalprice), 6) AS total, count(DISTINCT o_orderpriority) AS users FROM orders GROUP BY o_custkey),
 s AS (SELECT total, lag(total) OVER (ORDER BY total DESC) AS larger FROM (SELECT DISTINCT total FROM t))
SELECT o_custkey, t.total AS total, users, rank() OVER (ORDER BY t.total DESC) AS rank, round(larger - t.total, 4) AS gap, round(t.total * 100 / (SELECT max(total) FROM t), 4) AS percent_of_first,
  round(t.total * 100 / (SELECT sum(total) FROM t), 4) AS percent_of_all FROM t JOIN s USING (total)""")
def win5_ranking(spark, d):
    return agg.ranking(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderpriority")


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0.0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def join4_zero_filled(spark, d):
    return agg.zero_filled(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", "o_totalprice")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)""")
def join8_having_semi(spark, d):
    return sel.with_many(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey", 12, ["c_custkey", "c_name"])


@query("""SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_returnflag = 'R')""")
def join7_exists(spark, d):
    lines = table(spark, d, "lineitem").filter("l_quantity > 49 AND l_returnflag = 'R'")
    return sel.with_match(table(spark, d, "supplier"), lines, F.expr("s_suppkey = l_suppkey"), ["s_suppkey", "s_name"])


@query("""SELECT p_brand, l_returnflag, count(DISTINCT l_partkey) AS n_parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def join1_readings_classes(spark, d):
    return agg.items_by_class(table(spark, d, "lineitem"), table(spark, d, "part"), F.expr("l_partkey = p_partkey"), ["p_brand", "l_returnflag"], "l_partkey")


@query("""SELECT dayofweek(ts) AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL""")
def agg62_heat_map(spark, d):
    return agg.heat_map(table(spark, d, "events"), "ts")


@query("""SELECT event_type, user_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM
  (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 5""")
def win1_top_per_group(spark, d):
    return agg.top_per_group(table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")), "event_type", [F.desc("n"), F.col("user_id")], 5)


@query("""WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS mean FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, round(mean, 6) AS mean, round((mean - (SELECT avg(mean) FROM m)) / (SELECT stddev_samp(mean) FROM m), 6) AS z FROM m""")
def win12_standard_scores(spark, d):
    return agg.standard_scores(table(spark, d, "customer"), "c_nationkey", "c_acctbal")


@query("""WITH x AS (SELECT user_id, event_id, event_id % 7 > 1 AS flag, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 y AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, flag ORDER BY event_id) AS island FROM x)
SELECT user_id, count(*) AS length, min(event_id) AS first, max(event_id) AS last FROM y WHERE flag GROUP BY user_id, island HAVING count(*) >= 3""")
def win17_runs(spark, d):
    return agg.runs(table(spark, d, "events"), "user_id", "event_id", F.col("event_id") % 7 > 1, 3)


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def str10_sliding_count(spark, d):
    return agg.sliding_count(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "user_id", "in_window")


@query("""WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events)
SELECT user_id, round(sum(CASE WHEN gap <= 86400 THEN gap ELSE 0 END), 3) AS seconds, count(*) AS n FROM g GROUP BY user_id""")
def str13_active_time(spark, d):
    return agg.active_time(table(spark, d, "events"), "user_id", "ts", 86400)


@query("""SELECT event_type, unit, bucket, count(*) AS n FROM (SELECT event_type, 'hour' AS unit, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket FROM events
  UNION ALL SELECT event_type, 'day', CAST(date_trunc('day', ts) AS TIMESTAMP) FROM events) GROUP BY ALL""")
def str2_bucket_counts(spark, d):
    events = table(spark, d, "events")
    old, new = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    return merged(bucket_counts(old, ["event_type"], "ts"), bucket_counts(new, ["event_type"], "ts"), ["event_type", "unit", "bucket"], ["n"])


@query("""SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') AND (p_size IN (1, 2, 3) OR p_size IS NULL)""")
def flt1_matches(spark, d):
    return table(spark, d, "part").filter(sel.matches({"p_brand": ["Brand#11", "Brand#12"], "p_size": [1, 2, 3, None]})).select("p_partkey", "p_brand")


@query("""SELECT doc_id FROM documents WHERE contains(lower(source), 'rc1') OR contains(lower(lang), 'rc1')""")
def flt2_text_search(spark, d):
    return table(spark, d, "documents").filter(sel.contains_text(["source", "lang"], "RC1")).select("doc_id")


@query("""SELECT DISTINCT p_size FROM part WHERE p_brand IN ('Brand#11') ORDER BY p_size LIMIT 1000""")
def flt5_facet(spark, d):
    return sel.facet(table(spark, d, "part"), "p_size", {"p_brand": ["Brand#11"], "p_size": [1]})


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def ord1_page(spark, d):
    return sel.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 40)


@query("""SELECT count(*) AS n FROM events WHERE NOT (event_type LIKE 'c%' OR event_type = 'view')""")
def flt30_excluded(spark, d):
    return table(spark, d, "events").filter(sel.excluded_paths("event_type", ["c*", "view"])).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n_rows FROM customer WHERE contains(c_name, '00') OR contains(c_mktsegment, '00')""")
def flt36_preview(spark, d):
    return sel.replace_preview(table(spark, d, "customer"), ["c_name", "c_mktsegment"], "00", "contains")


@query("""SELECT c_custkey, replace(c_name, '00', '#') AS c_name, replace(c_mktsegment, '00', '#') AS c_mktsegment FROM customer""")
def flt37_replace(spark, d):
    return sel.replace_all(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], "00", "#", "contains")


@query("""SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, 'F' FROM customer WHERE c_mktsegment = 'BUILDING')""")
def src5_pair_scan(spark, d):
    pairs = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    return sel.by_pairs(table(spark, d, "orders"), pairs, ["o_custkey", "o_orderstatus"]).select("o_orderkey")


@query("""SELECT 'orders' AS name, count(*) AS n_rows FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events""")
def src12_row_counts(spark, d):
    return row_counts(spark, d, ["orders", "part", "events"])


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 3 = 0""")
def src33_changes(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return changed(rows, "s_suppkey", rows.filter("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), rows.filter("s_suppkey % 5 = 0"))


@query("""SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS leaves FROM (SELECT DISTINCT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name""")
def adv1_tree(spark, d):
    return st.tree_paths(table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")), ["r_name", "n_name"])


@query("""SELECT DISTINCT p_type AS child FROM part WHERE p_brand = 'Brand#11'""")
def adv2_children(spark, d):
    return st.children(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], ["Brand#11"])


_SETS = "(SELECT s_nationkey AS k, list(DISTINCT l_partkey) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey)"


@query(f"""WITH s AS {_SETS} SELECT x.k AS a, y.k AS b, CASE WHEN list_sort(x.v) = list_sort(y.v) THEN 'same' WHEN list_has_any(x.v, y.v) THEN 'partial' ELSE 'diff' END AS relation,
  round(len(list_intersect(x.v, y.v)) / len(list_distinct(list_concat(x.v, y.v))), 6) AS jaccard FROM s x JOIN s y ON x.k < y.k""")
def set6_key_pairs(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey"))
    return st.key_pairs(rows, "s_nationkey", "l_partkey")


@query("""WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, i), v AS (SELECT label, list(mean ORDER BY i) AS v FROM m GROUP BY label)
SELECT x.label AS a, y.label AS b, round(list_cosine_similarity(x.v, y.v), 6) AS cosine, round(list_distance(x.v, y.v), 6) AS euclid,
  round(list_sum(list_transform(range(1, 65), lambda i: abs(x.v[i] - y.v[i]))), 6) AS manhattan FROM v x JOIN v y ON x.label < y.label""")
def adv11_vector_pairs(spark, d):
    means = st.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    vectors = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dimension", "mean"))), lambda x: x["mean"]).alias("v"))
    return st.vector_pairs(vectors, "label", "v")


_ALIGNED = """WITH one AS (SELECT event_type AS k, user_id, string_agg(t, '|' ORDER BY t) AS token FROM (SELECT DISTINCT event_type, user_id, CAST(k % 3 AS VARCHAR) AS t FROM """ + _READINGS + """) GROUP BY ALL),
 al AS (SELECT p.k AS a, q.k AS b, p.token AS x, q.token AS y, count(*) AS n FROM one p JOIN one q ON p.user_id = q.user_id AND p.k < q.k GROUP BY ALL) """


def _aligned(spark, d):
    return st.alignment(_readings(spark, d).select("event_type", "user_id", (F.col("k") % 3).alias("t")), "event_type", "user_id", "t")


@query(_ALIGNED + "SELECT * FROM al")
def adv24_alignment(spark, d):
    return _aligned(spark, d)


@query(_ALIGNED + """, p AS (SELECT *, n / sum(n) OVER (PARTITION BY a, b) AS p, n / sum(n) OVER (PARTITION BY a, b, x) AS yx, n / sum(n) OVER (PARTITION BY a, b, y) AS xy FROM al)
SELECT a, b, round((sum(-p * ln(yx)) / ln(greatest(count(DISTINCT y), 2)) + sum(-p * ln(xy)) / ln(greatest(count(DISTINCT x), 2))) / 2, 6) AS distance FROM p GROUP BY a, b""")
def adv25_distance(spark, d):
    return st.correspondence_distance(_aligned(spark, d))


@query(_ALIGNED + "SELECT a, b, x, first(y ORDER BY n DESC, y) AS y, max(n) AS n FROM al GROUP BY a, b, x")
def adv24_best_mapping(spark, d):
    return st.best_mapping(_aligned(spark, d))


@query("""WITH c AS (SELECT lang, char, count(*) AS n FROM (SELECT lang, unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) AS char FROM documents) WHERE char <> '' GROUP BY ALL)
SELECT lang, char, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, char) AS rank FROM c) WHERE rank <= 20""")
def agg34_characters(spark, d):
    return st.character_counts(table(spark, d, "documents").select("lang", "text"), "lang", "text", 20)


@query("""SELECT event_id, round(2 * 6371.0 * asin(least(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)), 1)), 6) AS km
FROM (SELECT event_id, (user_id % 90)::DOUBLE AS lat1, (event_id % 180)::DOUBLE AS lon1, (event_id % 90)::DOUBLE AS lat2, (user_id % 180)::DOUBLE AS lon2 FROM events)""")
def fn23_haversine(spark, d):
    x = lambda c, m: (F.col(c) % m).cast("double")
    km = st.haversine(x("event_id", 180), x("user_id", 90), x("user_id", 180), x("event_id", 90))
    return table(spark, d, "events").select("event_id", F.round(km, 6).alias("km"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1), '/[0-9]+/', '/{id}/', 'g'), '/[0-9]+$', '/{id}') AS route FROM pages""")
def fn17_routes(spark, d):
    return table(spark, d, "pages").select("page_id", fn.route_template(F.col("url")).alias("route"))


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') AND NOT contains(p_type, 'SMALL') THEN 'brass' WHEN contains(p_type, 'TIN') OR contains(p_type, 'STEEL') THEN 'metal' ELSE 'other' END AS kind FROM part""")
def fn21_category(spark, d):
    rules = [("brass", ["BRASS"], ["SMALL"]), ("metal", ["TIN", "STEEL"], [])]
    return table(spark, d, "part").select("p_partkey", fn.category(F.col("p_type"), rules, "other").alias("kind"))


@query("""SELECT event_id, 'k=***' AS shown FROM events WHERE FALSE UNION ALL SELECT event_id, substr(regexp_replace(props, '("(?:k)"\\s*:\\s*)("[^"]*"|[0-9.]+)', '\\1"***"', 'g'), 1, 40) FROM events""")
def fn19_redacted(spark, d):
    return table(spark, d, "events").select("event_id", fn.redacted(F.col("props"), ["k"], 40).alias("shown"))
