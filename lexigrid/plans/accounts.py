"""Queries on users, sessions and logs: events as a usage log, orders as sessions of customers, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as fn
from lexigrid.operators import accounts as ac
from lexigrid.operators import usage
from lexigrid.plans.queries import query
from lexigrid.plans.scalars import _DEVICE, AGENTS, _pick
from lexigrid.sources.tables import table

_LAST = "(SELECT max(ts) FROM events)"


def _now(spark, d):
    """The last event's time, from one small aggregate."""
    return F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0])


@query(_DEVICE + """, c AS (SELECT 'os' AS kind, os AS value, count(DISTINCT user_id) AS users FROM v GROUP BY os UNION ALL SELECT 'browser', browser, count(DISTINCT user_id) FROM v GROUP BY browser)
SELECT kind, value, users, round(users * 100.0::DOUBLE / sum(users) OVER (PARTITION BY kind), 4) AS percent FROM c""")
def agg47_distribution(spark, d):
    x = fn.device(_pick(AGENTS, "event_id"))
    return ac.distribution(table(spark, d, "events"), "user_id", {"os": x["os"], "browser": x["browser"]})


@query(f"""SELECT 'keyword_total' AS kind, NULL::DATE AS day, event_type AS category, props AS item, count(*) AS n FROM events GROUP BY ALL UNION ALL
SELECT 'keyword_daily', CAST(ts + INTERVAL 8 HOUR AS DATE), event_type, props, count(*) FROM events WHERE ts >= {_LAST} - INTERVAL 7 DAY GROUP BY ALL""")
def agg54_keyword_statistics(spark, d):
    return ac.keyword_statistics(table(spark, d, "events"), "event_type", "props", "ts", "Asia/Shanghai", 7, _now(spark, d))


@query(f"SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'click' AND ts >= {_LAST} - INTERVAL 10 DAY GROUP BY day")
def agg58_history(spark, d):
    return ac.history(table(spark, d, "events"), "event_type", "ts", "click", 10, _now(spark, d))


@query(f"SELECT (SELECT count(*) FROM events)::BIGINT AS total, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = CAST({_LAST} AS DATE))::BIGINT AS today")
def agg59_visit_totals(spark, d):
    counts = usage.day_and_all_time(table(spark, d, "events"), "event_type", "ts")
    return ac.visit_totals(counts, F.to_date(_now(spark, d)))


@query(f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events WHERE ts >= {_LAST} - INTERVAL 5 DAY)
SELECT user_id, count(*) AS n_sessions, max(ts) AS latest, string_agg(event_id, ',' ORDER BY k) FILTER (k <= 3) AS sessions FROM u GROUP BY user_id""")
def agg61_online_users(spark, d):
    return ac.online_users(table(spark, d, "events"), "user_id", "event_id", "ts", _now(spark, d) - F.expr("INTERVAL 5 DAYS"), 3)


_OLD = "TIMESTAMP '1996-01-01'"


@query(f"""SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> 'F' AND o_orderdate > {_OLD}) AS active, count(*) FILTER (o_orderstatus = 'F') AS revoked, count(*) FILTER (o_orderstatus <> 'F' AND o_orderdate <= {_OLD}) AS expired,
  count(DISTINCT CASE WHEN o_orderstatus <> 'F' AND o_orderdate > {_OLD} THEN o_custkey END) AS active_users FROM orders""")
def agg63_token_statistics(spark, d):
    return ac.token_statistics(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderdate", F.expr(_OLD))


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'error') AND NOT value > 50")
def agg65_login_log(spark, d):
    return ac.login_log(table(spark, d, "events"), ["click", "error"], "event_type", F.col("value") > 50, False).select("event_id", "user_id")


@query(f"""WITH x AS (SELECT user_id, ts, unnest([event_type, 'all']) AS location FROM events) SELECT location, count(DISTINCT user_id) AS n_regions, count(*) AS n, count(*) FILTER (ts >= {_LAST} - INTERVAL 30 DAY) AS recent FROM x GROUP BY location ORDER BY n DESC, location LIMIT 4""")
def agg66_region_statistics(spark, d):
    rows = table(spark, d, "events").withColumn("places", F.concat(F.lit('["'), "event_type", F.lit('", "all"]')))
    return ac.region_statistics(rows, "user_id", "places", "ts", _now(spark, d) - F.expr("INTERVAL 30 DAYS"), 4)


@query("""SELECT user_id, event_type, props, min(event_id % 100) AS place, count(*) AS n_features, max(ts) AS latest FROM events GROUP BY user_id, event_type, props""")
def agg67_grouped_points(spark, d):
    return ac.grouped_points(table(spark, d, "events").withColumn("place", F.col("event_id") % 100), "user_id", "event_type", "props", "place", "ts")


@query("""SELECT user_id, event_type, event_id % 3 AS kind, count(DISTINCT (props, event_id % 2)) AS n_places, max(ts) AS latest FROM events GROUP BY ALL""")
def agg67_grouped_features(spark, d):
    rows = table(spark, d, "events").withColumns({"kind": F.col("event_id") % 3, "half": F.col("event_id") % 2})
    return ac.grouped_features(rows, "user_id", "event_type", "kind", "props", "half", "ts")


@query("""SELECT event_type, props, min(event_id % 100) AS place, count(*) AS n_features, max(ts) AS latest FROM events WHERE user_id = 7 GROUP BY event_type, props ORDER BY latest DESC, event_type, props LIMIT 25""")
def ord7_latest_first(spark, d):
    return ac.latest_first(agg67_grouped_points(spark, d).filter("user_id = 7").drop("user_id"), "latest", ["event_type", "props"], 25)


@query("SELECT o_custkey AS c_custkey, count(*) AS n, any_value(c_name) AS c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def agg68_counts_by_user(spark, d):
    return ac.counts_by_user(table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, d, "customer"), "c_custkey", "c_name")


_ROUTES = "regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1), '/[0-9]+/', '/{id}/', 'g'), '/[0-9]+$', '/{id}')"


@query(f"SELECT page_id % 5 AS user, {_ROUTES} AS url, sum(n)::BIGINT AS n, round(sum(bytes), 6) AS bytes FROM (SELECT page_id, url, 1 AS n, length(html) / 10 AS bytes FROM pages) GROUP BY ALL")
def agg69_migrated(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 5).alias("user"), "url", F.lit(1).alias("n"), (F.length("html") / 10).alias("bytes"))
    return ac.migrated(rows, ["user"], "url", fn.route_template(F.col("url")), ["n", "bytes"])


@query("SELECT true AS n, true AS bytes")
def agg69_totals_match(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 5).alias("user"), "url", F.lit(1).alias("n"), (F.length("html") / 10).alias("bytes"))
    return ac.totals_match(rows, ac.migrated(rows, ["user"], "url", fn.route_template(F.col("url")), ["n", "bytes"]), ["n", "bytes"])


_RULES = {"all": "true", "click": "event_type = 'click'", "dear": "value > 150", "view": "event_type LIKE 'v%'"}


@query("WITH t AS (" + " UNION ALL ".join(f"SELECT user_id, '{n}' AS rule, count(*) AS total FROM events WHERE {t} GROUP BY user_id" for n, t in _RULES.items()) + """), u AS (SELECT DISTINCT c_custkey AS user_id FROM customer), r AS (SELECT DISTINCT unnest(['all', 'click', 'dear', 'view']) AS rule)
SELECT u.user_id, r.rule, coalesce(t.total, 0) AS total, (SELECT count(*) FROM t o WHERE o.rule = r.rule AND o.total > coalesce(t.total, 0)) + 1 AS rank, (SELECT min(total) FROM t o WHERE o.rule = r.rule AND o.total > coalesce(t.total, 0)) - coalesce(t.total, 0) AS gap,
  coalesce((SELECT max(total) FROM t o WHERE o.rule = r.rule), 0) AS first FROM u CROSS JOIN r LEFT JOIN t ON t.user_id = u.user_id AND t.rule = r.rule""")
def win9_leaderboard(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return ac.leaderboard(table(spark, d, "events").withColumn("one", F.lit(1)), users, "user_id", "one", {n: F.expr(t) for n, t in _RULES.items()})


@query("""WITH s AS (SELECT event_id, 'l' || user_id AS location, event_type AS region, CASE event_id % 3 WHEN 0 THEN 'tone' WHEN 1 THEN 'final' ELSE 'note' END AS feature FROM events), x AS (SELECT 'x' || c_custkey AS location, 'click' AS region FROM customer UNION ALL SELECT 'l5', 'far')
SELECT event_id FROM s WHERE feature IN ('tone', 'final') AND (location IN ('l1', 'l2') OR location IN (SELECT location FROM s WHERE region = 'far' UNION SELECT location FROM x WHERE region = 'far'))""")
def flt26_custom_data(spark, d):
    feature = F.when(F.col("event_id") % 3 == 0, "tone").when(F.col("event_id") % 3 == 1, "final").otherwise("note")
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("l"), "user_id").alias("location"), F.col("event_type").alias("region"), feature.alias("feature"))
    extra = table(spark, d, "customer").select(F.concat(F.lit("x"), "c_custkey").alias("location"), F.lit("click").alias("region")).unionByName(spark.sql("SELECT 'l5' AS location, 'far' AS region"))
    return ac.custom_data(rows, extra, ["l1", "l2"], ["far"], ["tone", "final"]).select("event_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'tion') OR contains(text, 'ment')")
def flt27_holds_variant(spark, d):
    return table(spark, d, "documents").filter(ac.holds_variant(F.col("text"), F.array(F.lit("tion"), F.lit("ment")))).select("doc_id")


@query("""WITH f AS (SELECT event_id, user_id, value FROM events WHERE props LIKE '%1%' AND event_type = 'click' AND value BETWEEN 5 AND 100) SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY value DESC, event_id LIMIT 20 OFFSET 10""")
def flt28_session_page(spark, d):
    rows = table(spark, d, "events")
    return ac.session_page(rows, ("props", "1"), {"event_type": "click"}, ("value", F.lit(5), F.lit(100)), "value", ["value", "ts"], "event_id", 20, 10).select("event_id", "user_id", "value", "total")


@query("""SELECT event_id FROM events WHERE contains(event_type, 'cl') OR contains(props, '77') OR (user_id = 3 AND event_id % 2 = 0) ORDER BY event_id LIMIT 100""")
def flt29_keyword_log(spark, d):
    from lexigrid.operators import selection as sel

    pair = (F.col("user_id") == 3) & (F.col("event_id") % 2 == 0)
    return sel.page(table(spark, d, "events").filter(sel.contains_text(["event_type", "props"], "cl") | F.contains("props", F.lit("77")) | pair), [F.col("event_id")], 100).select("event_id")


@query("""SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(c_mktsegment), 'urgent') OR contains(lower(c_name), '00077')""")
def join5_searched_join(spark, d):
    from lexigrid.operators import selection as sel

    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"), "left")
    return joined.filter(sel.contains_text(["o_orderpriority", "c_mktsegment"], "urgent") | sel.contains_text(["c_name"], "00077")).select("o_orderkey", "c_name")


@query("""SELECT * FROM (SELECT 'event' AS kind, event_id AS id, ts AS at FROM events WHERE user_id = 9 UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders WHERE o_custkey = 9) ORDER BY 3, 1, 2 LIMIT 60""")
def ord9_sorted_time_line(spark, d):
    lines = usage.time_line({"event": (table(spark, d, "events").filter("user_id = 9"), "event_id", "ts"), "order": (table(spark, d, "orders").filter("o_custkey = 9"), "o_orderkey", "o_orderdate")})
    return lines.orderBy("at", "kind", "id").limit(60)


@query(f"""WITH l AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'N')
SELECT o_orderkey, CASE WHEN o_orderdate <= {_OLD} THEN 'expired' WHEN l_orderkey IS NULL THEN 'token_inactive' END AS reason FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'""")
def str15_reconciled(spark, d):
    tokens = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return ac.reconciled(table(spark, d, "orders").filter("o_orderstatus <> 'F'"), tokens, "o_orderkey", "o_orderdate", F.expr(_OLD), F.col("l_returnflag") == "N").select("o_orderkey", "reason")


@query("""WITH c AS (SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_kinds, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY user_id)
SELECT *, concat_ws(',', CASE WHEN n_events > 70 THEN 'n_events' END, CASE WHEN n_days > 25 THEN 'n_days' END) AS flags FROM c WHERE n_events > 70 OR n_days > 25""")
def str15_suspicious(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_kinds"), F.countDistinct(F.to_date("ts")).alias("n_days"))
    return ac.suspicious(counts, {"n_events": 70, "n_days": 25})


@query(f"SELECT event_id FROM events WHERE NOT (ts < {_LAST} - INTERVAL 7 DAY)")
def str16_retained_logs(spark, d):
    return ac.retained(table(spark, d, "events"), "ts", _now(spark, d), 7).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AND o_orderstatus = 'F')")
def str16_retained_sessions(spark, d):
    rows = table(spark, d, "orders")
    return ac.retained(rows, "o_orderdate", F.lit(rows.agg(F.max("o_orderdate")).first()[0]), 365, F.col("o_orderstatus") == "F").select("o_orderkey")


@query("""WITH p AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN row_number() OVER (PARTITION BY CASE WHEN event_id % 5 > 0 THEN user_id END, epoch(ts)::BIGINT // 86400 ORDER BY ts, event_id) END AS s, row_number() OVER (PARTITION BY event_type, epoch(ts)::BIGINT // 86400 ORDER BY ts, event_id) AS t FROM events)
SELECT event_id, CASE WHEN s > 2 THEN 'session' WHEN t > 50 THEN 'event_type' END AS limited FROM p""")
def str12_within_limits(spark, d):
    rows = table(spark, d, "events").withColumn("session", F.when(F.col("event_id") % 5 > 0, F.col("user_id")))
    return ac.within_limits(rows, ["event_id"], 86400, "ts", {"session": 2, "event_type": 50}).select("event_id", "limited")


@query("SELECT user_id, round(sum(value), 6) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def str7_merged_activity(spark, d):
    rows = table(spark, d, "events").select("user_id", "value", "ts", "event_id")
    old = rows.filter("event_id % 2 = 0").drop("event_id").groupBy("user_id").agg(F.sum("value").alias("value"), F.max("ts").alias("ts"))
    return ac.merged_activity(old, rows.filter("event_id % 2 = 1").drop("event_id"), "user_id", "value", "ts")
