"""Queries of the comparison and usage operators over the driver tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.operators import comparison as cmp
from lexigrid.operators import usage
from lexigrid.plans.queries import _READINGS, _readings, query
from lexigrid.sources.tables import table


@query("""WITH u AS (SELECT user_id, count(*) AS calls, datediff('day', max(CAST(ts AS DATE)), (SELECT max(CAST(ts AS DATE)) FROM events)) AS idle_days FROM events GROUP BY user_id)
SELECT *, CASE WHEN calls >= 12 AND idle_days <= 5 THEN 'core' WHEN calls >= 5 AND idle_days <= 15 THEN 'active' ELSE 'quiet' END AS segment FROM u""")
def agg35_segments(spark, d):
    return usage.segments(table(spark, d, "events"), "user_id", "ts", [("core", 12, 5), ("active", 5, 15)], "quiet")


@query("""WITH f AS (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id) AS first FROM events)
SELECT user_id, count(*) AS calls FROM f WHERE ts < first + INTERVAL 7 DAY GROUP BY user_id HAVING count(*) >= 3""")
def agg39_eager_newcomers(spark, d):
    return usage.eager_newcomers(table(spark, d, "events"), "user_id", "ts", 7, 3)


@query("""WITH u AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS user_place FROM events GROUP BY user_id),
 p AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS path_place FROM events GROUP BY event_type)
SELECT user_place, path_place, count(*) AS n FROM events JOIN u USING (user_id) JOIN p USING (event_type) WHERE user_place < 10 AND path_place < 3 GROUP BY ALL""")
def agg46_top_cells(spark, d):
    return usage.top_cells(table(spark, d, "events"), "user_id", "event_type", 10, 3)


@query("""SELECT 'all' AS level, NULL::VARCHAR AS name, count(*) AS n, round(sum(value), 4) AS total FROM events
UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*), round(sum(value), 4) FROM events GROUP BY user_id
UNION ALL SELECT 'event_type', event_type, count(*), round(sum(value), 4) FROM events GROUP BY event_type""")
def agg49_grouping_totals(spark, d):
    return usage.grouping_totals(table(spark, d, "events"), ["user_id", "event_type"], "value")


@query("""SELECT o_custkey, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 6) AS percent FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20""")
def agg53_top_values(spark, d):
    return usage.top_values(table(spark, d, "orders"), "o_custkey", 20)


@query("""WITH c AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY event_type)
SELECT event_type, n, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM c), 6) AS percent_of_all, CASE WHEN k <= 2 THEN round(n * 100.0::DOUBLE / (SELECT sum(n) FROM c WHERE k <= 2), 6) END AS percent_of_top FROM c""")
def agg57_shares_with_top(spark, d):
    return usage.shares_with_top(table(spark, d, "events"), "event_type", 2)


@query("""SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_distinct, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_totalprice > 200000) AS n_large FROM orders""")
def agg60_conditional_counts(spark, d):
    return usage.conditional_counts(table(spark, d, "orders"), {"n_done": F.col("o_orderstatus") == "F", "n_large": F.col("o_totalprice") > 200000}, "o_custkey")


@query(" UNION ALL ".join(f"SELECT '{u}' AS unit, CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS bucket, count(DISTINCT user_id) AS users FROM events GROUP BY 2" for u in ("day", "week", "month")))
def agg62_actives(spark, d):
    return usage.actives(table(spark, d, "events"), "user_id", "ts")


@query("""SELECT event_type, user_id, total, rank() OVER (PARTITION BY event_type ORDER BY total DESC) AS rank FROM (SELECT event_type, user_id, round(sum(value), 6) AS total FROM events GROUP BY ALL) WHERE total > 0""")
def win6_rank_within(spark, d):
    return usage.rank_within(table(spark, d, "events"), "event_type", "user_id", "value")


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn NULLS FIRST, text NULLS FIRST) AS k FROM conversations) WHERE k = 1""")
def win15_first_seen(spark, d):
    return usage.first_seen(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "role"], ["turn", "text"])


@query("""WITH m AS (SELECT event_id, user_id, ts, event_type = 'view' AS removable, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id, removable ORDER BY ts, event_id) AS k FROM m) SELECT event_id, user_id FROM k WHERE NOT (removable AND k <= n - 5)""")
def win16_kept_newest(spark, d):
    return usage.kept_newest(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], 5, F.col("event_type") == "view").select("event_id", "user_id")


@query("""SELECT user_id, event_id, list_sort([coalesce(lag(value, 2) OVER w, 0), coalesce(lag(value) OVER w, 0), coalesce(value, 0), coalesce(lead(value) OVER w, 0), coalesce(lead(value, 2) OVER w, 0)])[3] AS median
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def win18_median_filter(spark, d):
    return usage.median_filter(table(spark, d, "events"), "user_id", "event_id", "value")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE (k - 1) % 3 = 0""")
def ord11_every_nth(spark, d):
    return usage.every_nth(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 3)


@query("""SELECT c_custkey, (SELECT count(*) > 100 FROM customer) AS truncated FROM customer ORDER BY c_custkey LIMIT 100""")
def ord8_capped(spark, d):
    return usage.capped(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 100)


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT event_type, NULL, count(*) FROM events GROUP BY event_type""")
def str5_day_and_all_time(spark, d):
    return usage.day_and_all_time(table(spark, d, "events"), "event_type", "ts")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS attempts FROM events""")
def str11_recent_attempts(spark, d):
    return usage.recent_attempts(table(spark, d, "events"), "user_id", "ts", 86400).select("event_id", "user_id", "attempts")


@query("""WITH b AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) FILTER (before <> event_type) AS n_changes, count(DISTINCT event_type) AS n_values FROM b GROUP BY user_id""")
def str14_changes(spark, d):
    return usage.changes(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT source, doc_id, running FROM (SELECT source, doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM documents) WHERE running <= 100000""")
def str19_within_capacity(spark, d):
    return usage.within_capacity(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("doc_id")], "n_chars", 100000).drop("n_chars")


@query("""SELECT 'event' AS kind, event_id AS id, ts AS at FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders""")
def set3_time_line(spark, d):
    return usage.time_line({"event": (table(spark, d, "events"), "event_id", "ts"), "order": (table(spark, d, "orders"), "o_orderkey", "o_orderdate")})


@query("""WITH s AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS k FROM events WHERE value IS NOT NULL)
SELECT user_id, round(arg_min(v, event_id), 6) AS first, round(arg_max(v, event_id), 6) AS last, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, round(max(v) - min(v), 6) AS range, round(regr_slope(v, k), 6) AS slope FROM s GROUP BY user_id""")
def adv42_contours(spark, d):
    return usage.contours(table(spark, d, "events"), "user_id", "event_id", "value")


@query(r"""WITH b AS (SELECT lang, string_split(regexp_replace(coalesce(text, ''), '\s', '', 'g'), '') AS c FROM documents),
 g AS (SELECT lang, c[i] || c[i + 1] AS ngram, count(*) AS n FROM (SELECT lang, c, unnest(range(1, len(c))) AS i FROM b) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, ngram) AS rank, sum(n) OVER (PARTITION BY lang) AS n_all FROM g)
SELECT lang, ngram, n, round(n * 100.0::DOUBLE / n_all, 6) AS percent, rank FROM r WHERE rank <= 20""")
def win2_ngram_shares(spark, d):
    return cmp.ngram_shares(table(spark, d, "documents"), "lang", "text", 2, 20)


@query("""WITH c AS (SELECT source, count(*) FILTER (lang = 'en') AS n_in, count(*) - count(*) FILTER (lang = 'en') AS n_out FROM documents GROUP BY source),
 s AS (SELECT source, n_in, n_out, n_in / (SELECT sum(n_in) FROM c) AS p, n_out / (SELECT sum(n_out) FROM c) AS q FROM c)
SELECT source, n_in, n_out, round(p, 6) AS share_in, round(q, 6) AS share_out, round(p - q, 6) AS difference FROM s""")
def agg32_two_groups(spark, d):
    return cmp.two_groups(table(spark, d, "documents"), F.col("lang") == "en", "source")


@query("""WITH c AS (SELECT source, (count(*) FILTER (lang = 'en'))::DOUBLE AS a, count(*)::DOUBLE AS r FROM documents GROUP BY source),
 t AS (SELECT source, a, r - a AS b, (SELECT sum(a) FROM c) AS ta, (SELECT sum(r - a) FROM c) AS tb FROM c),
 g AS (SELECT *, abs(a * (tb - b) - b * (ta - a)) AS gap, ta + tb AS n FROM t),
 x AS (SELECT source, n * pow(gap - least(n / 2, gap), 2) / ((a + b) * (n - a - b) * ta * tb) AS chi FROM g)
SELECT source, round(chi, 6) AS chi_square, chi > 3.841459 AS significant FROM x""")
def adv21_chi_square_yates(spark, d):
    return cmp.chi_square_yates(table(spark, d, "documents"), F.col("lang") == "en", "source")


@query(f"""WITH x AS (SELECT event_type, k % 10 AS token, user_id % 2 AS side FROM {_READINGS}),
 a AS (SELECT event_type, token, count(*) AS n FROM x WHERE side = 0 GROUP BY ALL), b AS (SELECT event_type, token, count(*) AS n FROM x WHERE side = 1 GROUP BY ALL)
SELECT event_type, token, coalesce(a.n, 0) AS first, coalesce(b.n, 0) AS second, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference FROM a FULL JOIN b USING (event_type, token)""")
def join19_aligned_groups(spark, d):
    counts = _readings(spark, d).groupBy("event_type", (F.col("k") % 10).alias("token"), (F.col("user_id") % 2).alias("side")).agg(F.count("*").alias("n"))
    return cmp.aligned_groups(counts.filter("side = 0"), counts.filter("side = 1"), ["event_type", "token"], "n")


@query(f"""WITH p AS (SELECT DISTINCT event_type, k FROM {_READINGS} WHERE event_type IS NOT NULL AND k IS NOT NULL), s AS (SELECT k, count(*) AS n, min(event_type) AS e FROM p GROUP BY k),
 m AS (SELECT k, e, CASE WHEN n = (SELECT count(DISTINCT event_type) FROM p) THEN 'common' WHEN n = 1 THEN 'own' END AS kind FROM s)
SELECT k, kind, CASE WHEN kind = 'own' THEN e END AS event_type FROM m WHERE kind IS NOT NULL""")
def set5_common_and_own(spark, d):
    return cmp.common_and_own(_readings(spark, d), "event_type", "k")


_LIST = lambda v, t, k: f"(SELECT {k} AS key, CASE WHEN count(DISTINCT {v}) = 1 THEN min({v}) ELSE string_agg({v}, ';' ORDER BY {v}) END AS v FROM {t} GROUP BY {k})"


@query(f"""SELECT n_nationkey AS key, n_name, a.v AS value_1, b.v AS value_2 FROM nation LEFT JOIN {_LIST("c_mktsegment", "customer", "c_nationkey")} a ON n_nationkey = a.key
LEFT JOIN {_LIST("s_name", "supplier", "s_nationkey")} b ON n_nationkey = b.key""")
def join21_merged_lists(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("v"))
    suppliers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("v"))
    return cmp.merged_lists(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name"), [customers, suppliers], "key", "v")


@query("""SELECT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high, count(*) AS n FROM lineitem GROUP BY ALL""")
def join16_undirected(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return cmp.undirected(edges, "a", "b")


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS t FROM lineitem WHERE l_partkey IS NOT NULL), c AS (SELECT t, count(*) AS n FROM p GROUP BY t),
 b AS (SELECT x.t AS a, y.t AS b, count(*) AS n_both FROM p x JOIN p y ON x.o = y.o AND x.t < y.t GROUP BY ALL HAVING count(*) >= 2),
 s AS (SELECT b.a, b.b, n_both, round(ln(n_both::DOUBLE * (SELECT count(DISTINCT o) FROM p) / (ca.n::DOUBLE * cb.n)), 6) AS pmi FROM b JOIN c ca ON ca.t = b.a JOIN c cb ON cb.t = b.b)
SELECT * FROM s WHERE pmi > 0""")
def adv6_positive_pmi(spark, d):
    return cmp.positive_pmi(table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("token")), "l_orderkey", "token", 2)


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, greatest(floor(count(*) OVER (PARTITION BY source) * 0.1::DOUBLE), 1) AS most FROM documents) WHERE k <= most""")
def adv18_stratified_sample(spark, d):
    return cmp.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.1)


@query(f"""WITH o AS (SELECT event_type, user_id, min((k % 3)::VARCHAR) AS t FROM {_READINGS} GROUP BY ALL),
 c AS (SELECT p.event_type AS a, q.event_type AS b, p.t AS x, q.t AS y, count(*) AS n FROM o p JOIN o q ON p.user_id = q.user_id AND p.event_type < q.event_type GROUP BY ALL),
 s AS (SELECT a, b, sum(n * (n - 1) / 2) AS m FROM c GROUP BY a, b), sx AS (SELECT a, b, sum(n * (n - 1) / 2) AS m FROM (SELECT a, b, x, sum(n) AS n FROM c GROUP BY ALL) GROUP BY a, b),
 sy AS (SELECT a, b, sum(n * (n - 1) / 2) AS m FROM (SELECT a, b, y, sum(n) AS n FROM c GROUP BY ALL) GROUP BY a, b)
SELECT a, b, round(coalesce(1 - s.m / nullif(sx.m + sy.m - s.m, 0), 0), 6) AS distance FROM s JOIN sx USING (a, b) JOIN sy USING (a, b)""")
def adv26_same_pair_distance(spark, d):
    return cmp.same_pair_distance(_readings(spark, d).withColumn("t", F.col("k") % 3), "event_type", "user_id", "t")


@query(f"""WITH p AS (SELECT DISTINCT event_type AS r, k FROM {_READINGS} WHERE k IS NOT NULL), z AS (SELECT r, count(*) AS n FROM p GROUP BY r),
 b AS (SELECT x.r AS a, y.r AS b, count(*) AS n_both FROM p x JOIN p y ON x.k = y.k AND x.r < y.r GROUP BY ALL)
SELECT b.a, b.b, n_both, round(n_both / (p.n + q.n - n_both), 6) AS jaccard FROM b JOIN z p ON p.r = b.a JOIN z q ON q.r = b.b""")
def adv14_region_jaccard(spark, d):
    return cmp.region_jaccard(_readings(spark, d), "event_type", "k")


@query("""WITH v AS (SELECT label, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), l AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM v),
 c AS (SELECT label, i, count(*) AS n, avg(x) AS m, var_pop(x) AS s FROM l GROUP BY ALL), o AS (SELECT i, sum(n * m) / sum(n) AS centre FROM c GROUP BY i),
 t AS (SELECT sum(n * pow(m - centre, 2)) AS between_, sum(n * s) AS within_ FROM c JOIN o USING (i)), z AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM v)
SELECT n, k, round((between_ / (k - 1)) / (within_ / (n - k)), 4) AS calinski_harabasz FROM t, z""")
def adv34_cluster_spread(spark, d):
    return cmp.cluster_spread(table(spark, d, "embeddings").filter("label IS NOT NULL AND embedding IS NOT NULL"), "label", "vec_id", "embedding")


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
 m AS (SELECT p.vec_id AS point_id, q.vec_id AS place_id, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS distance FROM v p JOIN v q ON p.vec_id % 2 = 0 AND q.vec_id % 2 = 1)
SELECT point_id, place_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, place_id) AS k FROM m WHERE distance <= 0.05) WHERE k = 1""")
def adv36_nearest_in_grid(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    points, places = v.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "point_id"), v.filter("vec_id % 2 = 1").toDF("place_id", "px", "py")
    return cmp.nearest_in_grid(points, places, 0.05)


_EDGES = "(SELECT a, b, max(w) AS w FROM (SELECT 'o' || l_orderkey AS a, 'p' || l_partkey AS b, l_quantity AS w FROM lineitem UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey, l_quantity FROM lineitem) GROUP BY a, b)"


def _edges(spark, d):
    """Orders and parts as nodes, by prefix; weights are quantities."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), F.col("l_quantity").alias("weight"))


@query(f"""WITH e AS {_EDGES}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM e) WHERE r <= 5),
 d0 AS (SELECT 'p1' AS node), d1 AS (SELECT b AS node, max(w) AS w FROM k JOIN d0 ON a = node WHERE b <> 'p1' GROUP BY b),
 d2 AS (SELECT b AS node, max(k.w) AS w FROM k JOIN d1 ON a = node WHERE b <> 'p1' AND b NOT IN (SELECT node FROM d1) GROUP BY b),
 d3 AS (SELECT b AS node, max(k.w) AS w FROM k JOIN d2 ON a = node WHERE b <> 'p1' AND b NOT IN (SELECT node FROM d1 UNION SELECT node FROM d2) GROUP BY b)
SELECT * FROM (SELECT node, 0 AS depth, NULL::DOUBLE AS weight FROM d0 UNION ALL SELECT node, 1, w FROM d1 UNION ALL SELECT node, 2, w FROM d2 UNION ALL SELECT node, 3, w FROM d3) ORDER BY depth, weight DESC NULLS LAST, node LIMIT 60""")
def adv5_reachable(spark, d):
    return cmp.neighbour_network(_edges(spark, d), spark.sql("SELECT 'p1' AS node"), 3, 5, 60)


@query("""WITH v AS (SELECT label, vec_id, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), l AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM v),
 c AS (SELECT label, i, avg(x) AS m FROM l GROUP BY ALL), s AS (SELECT label, avg(d) AS s FROM (SELECT l.label, vec_id, sqrt(sum(pow(x - m, 2))) AS d FROM l JOIN c ON l.label = c.label AND l.i = c.i GROUP BY ALL) GROUP BY label),
 g AS (SELECT p.label AS a, q.label AS b, sqrt(sum(pow(p.m - q.m, 2))) AS d FROM c p JOIN c q ON p.i = q.i AND p.label <> q.label GROUP BY ALL)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a, max((x.s + y.s) / d) AS r FROM g JOIN s x ON a = x.label JOIN s y ON b = y.label GROUP BY a)""")
def adv34_davies_bouldin(spark, d):
    return cmp.davies_bouldin(table(spark, d, "embeddings").filter("label IS NOT NULL AND embedding IS NOT NULL"), "label", "vec_id", "embedding")


@query("""WITH v AS (SELECT label, vec_id, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 l AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM v), s AS (SELECT label, i, sum(x) AS t FROM l GROUP BY ALL),
 z AS (SELECT label, count(DISTINCT vec_id) AS n, sum(x * x) AS q FROM l GROUP BY label), r AS (SELECT vec_id, label, sum(x * x) AS q FROM l GROUP BY ALL),
 m AS (SELECT l.vec_id, l.label AS mine, s.label AS other, sum(l.x * s.t) AS dot FROM l JOIN s ON l.i = s.i GROUP BY ALL),
 t AS (SELECT m.vec_id, mine = other AS own, z.n, z.n * r.q - 2 * dot + z.q AS total FROM m JOIN z ON m.other = z.label JOIN r ON r.vec_id = m.vec_id),
 e AS (SELECT vec_id, max(CASE WHEN own THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN NOT own THEN total / n END) AS b FROM t GROUP BY vec_id)
SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM e""")
def adv34_silhouette(spark, d):
    return cmp.silhouette(table(spark, d, "embeddings").filter("label IS NOT NULL AND embedding IS NOT NULL"), "label", "vec_id", "embedding")


@query("""SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 200""")
def adv18_random_sample(spark, d):
    return cmp.random_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 200)


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v),
 c AS (SELECT vec_id, least(floor((x - x0) / (x1 - x0) * 50), 49) AS cx, least(floor((y - y0) / (y1 - y0) * 50), 49) AS cy FROM v, b) SELECT min(vec_id) AS vec_id FROM c GROUP BY cx, cy""")
def adv18_grid_sample(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return cmp.grid_sample(v, "x", "y", "vec_id").select("vec_id")
