"""Queries of region profiles: parts as villages with brand as city and type as county, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import aggregation as agg
from lexigrid.operators import profiles as pf
from lexigrid.plans.queries import query
from lexigrid.sources.tables import table

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("suffix", F.right("p_name", F.lit(2)))


_FLAGS = {"small": "p_size <= 10", "dear": "p_retailprice > 1000", "red": "contains(p_name, 'red')"}


@query(f"""WITH x AS (SELECT n_name, c_mktsegment AS category, count(*)::DOUBLE / any_value(t) AS intensity FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT c_nationkey AS k, count(*) AS t FROM customer GROUP BY 1) ON k = c_nationkey GROUP BY n_name, c_mktsegment),
 b AS (SELECT n_name, count(DISTINCT c_name) AS n_names, round(avg(length(c_name)), 6) AS mean_length FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT b.*, {", ".join(f"round(coalesce((SELECT intensity FROM x WHERE x.n_name = b.n_name AND category = '{c}'), 0) * 100, 6) AS {c}_pct, floor(round(coalesce((SELECT intensity FROM x WHERE x.n_name = b.n_name AND category = '{c}'), 0) * 100, 6) / 100 * n_names)::BIGINT AS {c}_count" for c in _SEGMENTS)} FROM b""")
def agg19_region_aggregates(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    sizes = rows.groupBy("n_name").agg(F.count("*").alias("t"))
    cells = rows.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n")).join(sizes, "n_name").select(F.col("n_name").alias("region"), F.col("c_mktsegment").alias("category"), (F.col("n") / F.col("t")).alias("intensity"))
    return pf.region_aggregates(rows, "n_name", "c_name", cells, _SEGMENTS)


@query(f"""WITH c AS ({" UNION ALL ".join(f"SELECT p_brand, '{k}' AS flag, count(*) AS n_rows, count(*) FILTER ({t}) AS n FROM part GROUP BY p_brand" for k, t in _FLAGS.items())}),
 p AS (SELECT *, round(n * 100.0::DOUBLE / n_rows, 2) AS percent FROM c), g AS (SELECT flag, round(sum(n) * 100.0::DOUBLE / sum(n_rows), 2) AS gp, avg(percent) AS mu, stddev_samp(percent) AS sd FROM p GROUP BY flag)
SELECT p_brand, flag, n, percent, gp AS global_percent, round(percent / nullif(gp, 0), 3) AS lift, coalesce(round((percent - mu) / nullif(sd, 0), 4), 0) AS z FROM p JOIN g USING (flag)""")
def agg21_flag_profile(spark, d):
    return pf.flag_profile(_parts(spark, d), "p_brand", {k: F.expr(t) for k, t in _FLAGS.items()})


@query("""WITH u AS (SELECT p_brand, p_name[-2:] AS suffix, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT p_brand, sum(n) AS nr FROM u GROUP BY p_brand), s AS (SELECT suffix, sum(n) AS ns FROM u GROUP BY suffix),
 c AS (SELECT u.*, round(n * 100.0::DOUBLE / nr, 2) AS percent, round(round(n * 100.0::DOUBLE / nr, 2) / round(ns * 100.0::DOUBLE / (SELECT sum(n) FROM u), 2), 3) AS lift FROM u JOIN r USING (p_brand) JOIN s USING (suffix)),
 k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, suffix) AS by_count, row_number() OVER (PARTITION BY p_brand ORDER BY lift DESC, suffix) AS by_lift FROM c) SELECT * FROM k WHERE by_count <= 3 OR by_lift <= 3""")
def agg21_suffix_profile(spark, d):
    return pf.suffix_profile(_parts(spark, d), "p_brand", "suffix", 3)


@query("""WITH u AS (SELECT p_brand, p_name[-2:] AS suffix, count(*) AS n FROM part GROUP BY ALL), p AS (SELECT p_brand, greatest(n / sum(n) OVER (PARTITION BY p_brand), 0.001) AS p FROM u)
SELECT p_brand, round(sum(-p * ln(p)), 4) AS suffix_entropy, count(*) AS n_suffixes FROM p GROUP BY p_brand""")
def agg21_diversity(spark, d):
    return pf.diversity(_parts(spark, d), "p_brand", "suffix")


_LINES = "(SELECT l_returnflag AS level, s_nationkey AS region, l_discount AS p, (s_nationkey * 10 + 5) AS before FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"""WITH b AS (SELECT level, sum(before) AS before FROM (SELECT DISTINCT level, region, before FROM {_LINES}) GROUP BY level)
SELECT level, count(*) AS n, count(*) FILTER (p < 0.05) AS significant, any_value(b.before)::BIGINT AS before, round(count(*) FILTER (p < 0.05) * 100.0::DOUBLE / any_value(b.before), 1) AS rate FROM {_LINES} l JOIN b USING (level) GROUP BY level""")
def agg25_level_significance(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey")).select(F.col("l_returnflag").alias("level"), F.col("s_nationkey").alias("region"), F.col("l_discount").alias("p"), (F.col("s_nationkey") * 10 + 5).alias("before"))
    return pf.level_significance(rows, "level", "region", "p", "before")


@query(f"""SELECT level, count(*) AS n, mean_before FROM {_LINES} l JOIN (SELECT level, round(avg(before), 6) AS mean_before FROM {_LINES} GROUP BY level) USING (level) GROUP BY level, mean_before""")
def join13_back_to_base(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey")).select(F.col("l_returnflag").alias("level"), (F.col("s_nationkey") * 10 + 5).alias("before"))
    means = rows.groupBy("level").agg(F.round(F.avg("before"), 6).alias("mean_before"))
    return rows.groupBy("level").agg(F.count("*").alias("n")).join(means, "level")


@query("""SELECT 'all' AS kind, NULL AS name, count(*) AS n, round(avg(l_tax), 6) AS mean, count(*) FILTER (l_quantity > 40) AS flagged FROM lineitem UNION ALL
SELECT 'token', l_linenumber::VARCHAR, count(*), round(avg(l_tax), 6), count(*) FILTER (l_quantity > 40) FROM lineitem GROUP BY l_linenumber UNION ALL SELECT 'cluster', l_returnflag, count(*), round(avg(l_tax), 6), count(*) FILTER (l_quantity > 40) FROM lineitem GROUP BY l_returnflag""")
def agg26_integration_summary(spark, d):
    return pf.integration_summary(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag", "l_tax", F.col("l_quantity") > 40)


@query("""SELECT l_suppkey, count(DISTINCT l_linenumber) AS n_tokens, max(l_tax) AS most, round(avg(l_tax), 6) AS mean, count(*) FILTER (l_quantity > 40) AS flagged FROM lineitem GROUP BY l_suppkey HAVING flagged >= 100""")
def agg27_cluster_list(spark, d):
    return pf.cluster_list(table(spark, d, "lineitem"), "l_suppkey", "l_linenumber", "l_tax", F.col("l_quantity") > 40, 100)


@query("SELECT toxic, count(*) AS n, round(avg(quality), 6) AS mean FROM labels GROUP BY toxic")
def agg29_category_means(spark, d):
    return pf.category_means(table(spark, d, "labels"), "toxic", "quality")


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount < 0.05) AS at_5, count(*) FILTER (l_discount < 0.01) AS at_1, count(*) FILTER (l_discount < 0.001) AS at_01, round(avg(l_tax), 6) AS mean_effect, max(l_tax) AS most_effect FROM lineitem GROUP BY l_returnflag""")
def agg30_significance_summary(spark, d):
    return pf.significance_summary(table(spark, d, "lineitem"), "l_returnflag", "l_discount", "l_tax")


def _sides(spark, d):
    parts = _parts(spark, d)
    return parts.filter("p_size <= 25"), parts.filter("p_size > 25")


def _counted(test: str, name: str) -> str:
    return f"""(SELECT kind, value, round(n / (SELECT count(*) FROM part WHERE {test}), 6) AS {name} FROM (SELECT 'length' AS kind, length(p_name)::VARCHAR AS value, count(*) AS n FROM part WHERE {test} GROUP BY ALL
 UNION ALL (SELECT 'ending', p_name[-2:], count(*) AS n FROM part WHERE {test} GROUP BY ALL ORDER BY n DESC, p_name[-2:] LIMIT 5)))"""


@query(f"""SELECT kind, value, coalesce(first, 0.0) AS first, coalesce(second, 0.0) AS second FROM {_counted("p_size <= 25", "first")} FULL JOIN {_counted("p_size > 25", "second")} USING (kind, value)""")
def agg33_compared_counts(spark, d):
    return pf.compared_counts(*_sides(spark, d), "p_name", 2, 5)


_CHARS = lambda test, p: f"(SELECT char, n / sum(n) OVER () AS {p} FROM (SELECT char, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS char FROM part WHERE {test}) WHERE char NOT IN ('', ' ') GROUP BY char))"


@query(f"""WITH a AS {_CHARS("p_size <= 25", "p")}, b AS {_CHARS("p_size > 25", "q")}, t AS ((SELECT char FROM a ORDER BY p DESC, char LIMIT 8) UNION (SELECT char FROM b ORDER BY q DESC, char LIMIT 8))
SELECT char, round(coalesce(p, 0), 6) AS first, round(coalesce(q, 0), 6) AS second, round(coalesce(p, 0) - coalesce(q, 0), 6) AS difference, round(coalesce(p, 0) / nullif(coalesce(q, 0), 0), 6) AS lift FROM t LEFT JOIN a USING (char) LEFT JOIN b USING (char)""")
def ord6_compared_characters(spark, d):
    return pf.compared_characters(*_sides(spark, d), "p_name", 8)


_LIFTS = """WITH c AS (SELECT p_brand, char, count(*) AS n FROM (SELECT p_brand, unnest(list_distinct(string_split(p_name, ''))) AS char FROM part) WHERE char NOT IN ('', ' ') GROUP BY ALL), s AS (SELECT p_brand, count(*) AS nr FROM part GROUP BY p_brand),
 e AS (SELECT char, sum(n) AS nc FROM c GROUP BY char), l AS (SELECT p_brand, char, n, round((n / nr) / (nc / (SELECT count(*) FROM part)), 6) AS lift FROM c JOIN s USING (p_brand) JOIN e USING (char)) """


def _lifts(spark, d):
    return pf.character_lifts(_parts(spark, d), "p_brand", "p_name")


@query(_LIFTS + "SELECT p_brand, char, lift, row_number() OVER (PARTITION BY p_brand ORDER BY lift DESC, char) AS rank FROM l QUALIFY rank <= 4")
def win3_top_features(spark, d):
    return pf.top_features(_lifts(spark, d), "p_brand", "char", "lift", 4)


@query(_LIFTS + """, t AS (SELECT p_brand, char, lift FROM l QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY lift DESC, char) <= 4)
SELECT p_brand, coalesce(max(lift) FILTER (char = 'b'), 0) AS b, coalesce(max(lift) FILTER (char = 'z'), 0) AS z FROM t GROUP BY p_brand""")
def win3_feature_matrix(spark, d):
    return pf.feature_matrix(pf.top_features(_lifts(spark, d), "p_brand", "char", "lift", 4), "p_brand", "char", "lift", ["b", "z"])


@query(_LIFTS + "SELECT p_brand, char, lift, row_number() OVER (ORDER BY lift DESC, p_brand, char) AS rank FROM l ORDER BY rank LIMIT 50")
def win4_globally_ranked(spark, d):
    return pf.globally_ranked(_lifts(spark, d), ["p_brand", "char"], "lift", 50)


@query(_LIFTS + "SELECT p_brand, char, lift FROM l WHERE n >= 10 AND p_brand LIKE 'Brand#1%' AND lift >= 1.0 ORDER BY lift DESC, p_brand, char LIMIT 20")
def ord4_thresholded(spark, d):
    return pf.thresholded(_lifts(spark, d), [F.col("n") >= 10, F.col("p_brand").like("Brand#1%")], ["p_brand", "char"], "lift", 1.0, 20)


@query(_LIFTS + "SELECT p_brand, lift, char, n FROM l QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY lift DESC, char, n) = 1")
def ord5_best_of(spark, d):
    return pf.best_of(_lifts(spark, d), "p_brand", "lift")


@query("""SELECT p_type, p_name, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'SMALL') GROUP BY ALL HAVING n >= 3 ORDER BY n DESC, p_type, p_name LIMIT 15""")
def flt35_listed(spark, d):
    counts = _parts(spark, d).groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    return pf.thresholded(counts, [F.col("p_type").isin("ECONOMY", "SMALL")], ["p_type", "p_name"], "n", 3, 15)


@query("""SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size <= 40 AND p_retailprice > 900 AND contains(p_name, 'r') ORDER BY md5(p_partkey::VARCHAR), p_partkey LIMIT 30""")
def flt12_village_subset(spark, d):
    rows = pf.village_subset(_parts(spark, d), "p_partkey", None, {"p_brand": ["Brand#1", "Brand#2", "Brand#3"]}, [F.col("p_size") <= 40, F.col("p_retailprice") > 900], ("p_name", "r"), 30)
    return rows.select("p_partkey")


@query("""SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE contains(lower(p_name), 'ring')) AS total FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey LIMIT 10 OFFSET 20""")
def flt15_keyword_page(spark, d):
    from lexigrid.operators import places as pl
    from lexigrid.operators import selection as sel

    found = _parts(spark, d).filter(sel.contains_text(["p_name"], "RING")).select("p_partkey", "p_name")
    return pl.numbered_pages(found, ["p_partkey"], 10, 20)


@query("""SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def flt16_detail(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = pf.detail(orders, "c_custkey", {"customer": table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")})
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    return rows.join(nations, F.col("customer.c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", F.col("customer.c_name").alias("c_name"), "n_name")


@query("""SELECT l_orderkey, l_linenumber, o_orderstatus, c_mktsegment, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def join11_chain(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.expr("l_orderkey = o_orderkey"), "left")
    named = lines.join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.expr("o_custkey = c_custkey"), "left").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.expr("c_nationkey = n_nationkey"), "left")
    return named.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_mktsegment", "n_name")


@query("SELECT documents.doc_id AS doc_id FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE toxic = 1")
def join10_optional(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return pf.with_optional(table(spark, d, "documents").select("doc_id"), "doc_id", {"labels": (labels, F.col("toxic") == 1), "vectors": (table(spark, d, "embeddings"), None)}).select("doc_id")


@query("SELECT source, count(*) AS n, sum(toxic)::BIGINT AS toxic, round(sum(quality) * 100.0::DOUBLE / count(*), 2) AS good FROM documents JOIN labels USING (doc_id) GROUP BY source")
def join12_structure_by_region(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.round(F.sum("quality") * 100.0 / F.count("*"), 2).alias("good"))


@query(_LIFTS + """SELECT l.p_brand, char, lift, round(size, 6) AS mean_size FROM l LEFT JOIN (SELECT p_brand, avg(p_size) AS size FROM part WHERE p_size > 3 GROUP BY p_brand) c ON l.p_brand = c.p_brand""")
def join9_with_centroids(spark, d):
    centres = _parts(spark, d).filter("p_size > 3").groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("mean_size"))
    return _lifts(spark, d).join(centres, "p_brand", "left").select("p_brand", "char", "lift", "mean_size")


_VECTOR = "(SELECT c_nationkey, [" + ", ".join(f"coalesce(sum(c_acctbal) FILTER (c_mktsegment = '{c}'), 0.0)" for c in _SEGMENTS) + "] AS v FROM customer GROUP BY c_nationkey)"


def _vectors(spark, d):
    return pf.vector_by_category(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", _SEGMENTS)


@query("SELECT c_nationkey, " + ", ".join(f"round(v[{k + 1}], 2) AS v{k}" for k in range(5)) + f" FROM {_VECTOR}")
def adv9_region_vectors(spark, d):
    return _vectors(spark, d).select("c_nationkey", *(F.round(F.get("vector", F.lit(k)), 2).alias(f"v{k}") for k in range(5)))


@query(f"""SELECT a.c_nationkey AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 4) AS euclid, round(list_sum(list_transform(range(1, 6), lambda i: abs(a.v[i] - b.v[i]))), 4) AS manhattan, round(a.v[1] - b.v[1], 4) AS first
FROM {_VECTOR} a, {_VECTOR} b WHERE b.c_nationkey = 3""")
def adv10_compared_vectors(spark, d):
    one = _vectors(spark, d).filter("c_nationkey = 3").select(F.col("vector").alias("b"))
    c = pf.compared_vectors(F.col("vector"), F.col("b"))
    return _vectors(spark, d).crossJoin(F.broadcast(one)).select(F.col("c_nationkey").alias("other"), c["cosine"].alias("cosine"), F.round(c["euclid"], 4).alias("euclid"), F.round(c["manhattan"], 4).alias("manhattan"), F.round(F.get(c["difference"], F.lit(0)), 4).alias("first"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT q.vec_id AS wanted, v.vec_id AS vec_id, round(list_cosine_similarity(v.v, q.v), 6) AS cosine FROM v, v q WHERE q.vec_id IN (1, 2, 3) AND v.vec_id <> q.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY cosine DESC, vec_id) AS rank FROM m WHERE cosine >= 0.1) WHERE rank <= 5""")
def adv8_similar_to(spark, d):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "vec_id bigint")
    return pf.similar_to(table(spark, d, "embeddings"), "vec_id", "embedding", wanted, 5, 0.1)


@query(_LIFTS + """, j AS (SELECT p_brand, string_agg(char, ',' ORDER BY rank) AS characters FROM (SELECT p_brand, char, row_number() OVER (PARTITION BY p_brand ORDER BY lift DESC, char) AS rank FROM l) WHERE rank <= 3 GROUP BY p_brand)
SELECT p_partkey, length(p_name) AS length, embedding[1]::DOUBLE AS x, characters FROM part LEFT JOIN embeddings ON vec_id = p_partkey LEFT JOIN j USING (p_brand)""")
def adv19_village_features(spark, d):
    spatial = table(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return pf.village_features(_parts(spark, d), "p_partkey", "p_name", "p_brand", spatial, 3).withColumn("length", F.col("length").cast("long"))


@query("""WITH u AS (SELECT user_id, datediff('day', max(CAST(ts AS DATE)), (SELECT max(CAST(ts AS DATE)) FROM events)) AS recency, count(*) AS frequency, round(sum(value), 6) AS monetary FROM events GROUP BY user_id),
 s AS (SELECT *, 7 - 1 - """ + "(1 + " + " + ".join(f"(recency > (SELECT quantile_disc(recency, {x / 5}) FROM u))::INT" for x in range(1, 5)) + ") AS r, (1 + " + " + ".join(f"(frequency > (SELECT quantile_disc(frequency, {x / 5}) FROM u))::INT" for x in range(1, 5)) + """) AS f FROM u),
 g AS (SELECT *, CASE WHEN r >= 4 AND f >= 4 THEN 'champion' WHEN f >= 4 THEN 'loyal' WHEN r >= 4 THEN 'recent' WHEN r <= 2 AND f <= 2 THEN 'lost' WHEN r <= 2 THEN 'at risk' ELSE 'middle' END AS segment FROM s)
SELECT segment, count(*) AS users, round(avg(recency), 6) AS mean_recency, round(avg(frequency), 6) AS mean_frequency, round(avg(monetary), 6) AS mean_monetary FROM g GROUP BY segment""")
def agg36_segment_averages(spark, d):
    return agg.segment_averages(agg.rfm(table(spark, d, "events"), "user_id", "ts", "value"))
