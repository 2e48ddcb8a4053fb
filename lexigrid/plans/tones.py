"""Tone queries over events as cells: user as location, event number as slot, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import tones as tn
from lexigrid.plans.queries import _READINGS, _readings, query
from lexigrid.sources.tables import table

#: Cells in the forms that occur: values, names, both, brackets, several, checked tones, empty.
CELLS = ["55陰平", "陰平,21", "33", "", "[5]35陽去|陰去", "5陰入;3陽入", "陽上歸陰去", "去聲", "24/陽平", "入", "213,35|53", "ʔ3上聲,13"]
READINGS = ["ka55", "jat5", "sap²A", "ma", "ŋo¹³", "paʔ3", "tin21", "kok33b"]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    rows = _readings(spark, d).groupBy(F.col("user_id").alias("location"), (F.col("event_id") % 10 + 1).alias("slot")).agg(F.max_by("k", "event_id").alias("k"))
    return rows.select("location", "slot", F.get(F.array(*map(F.lit, CELLS)), F.col("k") % len(CELLS)).alias("cell"))


_LIST = "[" + ", ".join(f"'{c}'" for c in CELLS) + "]"
_NAMED = " ".join(f"WHEN tone = '{t}' THEN len(list_filter(names, lambda n: regexp_matches(n, '{'|'.join(names)}'))) > 0" + (f" OR (slot <= 8 AND len(list_filter(names, lambda n: regexp_matches(n, '[^陽阳]{tn.CLASS_ENDS[t]}'))) > 0)" if t in tn.CLASS_ENDS else "") for t, names in tn.CLASS_NAMES.items())
_PARTS = rf"""WITH cell AS (SELECT user_id AS location, event_id % 10 + 1 AS slot, {_LIST}[arg_max(k, event_id) % {len(CELLS)} + 1] AS cell FROM {_READINGS} GROUP BY ALL),
 el AS (SELECT *, list_filter(list_transform(regexp_split_to_array(coalesce(cell, ''), '[，,|;]'), lambda x: trim(x)), lambda x: x <> '') AS e FROM cell),
 tot AS (SELECT *, array_to_string(list_transform(e, lambda x, i: CASE WHEN contains(x, '[') OR contains(x, ']') THEN x ELSE '[' || slot || CASE WHEN len(e) > 1 THEN chr((96 + i)::INT) ELSE '' END || ']' || x END), ',') AS total FROM el),
 rw AS (SELECT *, regexp_replace(total, '\[.*?\]', '', 'g') AS raw FROM tot),
 pt AS (SELECT *, CASE WHEN raw <> '' THEN regexp_split_to_array(raw, '[，,]') ELSE [] END AS parts FROM rw),
 nm AS (SELECT *, list_transform(parts, lambda p: array_to_string(regexp_extract_all(regexp_replace(p, '[-/ʔˀ]', '', 'g'), '[^0-9,]+'), '')) AS names FROM pt),
 vl AS (SELECT *, list_transform(parts, lambda p: CASE WHEN contains(array_to_string(regexp_extract_all(regexp_replace(p, '[-/ʔˀ]', '', 'g'), '[^0-9,]+'), ''), '入') THEN '`' ELSE '' END
   || array_to_string(regexp_extract_all(regexp_replace(p, '[ʔˀ]', '', 'g'), '[0-9/-]+'), '')) AS vals FROM nm),
 mt AS (SELECT location, slot, list_sort(list(tone)) AS matches FROM vl, (SELECT unnest(['T1','T2','T3','T4','T5','T6','T7','T8']) AS tone) WHERE CASE {_NAMED} END GROUP BY ALL),
 p AS (SELECT vl.*, coalesce(matches, []) AS matches FROM vl LEFT JOIN mt USING (location, slot)) """


@query(_PARTS + r"""SELECT location, slot, total, raw, array_to_string(vals, '|') AS vals, array_to_string(names, '|') AS names, array_to_string(matches, '|') AS matches, array_to_string(regexp_extract_all(total, '\[(\d+)\]', 1), '|') AS numbers FROM p""")
def fn8_tone_parts(spark, d):
    joined = lambda c, name: F.array_join(c, "|").alias(name)
    return tn.tone_parts(_cells(spark, d)).select("location", "slot", "total", "raw", joined("values", "vals"), joined("names", "names"), joined("matches", "matches"), joined("numbers", "numbers"))


@query(_PARTS + """, o AS (SELECT location, slot AS other, unnest(matches) AS tone FROM p), f AS (SELECT p.location, p.slot, string_agg('T' || other, ',' ORDER BY other) AS others FROM p JOIN o ON p.location = o.location AND o.tone = 'T' || p.slot AND other <> p.slot GROUP BY ALL)
SELECT p.location, p.slot, coalesce(CASE WHEN len(vals) > 0 THEN array_to_string(vals, ',') END, others, '無') AS shown FROM p LEFT JOIN f ON p.location = f.location AND p.slot = f.slot""")
def fn8_tone_summary(spark, d):
    return tn.tone_summary(tn.tone_parts(_cells(spark, d)))


_PAIRS = [(a, b) for a in range(1, 9) for b in range(1, 9) if a != b and (a + b) % 2]
_SAME = lambda c: f"list_sort(list_distinct({c}))"


@query(_PARTS + f""", w AS (SELECT unnest([{", ".join(f"{{a: {a}, b: {b}}}" for a, b in _PAIRS)}]) AS w),
 j AS (SELECT x.location, x.slot AS a, y.slot AS b, x.vals AS xv, y.vals AS yv, x.matches AS xm, y.matches AS ym, x.names AS xn, y.names AS yn FROM p x JOIN p y ON x.location = y.location JOIN w ON w.w.a = x.slot AND w.w.b = y.slot)
SELECT location, a::INT AS a, b::INT AS b, CASE WHEN (len(xm) > 0 AND len(ym) > 0 AND ({_SAME("xm")} = {_SAME("ym")} OR (list_contains(xm, 'T' || b) AND list_contains(ym, 'T' || a)))) OR (len(xm) = 0 AND len(ym) = 0 AND {_SAME("xv")} = {_SAME("yv")}) THEN 'same'
  WHEN len(list_intersect(xm, ym)) > 0 OR len(list_intersect(xv, yv)) > 0 THEN 'partial'
  WHEN (a = 6 AND b = 5 AND len(xv) = 0 AND len(xm) = 0 AND list_has_any(yn, ['去', '去聲', '去声'])) OR (a = 5 AND b = 6 AND len(yv) = 0 AND len(ym) = 0 AND list_has_any(xn, ['去', '去聲', '去声']))
    OR (a = 8 AND b = 7 AND len(xv) = 0 AND len(xm) = 0 AND list_has_any(yn, ['入', '入聲', '入声', '仄'])) OR (a = 7 AND b = 8 AND len(yv) = 0 AND len(ym) = 0 AND list_has_any(xn, ['入', '入聲', '入声', '仄'])) THEN 'maybe'
  WHEN (len(xv) = 0 AND len(xm) = 0) OR (len(yv) = 0 AND len(ym) = 0) THEN 'unknown' ELSE 'diff' END AS status FROM j""")
def set7_tone_pairs(spark, d):
    return tn.tone_pairs(tn.tone_parts(_cells(spark, d)), _PAIRS)


@query(f"""WITH r AS (SELECT user_id, event_type, k FROM {_READINGS}), v AS (SELECT DISTINCT k AS char, k AS variant FROM r UNION SELECT DISTINCT k, k + 1 FROM r WHERE k % 3 = 0)
SELECT user_id, char, coalesce(string_agg(t, '|' ORDER BY t), '') AS event_type FROM (SELECT DISTINCT user_id, char, event_type AS t FROM r JOIN v ON r.k = v.variant) GROUP BY user_id, char""")
def set8_collected_features(spark, d):
    rows = _readings(spark, d).select("user_id", "event_type", "k")
    variants = rows.filter("k % 3 = 0").select(F.col("k").alias("char"), (F.col("k") + 1).alias("variant")).distinct()
    return tn.collected_features(rows, variants, ["user_id"], "k", ["event_type"])


_DIGITS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(cell, ''), '\[[^\]]+\]', '', 'g'), '[，,;；/]+'), lambda p: regexp_extract(p, '([0-5]+)', 1)), lambda x: x <> '')"
_MEAN = lambda f: f"list_avg(list_transform(g, lambda x: {f}::DOUBLE)) / 5"


@query(_PARTS.split(" el AS")[0].rstrip().rstrip(",") + f""", g AS (SELECT location, slot, {_DIGITS} AS g FROM cell),
 c AS (SELECT location, slot, CASE WHEN len(g) > 0 THEN [1.0::DOUBLE, {_MEAN("x[1]")}, {_MEAN("CASE WHEN length(x) = 2 THEN (x[1]::INT + x[2]::INT) / 2 ELSE x[length(x) // 2 + 1]::INT END")}, {_MEAN("x[length(x)]")}] ELSE [0.0, 0, 0, 0] END AS v FROM g)
SELECT location, slot AS slot, round(v[1], 6) AS here, round(v[2], 6) AS first, round(v[3], 6) AS middle, round(v[4], 6) AS last FROM (SELECT l.location, s.slot::BIGINT AS slot, coalesce(v, [0.0, 0, 0, 0]) AS v FROM (SELECT DISTINCT location FROM cell) l CROSS JOIN range(1, 11) s(slot) LEFT JOIN c ON c.location = l.location AND c.slot = s.slot)""")
def fn9_tone_vectors(spark, d):
    long = tn.tone_vectors(_cells(spark, d)).select("location", F.posexplode("vector").alias("i", "x"))
    at = lambda k, name: F.round(F.max(F.when(F.col("i") % 4 == k, F.col("x"))), 6).alias(name)
    return long.groupBy("location", (F.expr("i div 4") + 1).alias("slot")).agg(at(0, "here"), at(1, "first"), at(2, "middle"), at(3, "last"))


@query(f"""WITH r AS (SELECT p_partkey, [{", ".join(f"'{r}'" for r in READINGS)}][p_partkey % {len(READINGS)} + 1] AS r FROM part),
 c AS (SELECT p_partkey::VARCHAR AS item, r, regexp_extract(r, '{tn.TONE_END}', 1) AS code FROM r), q AS (SELECT item, translate(code, '{tn.SUPERSCRIPTS}', '0123456789') AS tone,
 length(r) > length(code) AND contains('{tn.CHECKED_FINALS}', substr(r, length(r) - length(code), 1)) AS checked FROM c WHERE code <> ''),
 k AS (SELECT *, row_number() OVER (PARTITION BY checked, tone ORDER BY item) AS k FROM q)
SELECT checked, tone, count(*) AS n_items, string_agg(CASE WHEN k <= 20 THEN item END, ',' ORDER BY item) AS items FROM k GROUP BY checked, tone""")
def agg70_tone_census(spark, d):
    reading = F.get(F.array(*map(F.lit, READINGS)), (F.col("p_partkey") % len(READINGS)).cast("int"))
    return tn.tone_census(table(spark, d, "part").select("p_partkey", reading.alias("reading")), "p_partkey", "reading")
