"""Queries of the scalar functions, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions import text as fn
from lexigrid.operators import structures as st
from lexigrid.operators import tones as tn
from lexigrid.plans.queries import _READINGS, query
from lexigrid.sources.tables import table

SYLLABLES = ["gwong2", "ng5", "jyut6", "oi3", "caau", "m4", "hoeng1", "sik1/sek6", "nei5(you)", "aa"]
IPA = ["kʷɔŋ35", "ŋ13", "jyt2", "ɔi33", "∅a5", "ma輕聲", "tsʰau55", "sɿ⁵¹", "12", "pha3A"]
CHARS = ["食", "ab", "□", "", "好", "𠀀", "ｘ", "一二", "㐀", "的"]
LAYERS = [{"国": "國", "发": "發髮"}, {"后": "後后", "台": "臺台"}, {"里": "裏里"}]
TEXTS = ["国后里", "发台", "abc", "", "里里国", "台x后"]
RULES = {"initial": [("gw", "kʷ"), ("g", "k"), ("ng", "ŋ"), ("c", "tsʰ"), ("h", "h")], "nucleus": [("oe", "œ"), ("yu", "y"), ("o", "ɔ"), ("aa", "a"), ("a", "ɐ")], "coda": [("ng", "ŋ"), ("k", "k̚")], "tone": [("1", "55"), ("2", "35")]}
AGENTS = ["Mozilla iPhone Safari", "Linux x Chrome/1", "Windows NT Firefox", "Macintosh", "curl", "Android", "Windows Edge"]
_IPA_VOWELS = "aɔiuyɿeo"
_ALLOWED = "a-zʷɔŋʰɿ0-9⁰¹²³⁴⁵⁶⁷⁸⁹A"


def _pick(values: list[str], number: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(number) % len(values)).cast("int"))


def _sql(values: list[str], number: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{number} % {len(values)} + 1]"


def _case(text: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{a}') THEN replace({text}, '{a}', '{b}')" for a, b in sorted(rules, key=lambda r: (-len(r[0]), r[0]))) + f" ELSE {text} END"


_MAPS = "coalesce(" + ", ".join("MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in layer.items()) + "}[c]" for layer in LAYERS) + ", c)"


@query(f"""WITH t AS (SELECT p_partkey, {_sql(TEXTS, "p_partkey")} AS t FROM part), c AS (SELECT p_partkey, t, list_transform(list_filter(string_split(t, ''), lambda c: c <> ''), lambda c: {_MAPS}) AS found FROM t)
SELECT p_partkey, array_to_string(list_transform(found, lambda c: c[1]), '') AS traditional, array_to_string(found, '|') AS candidates FROM c""")
def fn1_script_candidates(spark, d):
    text = _pick(TEXTS, "p_partkey")
    return table(spark, d, "part").select("p_partkey", fn.to_traditional(text, LAYERS).alias("traditional"), F.array_join(fn.script_candidates(text, LAYERS), "|").alias("candidates"))


@query(f"""WITH t AS (SELECT p_partkey, {_sql(TEXTS, "p_partkey")} AS t FROM part), c AS (SELECT p_partkey, t, list_transform(list_filter(string_split(t, ''), lambda c: c <> ''), lambda c: {_MAPS}) AS found FROM t)
SELECT p_partkey, array_to_string(list_transform(found, lambda c: c[1]), '') AS traditional, array_to_string(found, '|') AS candidates FROM c""")
def fn1_converted_by_table(spark, d):
    rows = [(k, c, found) for k, layer in enumerate(LAYERS) for c, found in layer.items()]
    named = table(spark, d, "part").select("p_partkey", _pick(TEXTS, "p_partkey").alias("t"))
    return tn.converted(named, "p_partkey", "t", spark.createDataFrame(rows, "layer int, char string, candidates string"))


@query("SELECT p_partkey, translate(p_type, 'AEI', 'aei') AS shown FROM part")
def fn2_mapped_characters(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.mapped_characters(F.col("p_type"), {"A": "a", "E": "e", "I": "i"}).alias("shown"))


@query("SELECT page_id, array_to_string(list_filter(regexp_split_to_array(url, '[/?#:.]+'), lambda x: x <> ''), '|') AS parts FROM pages")
def fn4_split_many(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(fn.split_many(F.col("url"), "/?#:."), "|").alias("parts"))


@query("""SELECT p_partkey, p_brand || CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'brand' ELSE '' END || '·' || p_type AS label FROM part""")
def fn5_path_label(spark, d):
    path = F.format_string("[%s]{brand}[%s]{type}", "p_brand", "p_type")
    return table(spark, d, "part").select("p_partkey", fn.path_label(path, ["Brand#11", "Brand#12"]).alias("label"))


_NOTE = ["x", "_", "", "文·早", "白·"]


@query(f"""WITH r AS (SELECT event_id, trim({_sql(_NOTE, "event_id")}) AS n, CASE k % 4 WHEN 2 THEN '文·' WHEN 3 THEN '白·' ELSE '' END AS l FROM {_READINGS})
SELECT event_id, l AS label, CASE WHEN l = '' THEN n WHEN contains(n, l) THEN n WHEN n = '' OR n = '_' THEN l ELSE l || '；' || n END AS note FROM r""")
def fn6_mark_labels(spark, d):
    label = fn.mark_label(F.get_json_object("props", "$.k").cast("int") % 4, {2: "文·", 3: "白·"})
    return table(spark, d, "events").select("event_id", label.alias("label"), fn.merged_note(_pick(_NOTE, "event_id"), label).alias("note"))


@query("""SELECT p_partkey, TRY_CAST(trim(string_split(t, ',')[1]) AS DOUBLE) AS lat, TRY_CAST(trim(string_split(t, ',')[2]) AS DOUBLE) AS lon FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '23.5,' || p_partkey || '.25' WHEN 1 THEN 'north' ELSE '1, 2' END AS t FROM part)""")
def fn10_coordinates(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("23.5,"), "p_partkey", F.lit(".25"))).when(F.col("p_partkey") % 3 == 1, "north").otherwise("1, 2")
    at = fn.coordinates(text)
    return table(spark, d, "part").select("p_partkey", at["lat"].alias("lat"), at["lon"].alias("lon"))


@query(rf"""WITH s AS (SELECT p_partkey, {_sql(IPA, "p_partkey")} AS s FROM part), b AS (SELECT *, regexp_extract(regexp_replace(s, '^[∅Ø0]', ''), '^([^0-9⁰¹²³⁴⁵⁶⁷⁸⁹\s]*)', 1) AS letters FROM s),
 r AS (SELECT *, CASE WHEN regexp_matches(letters, '[{_IPA_VOWELS}]') THEN regexp_extract(letters, '([{_IPA_VOWELS}].*)$', 1) ELSE regexp_extract(letters, '([zflmnŋȵɲvʒr].*)$', 1) END AS rime FROM b)
SELECT p_partkey, CASE WHEN regexp_matches(s, '^[∅Ø0]') THEN 'ʔ' WHEN letters = '' THEN '' WHEN length(rime) = length(letters) THEN '/' ELSE substr(letters, 1, length(letters) - length(rime)) END AS onset, rime,
  CASE WHEN contains(s, '輕聲') THEN '輕聲' ELSE regexp_extract(s, '({fn.TONE_END[:-1]})$', 1) END AS tone FROM r""")
def fn11_onset_rime_tone(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.onset_rime_tone(_pick(IPA, "p_partkey"), _IPA_VOWELS).alias("x")).select("p_partkey", "x.*")


_SPLIT = r"""s1 AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS tone, regexp_replace(s, '[0-9]', '', 'g') AS letters FROM s0),
 s2 AS (SELECT *, CASE WHEN regexp_matches(letters, '[aeuioy]') THEN regexp_extract(letters, '([aeuioy].*)$', 1) ELSE regexp_extract(letters, '(ng|n|m)$', 1) END AS final FROM s1),
 s3 AS (SELECT *, substr(letters, 1, length(letters) - length(final)) AS initial, final IN ('ng', 'n', 'm') AS syllabic, regexp_matches(final, '[iu]$') AND len(regexp_extract_all(final, '[aeuioy]')) > 1 AS glide FROM s2),
 s4 AS (SELECT *, CASE WHEN syllabic THEN final WHEN glide THEN final[:-2] ELSE regexp_replace(final, '[^aeuioy]', '', 'g') END AS nucleus,
   CASE WHEN syllabic THEN '' WHEN glide THEN final[-1] ELSE regexp_replace(final, '[aeuioy]', '', 'g') END AS coda FROM s3)"""


@query(f"""WITH s0 AS (SELECT p_partkey, {_sql(SYLLABLES[:7], "p_partkey")} AS s FROM part), {_SPLIT} SELECT p_partkey, initial, final, tone, nucleus, coda FROM s4""")
def fn12_split_romanised(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.split_romanised(_pick(SYLLABLES[:7], "p_partkey")).alias("x")).select("p_partkey", "x.*")


@query(f"""SELECT p_partkey, {_case("p_type", [("SMALL", "little"), ("BRASS", "yellow"), ("TIN", "grey")])} AS shown FROM part""")
def fn13_first_rule(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.first_rule(F.col("p_type"), [("SMALL", "little"), ("BRASS", "yellow"), ("TIN", "grey")]).alias("shown"))


def _rules(part: str) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("of"), F.lit(b).alias("to")) for a, b in RULES[part]))


@query(rf"""WITH t AS (SELECT p_partkey, {_sql(SYLLABLES, "p_partkey")} AS t FROM part), b AS (SELECT p_partkey, array_to_string(regexp_extract_all(t, '\(([^()]*)\)', 1), ';') AS note, string_split(trim(regexp_replace(t, '\([^()]*\)', '', 'g')), '/') AS alts FROM t),
 s0 AS (SELECT p_partkey, note, unnest(alts) AS s, generate_subscripts(alts, 1) AS i FROM b), {_SPLIT}
SELECT p_partkey, string_agg({" || ".join("(" + _case(p, RULES[p]) + ")" for p in ("initial", "nucleus", "coda", "tone"))}, '/' ORDER BY i) AS ipa, any_value(note) AS note FROM s4 GROUP BY p_partkey""")
def fn14_romanised_to_ipa(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.romanised_to_ipa(_pick(SYLLABLES, "p_partkey"), {p: _rules(p) for p in RULES}).alias("x")).select("p_partkey", "x.*")


@query(rf"""WITH r AS (SELECT p_partkey, {_sql(CHARS, "p_partkey")} AS c, {_sql(IPA, "(p_partkey // 7)")} AS s FROM part)
SELECT p_partkey, CASE WHEN c = '' OR s = '' THEN '' ELSE array_to_string(list_sort(list_filter([CASE WHEN NOT regexp_matches(c, '^{fn.HAN}$') THEN 'not one character' END, CASE WHEN NOT regexp_matches(s, '{fn.TONE_END}') THEN 'no tone'
  WHEN regexp_matches(s, '^[0-9]') OR len(list_filter(regexp_split_to_array(s, '[,;/\\]'), lambda p: NOT regexp_matches(trim(p), '^[{_ALLOWED}]*$'))) > 0 THEN 'odd signs' END], lambda x: x IS NOT NULL)), '|') END AS errors FROM r""")
def fn15_format_errors(spark, d):
    part = table(spark, d, "part").withColumn("seventh", F.expr("p_partkey div 7"))
    return part.select("p_partkey", F.array_join(fn.format_errors(_pick(CHARS, "p_partkey"), _pick(IPA, "seventh"), _ALLOWED), "|").alias("errors"))


_ENDS = ["jat5", "ka55", "sap²", "ma", "kok33", "pa33", "tin21"]


@query(f"""WITH r AS (SELECT p_partkey, {_sql(_ENDS, "p_partkey")} AS s FROM part), c AS (SELECT *, regexp_extract(s, '({fn.TONE_END[:-1]})$', 1) AS code FROM r)
SELECT p_partkey, CASE WHEN code = '33' AND contains('ptk', s[length(s) - length(code)]) THEN s[:length(s) - length(code)] || '35' ELSE s END AS shown FROM c""")
def fn16_tone_replaced(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.tone_replaced(_pick(_ENDS, "p_partkey"), "33", "35", True, "ptk").alias("shown"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '^.*admin.*$') THEN 'closed' WHEN path = '/' THEN 'root' WHEN regexp_matches(path, '^/.*/.*/.*$') THEN 'deep' WHEN regexp_matches(path, '^/.*$') THEN 'any' ELSE 'other' END AS rule FROM p""")
def fn18_route_rules(spark, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1)
    return table(spark, d, "pages").select("page_id", fn.route_rule(path, [("/*", "any"), ("/", "root"), ("/*/*/*", "deep")], [("*admin*", "closed")], "other").alias("rule"))


_DEVICE = f"""WITH a AS (SELECT event_id, user_id, {_sql(AGENTS, "event_id")} AS a FROM events), o AS (SELECT *, CASE WHEN contains(a, 'iPhone') OR contains(a, 'iPad') THEN 'iOS' WHEN contains(a, 'Android') THEN 'Android' WHEN contains(a, 'Windows') THEN 'Windows'
 WHEN contains(a, 'Macintosh') THEN 'Mac OS' WHEN contains(a, 'Linux') THEN 'Linux' ELSE 'Unknown OS' END AS os FROM a),
 v AS (SELECT *, CASE WHEN contains(a, 'Chrome') THEN 'Chrome' WHEN contains(a, 'Firefox') THEN 'Firefox' WHEN contains(a, 'Safari') THEN 'Safari' WHEN contains(a, 'Edge') THEN 'Edge'
 WHEN os IN ('iOS', 'Mac OS') THEN 'Safari' WHEN os IN ('Android', 'Windows') THEN 'Chrome' WHEN os = 'Linux' THEN 'Firefox' ELSE 'Unknown Browser' END AS browser FROM o) """


@query(_DEVICE + "SELECT event_id, os, browser FROM v")
def fn20_device(spark, d):
    return table(spark, d, "events").select("event_id", fn.device(_pick(AGENTS, "event_id")).alias("x")).select("event_id", "x.*")


@query("""SELECT event_id, ts + INTERVAL 8 HOUR AS local, CAST(date_trunc('day', ts + INTERVAL 8 HOUR) AS TIMESTAMP) AS day, ts - INTERVAL 8 HOUR AS back FROM events""")
def fn22_zone_times(spark, d):
    return table(spark, d, "events").select("event_id", fn.local_time(F.col("ts")).alias("local"), F.date_trunc("day", fn.local_time(F.col("ts"))).alias("day"), fn.utc_time(F.col("ts")).alias("back"))


@query()
def fn28_fuzzy_ratio(spark, d):
    """No SQL: tested against the longest common subsequence by dynamic programming."""
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    other = names.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("next"))
    return names.join(other, "n_nationkey").select("n_nationkey", "n_name", "next", F.round(fn.fuzzy_ratio(F.col("n_name"), F.col("next")), 6).alias("ratio"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'a|' || event_type END AS items FROM events""")
def fn29_json_list(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, "no list").otherwise(F.concat(F.lit('["a", "'), "event_type", F.lit('"]')))
    found = fn.json_list(text)
    return table(spark, d, "events").select("event_id", F.when(found.isNotNull(), F.array_join(found, "|")).alias("items"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events""")
def fn30_finite(spark, d):
    odd = F.when(F.col("event_id") % 3 == 0, F.col("value")).when(F.col("event_id") % 3 == 1, float("nan")).otherwise(float("-inf"))
    return table(spark, d, "events").select("event_id", fn.finite(odd).alias("value"))


@query("""SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS total, round(avg(p_retailprice), 4) AS mean, min(abs(p_size - 25)) AS least, max(p_size) AS most, round(sum(sqrt(p_size)), 4) AS roots, round(sum(pow(p_size, 2)), 2) AS squares,
  round(sum(log10(p_size + 1)), 4) AS logs, round(sum(exp(-p_size)), 6) AS exps, max(length(trim(p_type))) AS longest, min(substr(replace(p_name, 'a', 'b'), 1, 3)) AS name, string_agg(DISTINCT substr(p_type, 1, 2), ',' ORDER BY substr(p_type, 1, 2)) AS types,
  sum(CASE WHEN p_type LIKE '%TIN%' THEN 1 ELSE 0 END)::BIGINT AS tins, sum(coalesce(nullif(p_size, 1), 0))::BIGINT AS not_one FROM part WHERE p_size IN (1, 2, 3, 4, 5) GROUP BY p_brand""")
def fn31_built_ins(spark, d):
    c = F.col
    return table(spark, d, "part").filter(c("p_size").isin(1, 2, 3, 4, 5)).groupBy("p_brand").agg(
        F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.min(F.abs(c("p_size") - 25)).alias("least"), F.max("p_size").alias("most"),
        F.round(F.sum(F.sqrt("p_size")), 4).alias("roots"), F.round(F.sum(F.pow("p_size", F.lit(2))), 2).alias("squares"), F.round(F.sum(F.log10(c("p_size") + 1)), 4).alias("logs"), F.round(F.sum(F.exp(-c("p_size"))), 6).alias("exps"),
        F.max(F.length(F.trim("p_type"))).cast("long").alias("longest"), F.min(F.substring(F.replace("p_name", F.lit("a"), F.lit("b")), 1, 3)).alias("name"), F.array_join(F.array_sort(F.collect_set(F.substring("p_type", 1, 2))), ",").alias("types"),
        F.count_if(c("p_type").like("%TIN%")).alias("tins"), F.sum(F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(0))).alias("not_one"),
    )


@query("""SELECT l_returnflag, l_linestatus || ':' || n AS cell FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)""")
def fn32_nested_maps(spark, d):
    nested = st.nested_map(table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "l_returnflag", "l_linestatus", "n")
    return nested.select("l_returnflag", F.explode("cells").alias("k", "v")).select("l_returnflag", F.concat("k", F.lit(":"), "v").alias("cell"))


@query("""SELECT p_partkey FROM (SELECT p_partkey, list_transform(regexp_extract_all(lower(p_name), '(?s)(ch|sh|.)'), lambda s: CASE s WHEN 'a' THEN 0 WHEN 'ch' THEN 1 WHEN 'c' THEN 2 WHEN 'sh' THEN 3 WHEN 's' THEN 4 ELSE 5 END) AS k FROM part) ORDER BY k, p_partkey LIMIT 50""")
def ord2_symbol_order(spark, d):
    keys = st.symbol_keys(F.lower("p_name"), ["a", "ch", "c", "sh", "s"])
    return table(spark, d, "part").select("p_partkey", keys.alias("k")).orderBy("k", "p_partkey").limit(50).select("p_partkey")


@query(f"""SELECT p_partkey, {_case("p_type", [("SMALL", "little"), ("BRASS", "yellow")])} AS shown FROM part""")
def udf4_user_rules(spark, d):
    rules = spark.createDataFrame([("SMALL", "little"), ("BRASS", "yellow")], "of string, to string").agg(F.collect_list(F.struct("of", "to")).alias("rules"))
    return table(spark, d, "part").crossJoin(F.broadcast(rules)).select("p_partkey", fn.first_of(F.col("p_type"), F.col("rules")).alias("shown"))
