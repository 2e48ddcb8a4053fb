"""Tone cells: parsing, comparison, contours and census (survey groups FN, SET, AGG).

A location has ten tone slots; a cell of a slot holds tone values and names in free text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The names of the tone classes 1 to 8.
CLASS_NAMES = {
    "T1": ["陰平", "平聲", "阴平", "平声"],
    "T2": ["陽平", "阳平"],
    "T3": ["陰上", "上聲", "阴上", "上声"],
    "T4": ["陽上", "阳上"],
    "T5": ["陰去", "去聲", "阴去", "去声"],
    "T6": ["陽去", "阳去"],
    "T7": ["陰入", "阴入"],
    "T8": ["陽入", "阳入"],
}
#: The last character of a name that stands for an upper class, unless a lower register's sign is before it.
CLASS_ENDS = {"T1": "平", "T3": "上", "T5": "去", "T7": "入"}
#: The generic names by which an empty T6 or T8 may be the same as T5 or T7.
GENERIC = {("T6", "T5"): ["去", "去聲", "去声"], ("T8", "T7"): ["入", "入聲", "入声", "仄"]}
#: Finals of checked syllables, and superscript digits.
CHECKED_FINALS = "ptkʔˀᵖᵏᵗbdg"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
TONE_END = r"([0-9⁰¹²³⁴⁵⁶⁷⁸⁹]{1,4}[ABCDabcd]?)$"


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def tone_parts(cells: DataFrame) -> DataFrame:
    """cells: location, slot (1 to 10), cell. Adds total (the elements, numbered where they aren't), raw (without brackets),
    values and names of its parts, matches (classes that a name stands for, sorted) and numbers in brackets.

    A null or empty cell has empty lists. A value whose name holds 入 begins with a grave accent."""
    elements = F.filter(F.transform(F.split(F.coalesce("cell", F.lit("")), "[，,|;]"), lambda x: F.trim(x)), lambda x: x != "")
    letter = lambda i: F.when(F.size("elements") > 1, F.chr(F.lit(97) + i)).otherwise("")
    marked = lambda x, i: F.when(F.contains(x, F.lit("[")) | F.contains(x, F.lit("]")), x).otherwise(F.concat(F.lit("["), F.col("slot").cast("string"), letter(i), F.lit("]"), x))
    rows = cells.withColumn("elements", elements).withColumn("total", F.array_join(F.transform("elements", marked), ","))
    rows = rows.withColumn("raw", F.regexp_replace("total", r"\[.*?\]", "")).withColumn("parts", F.when(F.col("raw") != "", F.split("raw", "[，,]")).otherwise(F.array().cast("array<string>")))
    name = lambda p: _joined(F.regexp_extract_all(F.regexp_replace(p, "[-/ʔˀ]", ""), F.lit(r"([^0-9,]+)")))
    value = lambda p: F.concat(F.when(F.contains(name(p), F.lit("入")), "`").otherwise(""), _joined(F.regexp_extract_all(F.regexp_replace(p, "[ʔˀ]", ""), F.lit(r"([0-9/-]+)"))))
    rows = rows.withColumns({"names": F.transform("parts", name), "values": F.transform("parts", value)})

    def stands(tone: str):
        pattern = "|".join(CLASS_NAMES[tone])
        ends = f"[^陽阳]{CLASS_ENDS[tone]}" if tone in CLASS_ENDS else None
        some = F.exists("names", lambda n: F.rlike(n, F.lit(pattern)))
        if ends:
            some = some | ((F.col("slot") <= 8) & F.exists("names", lambda n: F.rlike(n, F.lit(ends))))
        return F.when(some, tone)

    matches = F.array_compact(F.array(*map(stands, CLASS_NAMES)))
    numbers = F.regexp_extract_all("total", F.lit(r"\[(\d+)\]"))
    return rows.withColumns({"matches": matches, "numbers": numbers}).drop("elements", "parts")


def tone_summary(parts: DataFrame) -> DataFrame:
    """location, slot, shown: a slot's values, or the slots whose names stand for its class, or 無.

    parts: tone_parts(). Slots meet inside a location by an equi-join; a location has ten."""
    own = parts.select("location", "slot", F.concat(F.lit("T"), "slot").alias("tone"), F.when(F.size("values") > 0, F.array_join("values", ",")).alias("own"))
    named = parts.select("location", F.col("slot").alias("other"), F.explode("matches").alias("tone"))
    found = own.join(named, ["location", "tone"], "left").filter("other IS NULL OR other <> slot").groupBy("location", "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_set("other")), lambda k: F.concat(F.lit("T"), k.cast("string"))), ",").alias("others"))
    return own.join(found, ["location", "slot"], "left").select("location", "slot", F.coalesce("own", F.nullif("others", F.lit("")), F.lit("無")).alias("shown"))


def compare_tones(a: str, b: str) -> Column:
    """same, partial, maybe, unknown or diff of two slots' structs (tone, values, matches, names), by the first rule that holds.

    same: equal matches that aren't empty, or each named by the other, or no matches and equal values. partial: a shared
    match or value. maybe: an empty T6 (T8) beside a T5 (T7) with a generic name. unknown: a side is empty."""
    x, y = F.col(a), F.col(b)
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    both = (F.size(x["matches"]) > 0) & (F.size(y["matches"]) > 0)
    none = (F.size(x["matches"]) == 0) & (F.size(y["matches"]) == 0)
    same = (both & ((as_set(x["matches"]) == as_set(y["matches"])) | (F.array_contains(x["matches"], y["tone"]) & F.array_contains(y["matches"], x["tone"])))) | (none & (as_set(x["values"]) == as_set(y["values"])))
    empty = lambda c: (F.size(c["values"]) == 0) & (F.size(c["matches"]) == 0)
    maybe = F.lit(False)
    for (lower, upper), names in GENERIC.items():
        generic = lambda c: F.arrays_overlap(c["names"], F.array(*map(F.lit, names)))  # noqa: B023, E731
        maybe = maybe | ((x["tone"] == lower) & (y["tone"] == upper) & empty(x) & generic(y)) | ((x["tone"] == upper) & (y["tone"] == lower) & empty(y) & generic(x))
    partial = (F.size(F.array_intersect(x["matches"], y["matches"])) > 0) | (F.size(F.array_intersect(x["values"], y["values"])) > 0)
    return F.when(same, "same").when(partial, "partial").when(maybe, "maybe").when(empty(x) | empty(y), "unknown").otherwise("diff")


def tone_pairs(parts: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """location, a, b, status for the given pairs of slots of each location; slots without a row are left out."""
    wanted = parts.sparkSession.createDataFrame(pairs, "a int, b int")
    side = lambda n: parts.select("location", F.col("slot").cast("int").alias(n), F.struct(F.concat(F.lit("T"), F.col("slot").cast("string")).alias("tone"), "values", "matches", "names").alias(f"_{n}"))
    met = side("a").join(F.broadcast(wanted), "a").join(side("b"), ["location", "b"])
    return met.select("location", "a", "b", compare_tones("_a", "_b").alias("status"))


def collected_features(rows: DataFrame, variants: DataFrame, keys: list[str], char: str, features: list[str]) -> DataFrame:
    """Values of each feature of a character over its script variants: keys, char, and for each feature its sorted values,
    joined by |. variants: char, variant; a character is a variant of itself."""
    own = rows.select(F.col(char).alias("char")).distinct().select("char", F.col("char").alias("variant"))
    every = own.unionByName(variants.select("char", "variant")).distinct()
    values = [F.array_join(F.array_sort(F.collect_set(F.col(f).cast("string"))), "|").alias(f) for f in features]
    return rows.withColumnRenamed(char, "variant").join(every, "variant").groupBy(*keys, "char").agg(*values)


def converted(rows: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """key, traditional (the text with each character's first candidate) and candidates (joined by |), by a table of layer, char
    and candidates: for tables of thousands of characters, where text.to_traditional takes small ones. A character takes the
    candidates of its least layer, or stands for itself. A table has at most as many characters as Unicode, so it goes to every
    task, and no row is shuffled: keys may be repeated or null. Null and empty texts give empty results."""
    known = table.filter("char IS NOT NULL AND candidates <> ''").groupBy("char").agg(F.min_by("candidates", "layer").alias("found"))
    shared = rows.sparkSession.sparkContext.broadcast({r.char: r.found for r in known.collect()})

    @F.pandas_udf("array<string>")
    def candidates(texts: pd.Series) -> pd.Series:
        found = shared.value
        return texts.map(lambda t: [found.get(c, c) for c in t] if isinstance(t, str) else [])

    out = rows.select(F.col(key), candidates(text).alias("x"))
    return out.select(key, F.array_join(F.transform("x", lambda c: F.substring(c, 1, 1)), "").alias("traditional"), F.array_join("x", "|").alias("candidates"))


def contour(cell: Column) -> Column:
    """1 and the mean first, middle and last pitch (0 to 1) of a cell's contours; zeros without any."""
    parts = F.split(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\[[^\]]+\]", ""), "[，,;；/]+")
    digits = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, "([0-5]+)", 1)), lambda d: d != "")
    at = lambda d, k: F.substr(d, k, F.lit(1)).cast("double")
    middle = lambda d: F.when(F.length(d) == 2, (at(d, F.lit(1)) + at(d, F.lit(2))) / 2).otherwise(at(d, (F.floor(F.length(d) / 2) + 1).cast("int")))
    mean = lambda f: F.aggregate(F.transform(digits, f), F.lit(0.0), lambda s, x: s + x) / F.size(digits) / 5
    found = F.array(F.lit(1.0), mean(lambda d: at(d, F.lit(1))), mean(middle), mean(lambda d: at(d, F.length(d))))
    return F.when(F.size(digits) > 0, found).otherwise(F.array(*[F.lit(0.0)] * 4))


def tone_vectors(cells: DataFrame, slots: int = 10) -> DataFrame:
    """location and its contours of slots 1, 2, ... one after another; a slot without a cell has zeros."""
    rows = cells.select("location", "slot", contour(F.col("cell")).alias("v"))
    each = [F.coalesce(F.max(F.when(F.col("slot") == k, F.col("v"))), F.array(*[F.lit(0.0)] * 4)) for k in range(1, slots + 1)]
    return rows.groupBy("location").agg(F.flatten(F.array(*each)).alias("vector"))


def tone_census(rows: DataFrame, item: str, reading: str, shown: int = 20) -> DataFrame:
    """checked (whether the syllable ends in a checked final), tone (superscripts as digits), number of items, and the first
    `shown` items in order, joined by commas. Readings without a tone, and empty items, don't count."""
    code = F.regexp_extract(F.trim(reading), TONE_END, 1)
    used = rows.select(F.trim(F.col(item).cast("string")).alias("item"), F.trim(reading).alias("reading"), code.alias("code")).filter("item <> '' AND code <> ''")
    before = F.substr("reading", F.length("reading") - F.length("code"), F.lit(1))
    checked = (F.length("reading") > F.length("code")) & F.contains(F.lit(CHECKED_FINALS), before)
    cells = used.select("item", F.translate("code", SUPERSCRIPTS, "0123456789").alias("tone"), checked.alias("checked"))
    counted = cells.groupBy("checked", "tone", "item").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("checked", "tone").orderBy("item"))
    return counted.withColumn("k", place).groupBy("checked", "tone").agg(F.sum("n").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.col("item")))), ",").alias("items"))
