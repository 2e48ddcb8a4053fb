"""Operators that differ from others in ordering, ties, zero rows or parameters (survey groups FLT, AGG, WIN, SET, FN, SRC)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.selection import matches
from lexigrid.operators.structures import bounded
from lexigrid.sources import tables

#: Fixed value: the sign that stands for an empty value in filters.
BLANK = "(空)"


def matches_by_index(columns: Sequence[str], filters: dict[int, list]) -> Column:
    """matches() with columns by their number from 0; BLANK stands for null and the empty text."""
    return matches({columns[k]: [None if v == BLANK else v for v in values] for k, values in filters.items()})


def path_predicate(path: str, allowed: Sequence[str], expanded: dict[tuple[str, str], list[str]]) -> Column:
    """The conjunction of [value]{column} pairs; (column, value) pairs in expanded match any of their values. A path without
    pairs, or with a column that isn't allowed, matches nothing."""
    pairs = re.findall(r"\[([^\[\]]+)\]\{([^{}]+)\}", path)
    if not pairs or any(c not in allowed for _, c in pairs):
        return F.lit(False)
    return reduce(and_, [F.col(c).isin(expanded.get((c, v), [v])) for v, c in pairs])


def unflagged(columns: Sequence[str]) -> Column:
    """True unless a column is 1, as number or text; null is no flag."""
    return reduce(and_, [~F.coalesce(F.col(c).cast("string") == "1", F.lit(False)) for c in columns], F.lit(True))


def denominators(rows: DataFrame, key: str, item: str) -> DataFrame:
    return rows.groupBy(key).agg(F.countDistinct(item).alias("n_items"))


def both_marks(rows: DataFrame, keys: list[str], item: str, mark: str, one: int, other: int) -> DataFrame:
    """Items of each cell that have both marks there."""
    has = lambda m: F.max((F.coalesce(F.col(mark) == m, F.lit(False))).cast("int"))
    return rows.groupBy(*keys, item).agg(has(one).alias("_a"), has(other).alias("_b")).filter("_a = 1 AND _b = 1").select(*keys, item)


def cross_table(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """All items of each cell in order and one after another, repeats kept, with their number. The text is the result, so a
    cell is one row; agg.feature_values gives the long form."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string")), "").alias("items"), F.count("*").alias("n"))


def cross_marks(rows: DataFrame, keys: list[str], item: str, mark: str) -> DataFrame:
    """Of each cell the different items with a mark from 1 to 3 (several), with mark 2, with mark 3 and with both, each in
    order and one after another; empty where there are none."""
    has = lambda test: F.max(F.coalesce(test, F.lit(False)).cast("int"))
    each = rows.groupBy(*keys, item).agg(has(F.col(mark).between(1, 3)).alias("a"), has(F.col(mark) == 2).alias("b"), has(F.col(mark) == 3).alias("c"))
    listed = lambda test, name: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col(item).cast("string")))), "").alias(name)
    return each.groupBy(*keys).agg(listed(F.col("a") == 1, "several"), listed(F.col("b") == 1, "second"), listed(F.col("c") == 1, "third"), listed((F.col("b") == 1) & (F.col("c") == 1), "both"))


def from_lower_level(cells: DataFrame, region: str, token: str, f: str) -> DataFrame:
    """A level's frequencies from the level below, with percent of the region and rank (ties by token)."""
    sums = cells.groupBy(region, token).agg(F.sum(f).alias(f))
    own = Window.partitionBy(region)
    return sums.select(region, token, f, F.round(F.col(f) * 100.0 / F.nullif(F.sum(f).over(own), F.lit(0)), 6).alias("percent"), F.row_number().over(own.orderBy(F.desc(f), token)).alias("rank"))


def in_range(rows: DataFrame, at: str, begin: Column, end: Column, user: str, path: str) -> DataFrame:
    """Calls, users and paths from begin to before end; the filter reaches the scan."""
    return rows.filter((F.col(at) >= begin) & (F.col(at) < end)).agg(F.count("*").alias("calls"), F.countDistinct(user).alias("users"), F.countDistinct(path).alias("paths"))


def field_values(rows: DataFrame, field: str, allowed: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values of an allowed field, ties by value."""
    if field not in allowed:
        raise ValueError(f"{field} isn't one of {', '.join(allowed)}")
    return rows.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def with_peak(rows: DataFrame, at: str, unit: str) -> DataFrame:
    """Rows of each time bucket, whether it is a peak, and the whole mean of all buckets."""
    counts = rows.groupBy(F.date_trunc(unit, at).alias("bucket")).agg(F.count("*").alias("n"))
    norm = counts.agg(F.max("n").alias("_most"), F.expr("sum(n) div count(*)").alias("mean_n"))
    return counts.crossJoin(F.broadcast(norm)).select("bucket", "n", (F.col("n") == F.col("_most")).alias("peak"), "mean_n")


def daily(rows: DataFrame, at: str, path: str, other: str, wanted: str | None = None) -> DataFrame:
    """Rows and different values of another column by day, of all paths or one."""
    used = rows if wanted is None else rows.filter(F.col(path) == wanted)
    return used.groupBy(F.date_trunc("day", at).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct(other).alias("n_different"))


def user_detail(rows: DataFrame, user: str, wanted: object, path: str, value: str) -> DataFrame:
    return rows.filter(F.col(user) == wanted).groupBy(path).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def ranked_positive(rows: DataFrame, user: str, value: str) -> DataFrame:
    """Competition rank of users with a positive total; different totals are ranked by ranges. Totals are added up once and
    written (see aggregation.ranking)."""
    from lexigrid.operators.aggregation import with_running

    totals = tables.Rounds(rows.sparkSession).written(rows.groupBy(user).agg(F.round(F.sum(value), 4).alias("total")).filter("total > 0"), "totals")
    steps = with_running(totals.groupBy("total").agg(F.count("*").alias("n")), "total", "n", descending=True)
    return totals.join(steps.select("total", (F.col("before") + 1).alias("rank")), "total").select(user, "total", "rank")


def rank_percent(rows: DataFrame, key: str, token: str) -> DataFrame:
    """Of each key's tokens by frequency (ties by token): place over the number of others."""
    counts = rows.groupBy(key, token).agg(F.count("*").alias("n"))
    own = Window.partitionBy(key)
    place = F.row_number().over(own.orderBy(F.desc("n"), token)) - 1
    return counts.select(key, token, F.round(place / F.greatest(F.count("*").over(own) - 1, F.lit(1)), 6).alias("rank_percent"))


def two_levels(rows: DataFrame, first: str, second: str, item: str) -> DataFrame:
    """Different items of each pair with percent of the first level's and of all pairs' items."""
    counts = rows.groupBy(first, second).agg(F.countDistinct(item).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(first, second, "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(first)), 4).alias("of_group"), F.round(F.col("n") * 100.0 / F.col("_all"), 4).alias("of_all"))


def dense_index(rows: DataFrame, item: str) -> DataFrame:
    """Each different item with its place from 0 in order; items are ordered by ranges, so no task orders all."""
    from lexigrid.operators.aggregation import with_running

    items = rows.filter(F.col(item).isNotNull()).select(item).distinct().withColumn("_one", F.lit(1))
    return with_running(items, item, "_one").select(item, F.col("before").alias("place"))


def dictionary_places(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The sorted places in the dictionary of all items of each cell's different items, joined by commas."""
    met = rows.select(*keys, item).distinct().join(dense_index(rows, item), item)
    return met.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda x: x.cast("string")), ",").alias("places"))


def local_peaks(rows: DataFrame, key: str, order: str, value: str, distance: int, prominence: float | None = None) -> DataFrame:
    """Rows above both neighbours that have no higher peak (or an equal one before) at fewer than `distance` rows; prominence:
    peaks that rise at least so far above the lower of the least values within `distance` rows on each side."""
    own = Window.partitionBy(key).orderBy(order)
    near = own.rowsBetween(-distance, distance)
    v = F.col(value)
    peak = (v > F.lag(v).over(own)) & (v > F.lead(v).over(own))
    marked = rows.select(*rows.columns, F.coalesce(peak, F.lit(False)).alias("_peak"))
    tall = F.when(F.col("_peak"), v)
    close = own.rowsBetween(-(distance - 1), -1), own.rowsBetween(1, distance - 1)
    beaten = (F.coalesce(F.max(tall).over(close[0]) >= v, F.lit(False))) | (F.coalesce(F.max(tall).over(close[1]) > v, F.lit(False)))
    out = marked.withColumns({"_beaten": beaten, "_rise": v - F.min(v).over(near)}).filter("_peak AND NOT _beaten")
    if prominence is not None:
        out = out.filter(F.col("_rise") >= prominence)
    return out.select(key, order, value)


def feature_union(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of each value of each feature, in one scan; null values don't count."""
    long = rows.select(*(F.col(f).cast("string").alias(f) for f in features)).unpivot([], list(features), "feature", "value")
    return long.filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))


def tagged(rows: DataFrame, tests: Sequence[Column]) -> DataFrame:
    """Each row once for each test that it meets, with the test's number, in one scan."""
    hits = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in enumerate(tests))))
    return rows.select("*", F.explode(hits).alias("query"))


def in_input_order(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys with the place at which the request names the key first, to order the answer by."""
    places = wanted.groupBy(key).agg(F.min("place").alias("place"))
    return rows.join(F.broadcast(places), key)


def word_list(rows: DataFrame, column: str, text: str | None, most: int) -> DataFrame:
    """Different trimmed words that hold the text (letter case ignored, % and _ taken literally), in order, at most so many."""
    words = rows.select(F.trim(column).alias("word")).filter("word <> ''")
    return (words.filter(F.contains(F.lower("word"), F.lit(text.lower()))) if text else words).distinct().orderBy("word").limit(most)


def values_with_totals(rows: DataFrame, key: str, value: str, item: str) -> DataFrame:
    """Different items of each value, and the sum over the key's values; lists are left out."""
    counts = rows.groupBy(key, value).agg(F.countDistinct(item).alias("n_items"))
    return counts.select(key, F.col(value).alias("value"), "n_items", F.sum("n_items").over(Window.partitionBy(key)).alias("total"))


def all_combinations(domain: DataFrame, rows: DataFrame, columns: list[str], item: str) -> DataFrame:
    """Different items for every combination of the columns' values in the domain, 0 where there are no rows. The columns are
    classes with few values (5,000 at most)."""
    every = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [bounded(domain.select(c).filter(F.col(c).isNotNull()).distinct()) for c in columns])
    counts = rows.groupBy(*columns).agg(F.countDistinct(item).alias("n_items"))
    return every.join(counts, columns, "left").select(*columns, F.coalesce("n_items", F.lit(0)).alias("n_items"))


def reading_details(rows: DataFrame, keys: list[str], reading: str, note: str) -> DataFrame:
    """Of each reading its different notes in order, joined by |, and its rows."""
    return rows.groupBy(*keys, reading).agg(F.array_join(F.array_sort(F.collect_set(note)), "|").alias("notes"), F.count("*").alias("n"))


def round_trip(rows: DataFrame, kind: str) -> DataFrame:
    """The rows as written in that format (csv or json) and read back with their types."""
    path = tables.export(rows, kind)
    spark = rows.sparkSession
    return tables.csv_rows(spark, path, rows.schema) if kind == "csv" else spark.read.schema(rows.schema).json(path)
