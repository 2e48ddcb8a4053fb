"""Readings, classes and their look-ups (survey groups FLT, JOIN, AGG, SRC)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrid.operators.structures import compare_sets

#: The labels of readings with mark 2 (literary) and 3 (colloquial).
LITERARY, COLLOQUIAL = "文·", "白·"


def status_to_reading(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """Values of each location with their items, the share of the location's items (4 places), and the readings of items
    that have several. rows: location, value, item, mark, reading; locations: location.

    A location without rows has one row with count 0. Readings are ordered by mark, then text."""
    used = rows.join(locations.select("location").distinct(), "location", "left_semi")
    label = F.when(F.col("mark") == 2, LITERARY).when(F.col("mark") == 3, COLLOQUIAL).otherwise("")
    each = used.groupBy("location", "value", "item").agg(F.array_sort(F.collect_set(F.struct("mark", F.concat(label, "reading").alias("shown")))).alias("readings"), F.countDistinct("reading").alias("n_readings"))
    shown = F.concat_ws(":", F.col("item").cast("string"), F.array_join(F.transform("readings", lambda r: r["shown"]), "|"))
    cells = each.groupBy("location", "value").agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("all"), F.array_sort(F.collect_list(F.when(F.col("n_readings") > 1, F.struct("item", shown.alias("shown"))))).alias("several")
    )
    totals = used.groupBy("location").agg(F.countDistinct("item").alias("n_all"))
    return (
        locations.select("location").join(cells, "location", "left").join(totals, "location", "left")
        .select(
            "location", "value", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce(F.round(F.col("n_items") / F.col("n_all"), 4), F.lit(0.0)).alias("share"),
            F.coalesce(F.array_join(F.col("all").cast("array<string>"), ","), F.lit("")).alias("items"), F.coalesce(F.array_join(F.transform("several", lambda s: s["shown"]), ";"), F.lit("")).alias("detail"),
        )
    )


def reading_to_status(rows: DataFrame, key: str, classes: str, item: str) -> DataFrame:
    """Items of each key and class, their share of the key's items, and how many of them have several classes there."""
    each = rows.select(key, classes, item).distinct()
    kinds = each.groupBy(key, item).agg(F.count("*").alias("n_classes"))
    cells = each.join(kinds, [key, item]).groupBy(key, classes).agg(F.count("*").alias("n_items"), F.sum((F.col("n_classes") > 1).cast("long")).alias("n_several"))
    return cells.join(kinds.groupBy(key).agg(F.count("*").alias("n_all")), key).select(key, classes, "n_items", "n_several", F.round(F.col("n_items") / F.col("n_all"), 4).alias("share"))


def mark_details(rows: DataFrame, key: str, item: str, mark: str, reading: str) -> DataFrame:
    """Sorted readings of each item, joined by |, by mark: 1 polyphonic, 2 literary, 3 colloquial; empty where none."""
    joined = lambda m: F.array_join(F.array_sort(F.collect_set(F.when(F.col(mark) == m, F.col(reading)))), "|")
    return rows.groupBy(key, item).agg(joined(1).alias("polyphonic"), joined(2).alias("literary"), joined(3).alias("colloquial"))


def level_values(df: DataFrame, levels: list[str]) -> DataFrame:
    """Distinct values of each hierarchy column in one scan: level, value."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in levels)).unpivot([], levels, "level", "value").filter("value IS NOT NULL").distinct()


def extents(df: DataFrame, label: str, x: Column, y: Column, noise: int) -> DataFrame:
    """Number, centre and extent of each cluster's points; points of the noise label are left out."""
    points = df.filter(F.col(label) != noise).select(label, x.cast("double").alias("x"), y.cast("double").alias("y"))
    return points.groupBy(label).agg(
        F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.max("x") - F.min("x"), 6).alias("width"), F.round(F.max("y") - F.min("y"), 6).alias("height")
    )


def dashboard(events: DataFrame, user: str, time: str) -> DataFrame:
    """metric, n: all calls, users, and users active in the last 7 and 30 days up to the newest event."""
    newest = events.agg(F.max(time).alias("newest"))
    seen = events.select(user, time).crossJoin(F.broadcast(newest))
    since = lambda days: F.countDistinct(F.when(F.col(time) >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS"), F.col(user)))
    wide = seen.agg(F.count("*").alias("calls"), F.countDistinct(user).alias("users"), since(7).alias("active_7"), since(30).alias("active_30"))
    return wide.unpivot([], wide.columns, "metric", "n")


def category_shares(df: DataFrame, key: str, kind: Column) -> DataFrame:
    """Rows of each key by category and percent of the key's rows; counts are combined before the totals are made."""
    counts = df.groupBy(key, kind.alias("kind")).agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy(key).agg(F.sum("n").alias("n_all")), key).select(key, "kind", "n", F.round(F.col("n") * 100.0 / F.col("n_all"), 4).alias("percent"))


def tagged(df: DataFrame, predicates: list[Column]) -> DataFrame:
    """Rows with the number of each predicate that they meet (from 0), all predicates in one scan."""
    tags = F.array_compact(F.array(*(F.when(p, F.lit(i)) for i, p in enumerate(predicates))))
    return df.withColumn("tag", F.explode(tags))


def combinations(df: DataFrame, predicates: list[Column], extra: list[str], item: str) -> DataFrame:
    """Items under each predicate and each combination of the extra columns that occurs."""
    return tagged(df, predicates).groupBy("tag", *extra).agg(F.countDistinct(item).alias("n_items"))


def subset(name: str, text: str = "", mode: str = "contains", least: int | None = None, most: int | None = None, at: tuple[int, str] | None = None, any_of: list[Column] = (), all_of: list[Column] = ()) -> Column:
    """One condition from the parts that are given: the name by mode (exact, prefix, suffix, contains), its length, a
    character at a place (from 1), any of some flags and all of others. Null names and flags don't match."""
    c, parts = F.col(name), []
    if text:
        parts.append({"exact": lambda: c == text, "prefix": lambda: F.startswith(c, F.lit(text)), "suffix": lambda: F.endswith(c, F.lit(text)), "contains": lambda: F.contains(c, F.lit(text))}[mode]())
    if least is not None:
        parts.append(F.char_length(c) >= least)
    if most is not None:
        parts.append(F.char_length(c) <= most)
    if at:
        parts.append(F.substring(c, at[0], 1) == at[1])
    if any_of:
        parts.append(reduce(or_, [F.coalesce(x, F.lit(False)) for x in any_of]))
    return F.coalesce(reduce(and_, [*parts, *all_of], F.lit(True)), F.lit(False))


def any_level(levels: list[str], name: str) -> Column:
    """The name is the value of any of the level columns."""
    return F.coalesce(reduce(or_, [F.coalesce(F.col(c) == name, F.lit(False)) for c in levels]), F.lit(False))


def matched_or_all(df: DataFrame, hit: Column) -> DataFrame:
    """Rows that match, or all rows where none does. The answer to whether any does is a single row."""
    test = F.coalesce(hit, F.lit(False))
    found = df.agg(F.coalesce(F.max(test), F.lit(False)).alias("any_match"))
    return df.crossJoin(F.broadcast(found)).filter(test | ~F.col("any_match")).select(*df.columns)


def prefix_rules(name: str, include: list[str], exclude: list[str]) -> Column:
    """Paths with one of the prefixes to include and none of those to exclude; without the first, all but the second."""
    starts = lambda rules: reduce(or_, [F.startswith(F.col(name), F.lit(p)) for p in rules])
    wanted = starts(include) if include else F.lit(True)
    return F.coalesce(wanted & ~starts(exclude) if exclude else wanted, F.lit(False))


def centroids(df: DataFrame, places: DataFrame, region: str, x: str, y: str) -> DataFrame:
    """Rows with the mean coordinates of their region's places; null where the region has none."""
    means = places.groupBy(region).agg(F.round(F.avg(x), 6).alias("mean_x"), F.round(F.avg(y), 6).alias("mean_y"))
    return df.join(means, region, "left")


def symmetric_lookup(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values of wanted pairs (a, b) whichever way the table holds them: both sides are put in order and meet by equality."""
    ordered = lambda df: df.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).drop("a", "b")
    return ordered(wanted).join(ordered(pairs), ["low", "high"])


def item_pairs(rows: DataFrame, items: list, location: str, item: str, value: str) -> DataFrame:
    """For each location, pairs of the listed items (a < b) with their value sets compared: same, partial or diff."""
    sets = rows.filter(F.col(item).isin(items)).groupBy(location, item).agg(F.collect_set(value).alias("v"))
    left, right = sets.select(location, F.col(item).alias("a"), F.col("v").alias("x")), sets.select(location, F.col(item).alias("b"), F.col("v").alias("y"))
    return left.join(right, location).filter("a < b").select(location, "a", "b", compare_sets(F.col("x"), F.col("y")).alias("relation"))


def schema_rows(df: DataFrame) -> DataFrame:
    """position (from 1) and name of each column; a schema is bounded by its table's width."""
    return df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(df.schema.fields, 1)], "position int, name string")


def reference_list(main: DataFrame, supplement: DataFrame, key: str) -> DataFrame:
    """The main list, then entries of the supplement whose key it lacks."""
    return main.unionByName(supplement.join(main.select(key), key, "left_anti").select(*main.columns))


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested records as columns a_b, at any depth."""

    def leaves(kind: StructType, path: list[str]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = [*path, f.name]
            out += leaves(f.dataType, here) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here))]
        return out

    return df.select(*leaves(df.schema, []))
