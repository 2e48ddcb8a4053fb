"""Further parts of operators whose main form is elsewhere: classes, details, distincts, histories, nested trees (survey groups
AGG, FLT, JOIN, ADV, STR, SRC)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.operators import timelines
from lexigrid.operators.structures import bounded

#: Classes of items by the marks of their readings in a cell: 2 and 3, 2, 3, or 1.
BOTH, SECOND, THIRD, SEVERAL = "文白讀", "文讀", "白讀", "多音字"


def mark_classes(rows: DataFrame, keys: list[str], item: str, mark: str) -> DataFrame:
    """keys, class, items (sorted, joined by commas): items of each cell by the marks that they have there."""
    has = lambda m: F.max(F.coalesce(F.col(mark) == m, F.lit(False)).cast("int")).alias(f"m{m}")
    each = rows.groupBy(*keys, item).agg(has(1), has(2), has(3))
    kind = F.when(F.expr("m2 = 1 AND m3 = 1"), BOTH).when(F.col("m2") == 1, SECOND).when(F.col("m3") == 1, THIRD).when(F.col("m1") == 1, SEVERAL)
    named = each.withColumn("class", kind).filter("class IS NOT NULL")
    return named.groupBy(*keys, "class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string")), ",").alias("items"))


def class_details(rows: DataFrame, key: str, classes: str, item: str, ambiguous: Sequence[str], suffix: str) -> DataFrame:
    """Of each key and class: the label (with the suffix, if ambiguous), items, their share, and item:class|class of the items
    with several classes at the key, joined by semicolons."""
    each = rows.select(key, classes, item).distinct()
    own = each.groupBy(key, item).agg(F.array_sort(F.collect_set(F.col(classes).cast("string"))).alias("all"))
    shown = F.when(F.size("all") > 1, F.concat(F.col(item).cast("string"), F.lit(":"), F.array_join("all", "|")))
    cells = each.join(own, [key, item]).groupBy(key, classes).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(shown)), ";").alias("detail"))
    totals = own.groupBy(key).agg(F.count("*").alias("n_all"))
    label = F.concat(F.col(classes).cast("string"), F.when(F.col(classes).isin(list(ambiguous)), suffix).otherwise(""))
    return cells.join(totals, key).select(key, label.alias("label"), "n_items", F.round(F.col("n_items") / F.col("n_all"), 4).alias("share"), "detail")


def merged_with_notes(reference: DataFrame, others: Sequence[DataFrame], key: str, value: str, note: str) -> DataFrame:
    """As comparison.merged_lists, with a column of notes beside each: the notes of entries that occur more than once, in the
    order of their values, joined by semicolons; null for single entries."""

    def joined(df: DataFrame, number: int) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("v"), F.coalesce(note, F.lit("")).alias("n"))))
        named = df.filter(F.col(value).isNotNull()).groupBy(key).agg(rows.alias("r"))
        values, notes = F.transform("r", lambda x: x["v"]), F.transform("r", lambda x: x["n"])
        one = F.size(F.array_distinct(values)) == 1
        return named.select(key, F.when(one, F.get(values, F.lit(0))).otherwise(F.array_join(values, ";")).alias(f"value_{number}"), F.when(F.size("r") > 1, F.array_join(notes, ";")).alias(f"note_{number}"))

    return reduce(lambda out, x: out.join(joined(x[1], x[0]), key, "left"), enumerate(others, 1), reference)


def any_structure(structures: Sequence[dict[str, object]]) -> Column:
    """Any of several conjunctions of columns and their values; none given means all rows."""
    one = lambda s: reduce(and_, [F.coalesce(F.col(c) == v, F.lit(False)) for c, v in s.items()], F.lit(True))
    return reduce(or_, [one(s) for s in structures]) if structures else F.lit(True)


def in_box(x: str, y: str, low_x: float, low_y: float, high_x: float, high_y: float) -> Column:
    return F.coalesce(F.col(x).between(low_x, high_x) & F.col(y).between(low_y, high_y), F.lit(False))


def value_test(column: str, wanted: str) -> Column:
    """A pattern, if the text holds Han characters, else equality."""
    han = any("一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "\U00020000" <= c <= "\U0002a6df" for c in wanted)
    return F.rlike(F.col(column), F.lit(wanted)) if han else F.col(column) == wanted


def trend_with_peak(trend: DataFrame, measure: str) -> DataFrame:
    """Each bucket with whether it is a peak of the measure."""
    return trend.crossJoin(F.broadcast(trend.agg(F.max(measure).alias("_most")))).withColumn("peak", F.col(measure) == F.col("_most")).drop("_most")


def preferences(rows: DataFrame, user: str, kind: Column, path: str, up: str, down: str, k: int) -> DataFrame:
    """Of each user: the k most called paths with place, calls and category, and the user's upload and download by call and
    upload over download (null without any)."""
    named = rows.select(user, F.col(path).alias("path"), kind.alias("kind"), F.col(up).alias("up"), F.col(down).alias("down"))
    totals = named.groupBy(user).agg(F.count("*").alias("calls"), F.sum("up").alias("u"), F.sum("down").alias("d"))
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("n"), "path"))
    tops = named.groupBy(user, "path", "kind").agg(F.count("*").alias("n")).withColumn("place", place).filter(F.col("place") <= k)
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return tops.join(totals, user).select(user, "place", "path", "kind", "n", r4(F.col("u") / F.col("calls"), "up_a_call"), r4(F.col("d") / F.col("calls"), "down_a_call"), r4(F.col("u") / F.nullif("d", F.lit(0.0)), "up_over_down"))


def grouped_distincts(rows: DataFrame, groups: Sequence[str], counted: Sequence[str]) -> DataFrame:
    """level, name, n and distinct values of each counted column, by each group column alone and over all, in one scan."""
    each = F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("name")), *[F.struct(F.lit(g).alias("level"), F.col(g).cast("string").alias("name")) for g in groups]))
    used = rows.select(*(F.col(c).alias(f"_{c}") for c in counted), each.alias("g"))
    return used.groupBy("g.level", "g.name").agg(F.count("*").alias("n"), *(F.countDistinct(f"_{c}").alias(f"n_{c}") for c in counted))


def session_hours(rows: DataFrame, at: str, zone: str = "UTC") -> DataFrame:
    """Rows of each hour of the day, hours without rows as 0."""
    hours = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(rows.groupBy(F.hour(F.from_utc_timestamp(F.col(at), zone)).alias("hour")).agg(F.count("*").alias("n")), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def top_changers(rows: DataFrame, key: str, order: Sequence[str], value: str, k: int) -> DataFrame:
    """The k keys whose value changes most often from one row to the next (ties by key), with the changes."""
    before = F.col("_before")[value]
    changed = (before.isNotNull() & (before != F.col(value))).cast("int").alias("c")
    return timelines.with_before(timelines.line_of(rows, key, order[0]), order, [value]).select(key, changed).groupBy(key).agg(F.sum("c").alias("n_changes")).orderBy(F.desc("n_changes"), key).limit(k)


def duration_buckets(rows: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Rows under each edge and at or over the edge before; the last bucket has no upper edge. Nulls don't count."""
    name = reduce(lambda out, k: F.when(F.col(value) < edges[k], k).otherwise(out), range(len(edges) - 1, -1, -1), F.lit(len(edges)))
    return rows.filter(F.col(value).isNotNull()).groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))


def change_history(rows: DataFrame, key: str, order: Sequence[str], value: str, most: int) -> DataFrame:
    """Of each key the last `most` different runs of its value, oldest first, joined by commas, and the number of changes.
    Rows without value are left out first, so a value before and after them is one run."""
    known = rows.select(key, *order, value).filter(F.col(value).isNotNull())
    before = F.col("_before")[value]
    runs = timelines.with_before(timelines.line_of(known, key, order[0]), order, [value]).filter(before.isNull() | (before != F.col(value)))
    back = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    placed = runs.withColumn("_k", back)
    names = F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.struct((-F.col("_k")).alias("k"), F.col(value).cast("string").alias("v")))))
    return placed.groupBy(key).agg((F.count("*") - 1).alias("n_changes"), F.array_join(F.transform(names, lambda x: x["v"]), ",").alias("history"))


def nested_tree(rows: DataFrame, levels: Sequence[str], data: Sequence[str] = (), blank: str = "(空)") -> DataFrame:
    """One row a value of the first level with its subtree as JSON: keys by level, leaves as sorted lists; with data columns, the
    leaves' values as aligned lists. Built from below, a level at a time; a subtree is as large as what it shows, and
    tree_paths gives the long form."""
    names = list(levels)
    plain = rows.select(*(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(blank)).alias(c) for c in names), *data).distinct()
    pairs = F.array_sort(F.collect_list(F.struct(names[-1], *data)))
    if data:
        shown = F.to_json(F.struct(F.transform(pairs, lambda p: p[names[-1]]).alias("leaves"), *(_column(pairs, c) for c in data)))
    else:
        shown = F.to_json(F.transform(pairs, lambda p: p[names[-1]]))
    out = plain.groupBy(*names[:-1]).agg(shown.alias("tree"))
    for level in reversed(names[1:-1]):
        keys = names[: names.index(level)]
        entries = F.array_sort(F.collect_list(F.struct(F.col(level).alias("k"), "tree")))
        text = lambda k: F.substr(F.to_json(F.array(k)), F.lit(2), F.length(F.to_json(F.array(k))) - 2)  # noqa: E731  (without the brackets)
        body = F.array_join(F.transform(entries, lambda e: F.concat(text(e["k"]), F.lit(":"), e["tree"])), ",")
        out = out.groupBy(*keys).agg(F.concat(F.lit("{"), body, F.lit("}")).alias("tree"))
    return out


def _column(pairs: Column, name: str) -> Column:
    return F.transform(pairs, lambda p: p[name]).alias(name)


def similar_regions(cells: DataFrame, region: str, token: str, weight: str, wanted: DataFrame, k: int, other: DataFrame | None = None) -> DataFrame:
    """The k regions most like each wanted one (of `other`, another level's cells, if given): wanted, region, cosine of the
    weights, jaccard of the tokens, shared, rank (ties by region). Only wanted regions meet others, on shared tokens."""
    pool = cells if other is None else other
    sums = lambda df: df.groupBy(region).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"), F.count("*").alias("size"))
    asked = cells.join(F.broadcast(bounded(wanted.select(region).distinct())), region)
    left = asked.select(F.col(region).alias("wanted"), token, F.col(weight).alias("w"))
    met = left.join(pool.select(F.col(region).alias("region"), token, F.col(weight).alias("v")), token).filter("wanted <> region" if other is None else "true")
    dots = met.groupBy("wanted", "region").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.count("*").alias("shared"))
    named = dots.join(sums(asked).select(F.col(region).alias("wanted"), F.col("norm").alias("n1"), F.col("size").alias("s1")), "wanted").join(sums(pool).select(F.col(region).alias("region"), F.col("norm").alias("n2"), F.col("size").alias("s2")), "region")
    scored = named.select("wanted", "region", F.round(F.col("dot") / F.nullif(F.col("n1") * F.col("n2"), F.lit(0.0)), 6).alias("cosine"), F.round(F.col("shared") / (F.col("s1") + F.col("s2") - F.col("shared")), 6).alias("jaccard"), "shared")
    place = F.row_number().over(Window.partitionBy("wanted").orderBy(F.desc("cosine"), "region"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


def best_mappings(aligned: DataFrame) -> DataFrame:
    """Both ways: a, b, side (x of a or y of b), token, match (the most frequent counterpart, the smallest on ties), n."""
    one = lambda s, t: aligned.groupBy("a", "b", F.col(s).alias("token")).agg(F.min_by(t, F.struct((-F.col("n")).alias("k"), F.col(t))).alias("match"), F.max("n").alias("n")).withColumn("side", F.lit(s))
    return one("x", "y").unionByName(one("y", "x"))


def contour_points(rows: DataFrame, key: str, order: str, value: str, points: int = 5) -> DataFrame:
    """Of each key: values at `points` even places of its voiced (not null) rows, scaled to 1 to 5 over its range (3 where that
    is 0) and rounded to 2, and the share of voiced rows."""
    own = Window.partitionBy(key)
    voiced = rows.filter(F.col(value).isNotNull())
    placed = voiced.select(key, F.col(value).alias("v"), (F.row_number().over(own.orderBy(order)) - 1).alias("k"), F.count("*").over(own).alias("n"), F.min(value).over(own).alias("lo"), F.max(value).over(own).alias("hi"))
    scaled = F.coalesce(1 + 4 * (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(3.0))
    at = lambda p: F.round(F.max(F.when(F.col("k") == F.round((F.col("n") - 1) * p / (points - 1)), scaled)), 2).alias(f"p{p + 1}")
    share = rows.groupBy(key).agg(F.round(F.count(value) / F.count("*"), 6).alias("voiced_ratio"))
    return share.join(placed.groupBy(key).agg(*(at(p) for p in range(points))), key, "left")


def batch_changes(rows: DataFrame, key: str, creates: DataFrame, updates: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table after the changes that can be made, and the errors: kind, key, error. A create whose key exists (or comes
    twice), an update or delete without its row, and a second update of a key fail; the others are made."""
    have = rows.select(key).distinct().withColumn("_has", F.lit(True))
    numbered = lambda df, kind: df.withColumns({"_kind": F.lit(kind), "_k": F.row_number().over(Window.partitionBy(key).orderBy(*df.columns))}).join(have, key, "left")
    made, changed, gone = numbered(creates, "create"), numbered(updates, "update"), numbered(deletes.select(key), "delete")
    bad = {"create": F.col("_has") | (F.col("_k") > 1), "update": F.col("_has").isNull() | (F.col("_k") > 1), "delete": F.col("_has").isNull() | (F.col("_k") > 1)}
    text = F.when(F.col("_k") > 1, "repeated").when(F.col("_kind") == "create", "exists").otherwise("missing")
    errors = reduce(DataFrame.unionByName, [df.filter(F.coalesce(bad[kind], F.lit(False))).select(F.lit(kind).alias("kind"), key, text.alias("error")) for kind, df in (("create", made), ("update", changed), ("delete", gone))])
    good = lambda df, kind: df.filter(~F.coalesce(bad[kind], F.lit(False))).select(*[c for c in rows.columns if c in df.columns])
    out = rows.join(good(gone, "delete").select(key).unionByName(good(changed, "update").select(key)).distinct(), key, "left_anti")
    kept = good(changed, "update").join(good(gone, "delete").select(key), key, "left_anti")
    return out.unionByName(kept.select(*rows.columns)).unionByName(good(made, "create").select(*rows.columns)), errors


def schema_table(spark: SparkSession, df: DataFrame, keys: Sequence[str] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """position, name, type, required, key and default of each column; Parquet states no keys and defaults, so they are given."""
    rows = [(i, f.name, f.dataType.simpleString(), not f.nullable, f.name in keys, (defaults or {}).get(f.name)) for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "position int, name string, type string, required boolean, key boolean, default string")
