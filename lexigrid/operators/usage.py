"""Usage logs: segments, counters, sessions, retention (survey groups AGG, WIN, ORD, STR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators import timelines


def segments(df: DataFrame, user: str, at: str, steps: list[tuple[str, int, int]], other: str) -> DataFrame:
    """Users by the first step (name, least calls, most idle days) that they meet; idle days count to the last day."""
    last = df.agg(F.max(F.to_date(at)).alias("last"))
    users = df.groupBy(user).agg(F.count("*").alias("calls"), F.max(F.to_date(at)).alias("latest")).crossJoin(F.broadcast(last))
    idle = F.date_diff("last", "latest")
    name = F.coalesce(*[F.when((F.col("calls") >= least) & (idle <= most), F.lit(n)) for n, least, most in steps], F.lit(other))
    return users.select(user, "calls", idle.cast("long").alias("idle_days"), name.alias("segment"))


def eager_newcomers(df: DataFrame, user: str, at: str, days: int, least: int) -> DataFrame:
    """Users with at least `least` rows in their first `days` days."""
    first = F.min(at).over(Window.partitionBy(user))
    early = df.select(user, F.col(at).alias("at"), first.alias("first")).filter(F.col("at") < F.col("first") + F.make_dt_interval(days=F.lit(days)))
    return early.groupBy(user).agg(F.count("*").alias("calls")).filter(F.col("calls") >= least)


def top_cells(df: DataFrame, user: str, path: str, users: int, paths: int) -> DataFrame:
    """Cells of the busiest users and most called paths, with each one's place from 0 (ties by name)."""

    def top(name: str, k: int, place: str) -> DataFrame:
        first = df.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)
        return first.select(name, (F.row_number().over(Window.orderBy(F.desc("n"), name)) - 1).alias(place))

    cells = df.groupBy(user, path).agg(F.count("*").alias("n"))
    return cells.join(F.broadcast(top(user, users, "user_place")), user).join(F.broadcast(top(path, paths, "path_place")), path).select("user_place", "path_place", "n")


def grouping_totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows and sums by each key alone and over all, in long form and one pass: level, name, n, total."""
    each = F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("name")), *[F.struct(F.lit(k).alias("level"), F.col(k).cast("string").alias("name")) for k in keys]))
    return df.select(F.col(value).alias("value"), each.alias("g")).groupBy("g.level", "g.name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def top_values(df: DataFrame, name: str, k: int) -> DataFrame:
    """The k most frequent values with percent of all rows."""
    counts = df.groupBy(name).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), name).limit(k).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("n_all")))).select(name, "n", F.round(F.col("n") * 100.0 / F.col("n_all"), 6).alias("percent"))


def shares_with_top(df: DataFrame, path: str, k: int) -> DataFrame:
    """Each path's percent of all calls, and of the k most called ones' calls for those (else null)."""
    counts = df.groupBy(path).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), path).limit(k)
    sums = counts.agg(F.sum("n").alias("n_all")).crossJoin(top.agg(F.sum("n").alias("n_top")))
    marked = counts.join(F.broadcast(top.select(path, F.lit(True).alias("is_top"))), path, "left").crossJoin(F.broadcast(sums))
    return marked.select(path, "n", F.round(F.col("n") * 100.0 / F.col("n_all"), 6).alias("percent_of_all"), F.when(F.col("is_top"), F.round(F.col("n") * 100.0 / F.col("n_top"), 6)).alias("percent_of_top"))


def conditional_counts(df: DataFrame, tests: dict[str, Column], distinct: str) -> DataFrame:
    """One row: rows that meet each test, all rows, and distinct values of a column."""
    return df.agg(F.count("*").alias("n"), F.countDistinct(distinct).alias("n_distinct"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])


def actives(df: DataFrame, user: str, at: str) -> DataFrame:
    """Distinct users of each day, ISO week and month: unit, bucket, users."""
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(u, F.col(at)).alias("bucket")) for u in ("day", "week", "month")]))
    return df.select(user, units.alias("b")).groupBy("b.unit", "b.bucket").agg(F.countDistinct(user).alias("users"))


def rank_within(df: DataFrame, group: str, user: str, value: str) -> DataFrame:
    """Competition rank of users by total within each group, positive totals only."""
    totals = df.groupBy(group, user).agg(F.round(F.sum(value), 6).alias("total")).filter("total > 0")
    return totals.withColumn("rank", F.rank().over(Window.partitionBy(group).orderBy(F.desc("total"))))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order; the order must be unique."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def kept_newest(df: DataFrame, key: str, order: list[Column], n: int, removable: Column) -> DataFrame:
    """Rows but the oldest removable ones: of each key so many go as it has rows beyond n, if so many can go."""
    own = Window.partitionBy(key)
    marked = df.withColumns({"_out": F.coalesce(removable, F.lit(False)), "_n": F.count("*").over(own)})
    place = F.row_number().over(Window.partitionBy(key, "_out").orderBy(*order))
    return marked.withColumn("_k", place).filter(~(F.col("_out") & (F.col("_k") <= F.col("_n") - n))).drop("_out", "_n", "_k")


def median_filter(df: DataFrame, key: str, order: str, value: str, valid: Column | None = None) -> DataFrame:
    """The median of five values around each valid row (those with a value, unless given) inside its unbroken run of valid
    rows; beyond the run's ends the values are 0. Rows that aren't valid have none and give no row."""
    good = F.col(value).isNotNull() & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    marked = df.select(key, order, value, good.alias("_good")).withColumn("_run", F.sum((~F.col("_good")).cast("int")).over(Window.partitionBy(key).orderBy(order)))
    own = Window.partitionBy(key, "_run").orderBy(order)
    near = lambda k: F.coalesce(F.lag(value, k, 0.0).over(own) if k > 0 else F.lead(value, -k, 0.0).over(own), F.lit(0.0))
    around = F.array_sort(F.array(*[near(k) for k in (2, 1, 0, -1, -2)]))
    return marked.filter("_good").select(key, order, F.element_at(around, 3).alias("median"))


def every_nth(df: DataFrame, key: str, order: str, factor: int) -> DataFrame:
    """Rows 1, factor + 1, ... of each key."""
    placed = timelines.with_running(timelines.line_of(df, key, order), [order], F.lit(1), "_k")
    return placed.filter((F.col("_k") - 1) % factor == 0).select(*df.columns)


def capped(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most so many rows, each with whether there were more."""
    first = df.orderBy(*order).limit(most + 1)
    more = first.agg((F.count("*") > most).alias("truncated"))
    return first.orderBy(*order).limit(most).crossJoin(F.broadcast(more))


def day_and_all_time(df: DataFrame, path: str, at: str) -> DataFrame:
    """Visits by path and day, and by path over all time (day is null)."""
    days = F.explode(F.array(F.to_date(at), F.lit(None).cast("date")))
    return df.select(path, days.alias("day")).groupBy(path, "day").agg(F.count("*").alias("n"))


def recent_attempts(df: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Rows of the key in so many seconds before each row, the row's own instant left out."""
    return timelines.counts_within(df, key, at, seconds, "attempts", own_time=False)


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """How often a key's value differs from that of the row before, and the number of different values."""
    rows = timelines.with_before(timelines.line_of(df, key, order[0]), order, [value])
    before = F.col("_before")[value]
    return rows.select(key, F.col(value).alias("v"), (before.isNotNull() & (before != F.col(value))).cast("int").alias("c")).groupBy(key).agg(F.sum(F.coalesce("c", F.lit(0))).alias("n_changes"), F.countDistinct("v").alias("n_values"))


def within_capacity(df: DataFrame, group: str, order: list[Column], size: str, capacity: int) -> DataFrame:
    """Rows of each group, newest first, while their sizes add up to at most the capacity."""
    running = F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", running).filter(F.col("running") <= capacity)


def time_line(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Tables (frame, id, time) as one long table: kind, id, at."""
    out = None
    for kind, (df, key, at) in parts.items():
        rows = df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(at).alias("at"))
        out = rows if out is None else out.unionByName(rows)
    return out


def contours(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Of each key's series: first, last, least, largest and mean value, range, and slope over the row number."""
    line = timelines.line_of(df.filter(F.col(value).isNotNull()).select(key, order, F.col(value).alias("v")), key, order)
    rows = timelines.with_running(line, [order], F.lit(1), "k").withColumn("k", F.col("k").cast("double"))
    r6 = lambda c: F.round(c, 6)
    return rows.groupBy(key).agg(
        r6(F.min_by("v", order)).alias("first"), r6(F.max_by("v", order)).alias("last"), r6(F.min("v")).alias("least"), r6(F.max("v")).alias("most"), r6(F.avg("v")).alias("mean"), r6(F.max("v") - F.min("v")).alias("range"), r6(F.regr_slope("v", "k")).alias("slope")
    )
