"""Counts, shares, contingency tables and usage analytics (survey groups AGG, JOIN, WIN)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators import timelines
from lexigrid.sources.tables import Rounds


def with_running(df: DataFrame, value: str, n: str, descending: bool = False, parts: int = 64, group: str | None = None) -> DataFrame:
    """df has a row for each value (of each group, whose number is small); adds before, the sum of n over smaller (or larger)
    values, and beside, the next value on that side. Values are cut into ranges at approximate percentiles, so no task
    orders more than a range; the table of ranges has at most parts + 1 rows a group. Texts (without group) are cut at values
    of a sample by hash."""
    keyed = df.withColumn("_group", F.col(group) if group else F.lit(0))
    if dict(df.dtypes)[value] == "string":
        some = df.select(value).filter(F.col(value).isNotNull()).orderBy(F.xxhash64(value), value).limit(16 * parts).collect()
        found = [(0, sorted(r[0] for r in some)[16::16])]
    else:
        found = keyed.groupBy("_group").agg(F.percentile_approx(value, F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(10_000))).collect()
    spot = F.lit(0)
    for name, values in found:
        cuts = F.array(*map(F.lit, sorted(set(values or []))))
        spot = F.when(F.col("_group").eqNullSafe(F.lit(name)), F.size(F.filter(cuts, lambda c: c < F.col(value)))).otherwise(spot) if values else spot
    along = lambda c: F.desc(c) if descending else F.asc(c)
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_group", "_range").orderBy(along(value))
    rows = keyed.withColumn("_range", spot).withColumns({"_in": F.coalesce(F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_next": F.lag(value).over(inside)})
    ranges = rows.groupBy("_group", "_range").agg(F.sum(n).alias("_n"), (F.min if descending else F.max)(value).alias("_end"))
    order = Window.partitionBy("_group").orderBy(along("_range"))
    ranges = ranges.select("_group", "_range", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lag("_end").over(order).alias("_edge"))
    joined = rows.join(F.broadcast(ranges), ["_group", "_range"])
    return joined.select(*df.columns, (F.col("_base") + F.col("_in")).alias("before"), F.coalesce("_next", "_edge").alias("beside"))


def feature_values(df: DataFrame, keys: list[str], features: list[str], item: str) -> DataFrame:
    """Distinct items per key, feature and value. Each feature reads its own columns and shuffles its distinct rows once;
    the rows aren't multiplied by the features."""
    parts = []
    for f in features:
        rows = df.select(*keys, item, f).filter(F.col(f).isNotNull() & F.col(item).isNotNull()).distinct()
        parts.append(rows.groupBy(*keys, F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")).agg(F.count("*").alias("n_items")))
    return reduce(DataFrame.unionByName, parts)


def roll_up(counts: DataFrame, key: str) -> DataFrame:
    """Counts of feature values over all keys: total, number of keys, sorted list of keys."""
    return counts.groupBy("feature", "value").agg(F.sum("n_items").alias("total"), F.count("*").alias("n_keys"), F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), ",").alias("keys"))


def feature_statistics(df: DataFrame, key: str, feature: str, item: str, mark: str) -> DataFrame:
    """Items of a feature value: number, share of the key's items (4 places), and how many have a mark from 1 to 3, have
    mark 2, have mark 3, have both."""
    has = lambda test, name: F.max(F.coalesce(test, F.lit(False)).cast("int")).alias(name)
    each = df.groupBy(key, feature, item).agg(has(F.col(mark).between(1, 3), "m"), has(F.col(mark) == 2, "m2"), has(F.col(mark) == 3, "m3"))
    cells = each.groupBy(key, feature).agg(F.count("*").alias("n_items"), F.sum("m").alias("n_several"), F.sum("m2").alias("n_second"), F.sum("m3").alias("n_third"), F.sum(F.col("m2") * F.col("m3")).alias("n_both"))
    totals = each.select(key, item).distinct().groupBy(key).agg(F.count(item).alias("n_all"))
    return cells.join(totals, key).withColumn("ratio", F.round(F.col("n_items") / F.col("n_all"), 4))


def contingency_long(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """Each cell's distinct items, a row for each: for cells of any size."""
    return df.select(*by, item).filter(F.col(item).isNotNull()).distinct()


def contingency(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """Sorted distinct items of each cell, comma-joined, and their number."""
    cells = df.groupBy(*by).agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))
    return cells.select(*by, F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))


def nested_shares(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of each pair, percent of its first level, and percent of that level in all."""
    pairs = df.groupBy(first, second).agg(F.count("*").alias("n"))
    level = Window.partitionBy(first)
    totals = pairs.groupBy(first).agg(F.sum("n").alias("n_first"))
    everything = totals.agg(F.sum("n_first").alias("n_all"))
    out = pairs.withColumn("share_second", F.round(F.col("n") * 100.0 / F.sum("n").over(level), 6))
    return out.join(totals.crossJoin(F.broadcast(everything)).select(first, F.round(F.col("n_first") * 100.0 / F.col("n_all"), 6).alias("share_first")), first)


def several_values(df: DataFrame, key: str, columns: list[str], least: int = 2) -> DataFrame:
    """Keys with at least `least` different combinations of the columns; a null is a value of its own."""
    return df.groupBy(key).agg(F.countDistinct(F.struct(*columns)).alias("n_values")).filter(F.col("n_values") >= least)


def level_counts(df: DataFrame, levels: list[str]) -> DataFrame:
    """Rows under each prefix of the levels, in one pass of grouping sets; deeper levels are null."""
    return df.rollup(*levels).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("depth"))


def flag_matrix(df: DataFrame, key: str, flags: dict[str, Column], measure: Column) -> DataFrame:
    """Percent of each flag and the mean measure per key."""
    shares = [F.round(F.sum(F.coalesce(c.cast("int"), F.lit(0))) * 100.0 / F.count("*"), 6).alias(k) for k, c in flags.items()]
    return df.groupBy(key).agg(F.count("*").alias("n"), *shares, F.round(F.avg(measure), 6).alias("mean_measure"))


def tendency(df: DataFrame, region: str, token: str) -> DataFrame:
    """How much a region favours a token: frequency against the rest, lift, log10 odds (add-one) and z of two shares."""
    cells = df.groupBy(region, token).agg(F.count("*").cast("double").alias("a"))
    regions = cells.groupBy(region).agg(F.sum("a").alias("n_region"))
    tokens = cells.groupBy(token).agg(F.sum("a").alias("n_token"))
    everything = regions.agg(F.sum("n_region").alias("n"))
    a, r, t, n = (F.col(c) for c in ("a", "n_region", "n_token", "n"))
    p, rest = t / n, n - r
    pooled = F.sqrt(p * (1 - p) * (1 / r + 1 / F.nullif(rest, F.lit(0.0))))
    return (
        cells.join(regions, region)
        .join(tokens, token)
        .crossJoin(F.broadcast(everything))
        .select(
            region,
            token,
            a.cast("long").alias("n_cell"),
            F.round((a / r) / p, 6).alias("lift"),
            F.round(F.log10((a + 1) * (rest - t + a + 1) / ((r - a + 1) * (t - a + 1))), 6).alias("log_odds"),
            F.round((a / r - (t - a) / F.nullif(rest, F.lit(0.0))) / F.nullif(pooled, F.lit(0.0)), 6).alias("z"),
        )
    )


def significance(df: DataFrame, region: str, token: str) -> DataFrame:
    """Chi-square of the 2x2 table of a region and a token, exp(-chi2 / 2) as an approximation of p, and the effect
    sqrt(chi2 / n)."""
    cells = df.groupBy(region, token).agg(F.count("*").cast("double").alias("a"))
    regions = cells.groupBy(region).agg(F.sum("a").alias("r"))
    tokens = cells.groupBy(token).agg(F.sum("a").alias("t"))
    joined = cells.join(regions, region).join(tokens, token).crossJoin(F.broadcast(regions.agg(F.sum("r").alias("n"))))
    b, c = F.col("r") - F.col("a"), F.col("t") - F.col("a")
    d = F.col("n") - F.col("r") - c
    chi = F.col("n") * F.pow(F.col("a") * d - b * c, F.lit(2.0)) / F.nullif(F.col("r") * (F.col("n") - F.col("r")) * F.col("t") * (F.col("n") - F.col("t")), F.lit(0.0))
    return joined.select(region, token, F.round(chi, 6).alias("chi_square"), F.round(F.exp(-chi / 2), 6).alias("p"), F.round(F.sqrt(chi / F.col("n")), 6).alias("effect"))


def inventory(df: DataFrame, key: str, token: str, item: str) -> DataFrame:
    """Share and rank percent of each token in its key's inventory, ordered by distinct items, then token."""
    counts = df.groupBy(key, token).agg(F.countDistinct(item).alias("n_items"))
    own = Window.partitionBy(key)
    place = F.row_number().over(own.orderBy(F.desc("n_items"), token)) - 1
    return counts.select(key, token, "n_items", F.round(F.col("n_items") / F.sum("n_items").over(own), 6).alias("share"), F.round(place / F.greatest(F.count("*").over(own) - 1, F.lit(1)), 6).alias("rank_percent"))


def entropy(df: DataFrame, key: str, category: str, bits: float = 2.0) -> DataFrame:
    """Shannon entropy in bits of a key's categories, and whether it exceeds `bits`."""
    counts = df.groupBy(key, category).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    value = counts.withColumn("p", p).groupBy(key).agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("entropy"), F.sum("n").alias("n"))
    return value.withColumn("explorer", F.col("entropy") > bits)


def nearest_rank(df: DataFrame, key: str, value: str, percents: list[int], slow: float | None = None) -> DataFrame:
    """Mean and nearest-rank percentiles: the value at position ceil(p/100 * n), at least the first; slow: also the share of
    values above it. Equal values are counted first, so a key's window holds its distinct values and not its rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("k"))
    own = Window.partitionBy(key)
    ranked = counts.withColumns({"upto": F.sum("k").over(own.orderBy(value)), "n": F.sum("k").over(own)})
    picks = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("n") * F.lit(p) / 100), F.lit(1)), F.col(value))).alias(f"p{p}") for p in percents]
    above = [] if slow is None else [F.round(F.sum(F.when(F.col(value) > slow, F.col("k")).otherwise(0)) / F.sum("k"), 6).alias("slow_ratio")]
    return ranked.groupBy(key).agg(F.sum("k").alias("n"), F.round(F.sum(F.col(value) * F.col("k")) / F.sum("k"), 6).alias("mean"), *picks, *above)


def trend(df: DataFrame, at: str, unit: str, user: str, path: str, value: str) -> DataFrame:
    """Calls, users, mean value and the most frequent path (smallest on ties) of each time bucket."""
    bucket = F.date_trunc(unit, at).alias("bucket")
    paths = df.groupBy(bucket, path).agg(F.count("*").alias("n")).groupBy("bucket").agg(F.min_by(path, F.struct(-F.col("n"), F.col(path))).alias("top_path"))
    return df.groupBy(bucket).agg(F.count("*").alias("calls"), F.countDistinct(user).alias("users"), F.round(F.avg(value), 6).alias("mean_value")).join(paths, "bucket")


def growth(df: DataFrame, at: str, key: str) -> DataFrame:
    """New keys of each month (by first appearance), running total, and growth on the month before in percent."""
    new = df.groupBy(key).agg(F.date_trunc("month", F.min(at)).alias("month")).groupBy("month").agg(F.count("*").alias("n_new"))
    order = Window.orderBy("month")
    before = F.lag("n_new").over(order)
    return new.select("month", "n_new", F.sum("n_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.round((F.col("n_new") - before) * 100.0 / before, 6).alias("growth"))


def ranking(df: DataFrame, key: str, value: str, user: str) -> DataFrame:
    """Competition rank by total, distinct users, gap to the next larger total, percent of the first and of all (null where
    those are 0). Different totals are ranked by ranges, so no task orders all of them. Totals are added up once and written: a sum
    of doubles depends on the order of its rows, so two runs of it needn't meet in a join."""
    totals = Rounds(df.sparkSession).written(df.groupBy(key).agg(F.round(F.sum(value), 6).alias("total"), F.countDistinct(user).alias("users")), "totals")
    steps = with_running(totals.filter("total IS NOT NULL").groupBy("total").agg(F.count("*").alias("n")), "total", "n", descending=True)
    steps = steps.select("total", (F.col("before") + 1).cast("int").alias("rank"), F.col("beside").alias("larger"))
    top = totals.agg(F.max("total").alias("most"), F.sum("total").alias("all"))
    percent = lambda of: F.round(F.col("total") * 100 / F.nullif(F.col(of), F.lit(0)), 4)
    ranked = totals.join(steps, "total").crossJoin(F.broadcast(top))
    return ranked.select(key, "total", "users", "rank", F.round(F.col("larger") - F.col("total"), 4).alias("gap"), percent("most").alias("percent_of_first"), percent("all").alias("percent_of_all"))


def rfm(df: DataFrame, user: str, at: str, value: str) -> DataFrame:
    """Recency (days before the last day), frequency and value of each user with scores 1 to 5 by nearest-rank
    quintile thresholds (recency reversed) and a segment of the three. Thresholds come from counts of equal values, added
    up by ranges."""
    last = df.agg(F.max(F.to_date(at)).alias("last"))
    users = df.groupBy(user).agg(F.max(F.to_date(at)).alias("latest"), F.count("*").alias("frequency"), F.round(F.sum(value), 6).alias("monetary"))
    users = users.crossJoin(F.broadcast(last)).select(user, F.date_diff("last", "latest").cast("long").alias("recency"), "frequency", "monetary")
    measures = ("recency", "frequency", "monetary")
    long = users.select(*(F.col(c).cast("double").alias(c) for c in measures)).unpivot([], list(measures), "name", "value").filter("value IS NOT NULL")
    spread = with_running(long.groupBy("name", "value").agg(F.count("*").alias("n")), "value", "n", group="name")
    sizes = long.groupBy("name").agg(F.count("*").alias("n_users"))
    reached = (F.col("before") + F.col("n")) * 5
    cuts = spread.join(F.broadcast(sizes), "name").agg(*(F.min(F.when((F.col("name") == c) & (reached >= x * F.col("n_users")), F.col("value"))).alias(f"{c}{x}") for c in measures for x in range(1, 5)))
    scored = users.crossJoin(F.broadcast(cuts))
    rise = lambda c: sum((F.col(c) > F.col(f"{c}{x}")).cast("int") for x in range(1, 5)) + 1
    scored = scored.select(user, "recency", "frequency", "monetary", (6 - rise("recency")).alias("r"), rise("frequency").alias("f"), rise("monetary").alias("m"))
    segment = F.when((F.col("r") >= 4) & (F.col("f") >= 4), "champion").when(F.col("f") >= 4, "loyal").when(F.col("r") >= 4, "recent").when((F.col("r") <= 2) & (F.col("f") <= 2), "lost").when(F.col("r") <= 2, "at risk").otherwise("middle")
    return scored.withColumn("segment", segment)


def segment_averages(scored: DataFrame) -> DataFrame:
    """Users and mean recency, frequency and value of each segment of rfm()."""
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return scored.groupBy("segment").agg(F.count("*").alias("users"), mean("recency"), mean("frequency"), mean("monetary"))


def outliers(df: DataFrame, user: str) -> DataFrame:
    """Users whose number of calls exceeds the mean by three sample deviations; high above five."""
    calls = df.groupBy(user).agg(F.count("*").alias("calls"))
    norm = calls.agg(F.avg("calls").alias("mean"), F.stddev_samp("calls").alias("sd"))
    z = (F.col("calls") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return calls.crossJoin(F.broadcast(norm)).filter(F.col("calls") > F.col("mean") + 3 * F.col("sd")).select(user, "calls", F.round(z, 6).alias("z"), F.when(z > 5, "high").otherwise("medium").alias("severity"))


def one_sided(df: DataFrame, user: str, path: str, least: float) -> DataFrame:
    """Users for whom one path has at least this share of all calls."""
    counts = df.groupBy(user, path).agg(F.count("*").alias("n"))
    total = counts.groupBy(user).agg(F.sum("n").alias("calls"), F.max("n").alias("most"), F.min_by(path, F.struct(-F.col("n"), F.col(path))).alias("top_path"))
    return total.filter(F.col("most") >= least * F.col("calls")).select(user, "calls", "top_path", F.round(F.col("most") / F.col("calls"), 6).alias("share"))


def zero_filled(users: DataFrame, usage: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """Every user with the number and sum of its usage, 0 without any."""
    totals = usage.groupBy(F.col(right).alias(left)).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return users.select(left).join(totals, left, "left").select(left, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def heat_map(df: DataFrame, at: str) -> DataFrame:
    """Rows by weekday (Sunday is 0) and hour."""
    return df.groupBy((F.dayofweek(at) - 1).alias("weekday"), F.hour(at).alias("hour")).agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group by row number, with the number as rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def standard_scores(df: DataFrame, key: str, value: str) -> DataFrame:
    """z of each key's mean value against all keys; null with fewer than three keys or where all means are equal."""
    means = df.groupBy(key).agg(F.avg(value).alias("mean"))
    norm = means.agg(F.avg("mean").alias("mu"), F.stddev_samp("mean").alias("sd"), F.count("*").alias("n"))
    return means.crossJoin(F.broadcast(norm)).select(key, F.round("mean", 6).alias("mean"), F.when(F.col("n") >= 3, F.round((F.col("mean") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)), 6)).alias("z"))


def runs(df: DataFrame, key: str, order: str, flag: Column, least: int) -> DataFrame:
    """Runs of at least `least` consecutive rows for which the flag holds (gaps and islands)."""
    return timelines.islands(df, key, order, flag, least)


def sliding_count(df: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Rows of the key in the window of so many seconds that ends with each row."""
    return timelines.counts_within(df, key, at, seconds, "in_window")


def active_time(df: DataFrame, key: str, at: str, idle: int) -> DataFrame:
    """Seconds between a key's consecutive rows, gaps over `idle` seconds left out."""
    timed = df.select(key, timelines.micros(F.col(at)).alias("_t"))
    gap = (F.col("_t") - F.col("_before._t")) / 1e6
    rows = timelines.with_before(timelines.laid(timed, key, "_t"), ["_t"], ["_t"]).select(key, gap.alias("gap"))
    return rows.groupBy(key).agg(F.round(F.sum(F.when(F.col("gap") <= idle, F.col("gap")).otherwise(0.0)), 3).alias("seconds"), F.count("*").alias("n"))


def overview(df: DataFrame, user: str, kind: str, at: str) -> DataFrame:
    """One row: rows, different users and kinds, first and last time."""
    return df.agg(F.count("*").alias("n"), F.countDistinct(user).alias("users"), F.countDistinct(kind).alias("types"), F.min(at).alias("first"), F.max(at).alias("last"))


def items_by_class(rows: DataFrame, classes: DataFrame, on: Column, keys: list[str], item: str) -> DataFrame:
    """Different items of each combination of keys over rows joined with their classes."""
    return rows.join(classes, on).groupBy(*keys).agg(F.countDistinct(item).alias("n_parts"))
