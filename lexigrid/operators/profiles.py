"""Region profiles, village subsets and characters, vectors of regions (survey groups AGG, WIN, ORD, JOIN, FLT, ADV).

A village row has an id, a name and columns of its regions; flags are boolean columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.structures import bounded


def _percent(part: Column, whole: Column, places: int = 2) -> Column:
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), places)


def region_aggregates(rows: DataFrame, region: str, name: str, intensities: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Of each region: different names, mean name length, and for each category its percent (the intensity times 100, 0
    without one) and the number of names it stands for, cut to a whole one.

    intensities: region, category, intensity, a row for each pair (the smallest counts, if there are several)."""
    base = rows.groupBy(region).agg(F.countDistinct(name).alias("n_names"), F.round(F.avg(F.length(name)), 6).alias("mean_length"))
    wide = intensities.groupBy(F.col("region").alias(region)).pivot("category", list(categories)).agg(F.min("intensity"))
    pct = {c: F.round(F.coalesce(F.col(c), F.lit(0.0)) * 100, 6) for c in categories}
    columns = [x for c in categories for x in (pct[c].alias(f"{c}_pct"), F.floor(pct[c] / 100 * F.col("n_names")).cast("long").alias(f"{c}_count"))]
    return base.join(wide, region, "left").select(region, "n_names", "mean_length", *columns)


def flag_profile(rows: DataFrame, region: str, flags: dict[str, Column]) -> DataFrame:
    """Of each region and flag: rows with it, percent, percent among all rows, lift (null where that is 0), and z of the
    percent among the regions (0 where all are equal, null with fewer than three). Flags are counted in one scan."""
    counted = rows.groupBy(region).agg(F.count("*").alias("n_rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()))
    long = counted.unpivot([region, "n_rows"], list(flags), "flag", "n")
    over = long.groupBy("flag").agg(F.sum("n").alias("n_all"), F.sum("n_rows").alias("rows_all"), F.avg(_percent(F.col("n"), F.col("n_rows"))).alias("mu"), F.stddev_samp(_percent(F.col("n"), F.col("n_rows"))).alias("sd"), F.count("*").alias("k"))
    own, every = _percent(F.col("n"), F.col("n_rows")), _percent(F.col("n_all"), F.col("rows_all"))
    z = F.when(F.col("k") >= 3, F.coalesce(F.round((own - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)), 4), F.lit(0.0)))
    return long.join(F.broadcast(over), "flag").select(region, "flag", "n", own.alias("percent"), every.alias("global_percent"), F.round(own / F.nullif(every, F.lit(0.0)), 3).alias("lift"), z.alias("z"))


def suffix_profile(rows: DataFrame, region: str, suffix: str, k: int) -> DataFrame:
    """Of each region the suffixes that are among its k most frequent or its k of highest lift: n, percent, lift, and both
    places (ties by suffix). Empty suffixes don't count. Counts are combined before any window."""
    used = rows.filter(F.col(suffix) != "").groupBy(region, suffix).agg(F.count("*").alias("n"))
    own = used.groupBy(region).agg(F.sum("n").alias("n_region"))
    every = used.groupBy(suffix).agg(F.sum("n").alias("n_suffix"))
    total = every.agg(F.sum("n_suffix").alias("n_all"))
    cells = used.join(own, region).join(every, suffix).crossJoin(F.broadcast(total))
    pct, all_ = _percent(F.col("n"), F.col("n_region")), _percent(F.col("n_suffix"), F.col("n_all"))
    cells = cells.select(region, suffix, "n", pct.alias("percent"), F.round(pct / F.nullif(all_, F.lit(0.0)), 3).alias("lift"))
    by = Window.partitionBy(region)
    placed = cells.withColumns({"by_count": F.row_number().over(by.orderBy(F.desc("n"), suffix)), "by_lift": F.row_number().over(by.orderBy(F.desc(F.coalesce("lift", F.lit(0.0))), suffix))})
    return placed.filter((F.col("by_count") <= k) | (F.col("by_lift") <= k))


def diversity(rows: DataFrame, region: str, suffix: str) -> DataFrame:
    """Entropy (natural logarithm, shares of at least 0.001) and number of the suffixes of each region."""
    counts = rows.filter(F.col(suffix) != "").groupBy(region, suffix).agg(F.count("*").alias("n"))
    share = F.greatest(F.col("n") / F.sum("n").over(Window.partitionBy(region)), F.lit(0.001))
    return counts.select(region, (-share * F.ln(share)).alias("h")).groupBy(region).agg(F.round(F.sum("h"), 4).alias("suffix_entropy"), F.count("*").alias("n_suffixes"))


def level_significance(rows: DataFrame, level: str, region: str, p: str, before: str, alpha: float = 0.05) -> DataFrame:
    """Of each level: rows, rows of p under alpha, the regions' totals before filtering (each region's different totals
    once), and the percent of those that is significant; a level without totals takes its rows."""
    totals = rows.select(level, region, before).distinct().groupBy(level).agg(F.sum(before).alias("before"))
    counts = rows.groupBy(level).agg(F.count("*").alias("n"), F.count_if(F.col(p) < alpha).alias("significant"))
    whole = F.coalesce(F.nullif("before", F.lit(0)), F.col("n"))
    return counts.join(totals, level).select(level, "n", "significant", whole.cast("long").alias("before"), F.round(F.col("significant") * 100.0 / whole, 1).alias("rate"))


def integration_summary(rows: DataFrame, token: str, cluster: str, tendency: str, flag: Column) -> DataFrame:
    """kind (all, token or cluster), name, rows, mean tendency and flagged rows, in one scan of grouping by each."""
    each = F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("token").alias("kind"), F.col(token).cast("string").alias("name")), F.struct(F.lit("cluster").alias("kind"), F.col(cluster).cast("string").alias("name"))))
    used = rows.select(F.col(tendency).alias("t"), flag.alias("f"), each.alias("g"))
    return used.groupBy("g.kind", "g.name").agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("mean"), F.count_if(F.coalesce("f", F.lit(False))).alias("flagged"))


def cluster_list(rows: DataFrame, cluster: str, token: str, tendency: str, flag: Column, least: int) -> DataFrame:
    """Clusters with at least `least` flagged rows: tokens, greatest and mean tendency, flagged rows."""
    flagged = F.count_if(F.coalesce(flag, F.lit(False)))
    return rows.groupBy(cluster).agg(F.countDistinct(token).alias("n_tokens"), F.max(tendency).alias("most"), F.round(F.avg(tendency), 6).alias("mean"), flagged.alias("flagged")).filter(F.col("flagged") >= least)


def category_means(rows: DataFrame, category: str, value: str) -> DataFrame:
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def significance_summary(rows: DataFrame, region: str, p: str, effect: str) -> DataFrame:
    """Of each region: rows, those of p under 0.05, 0.01 and 0.001, mean and greatest effect."""
    under = lambda a, name: F.count_if(F.col(p) < a).alias(name)
    return rows.groupBy(region).agg(F.count("*").alias("n"), under(0.05, "at_5"), under(0.01, "at_1"), under(0.001, "at_01"), F.round(F.avg(effect), 6).alias("mean_effect"), F.max(effect).alias("most_effect"))


def compared_counts(first: DataFrame, second: DataFrame, name: str, tail: int, k: int) -> DataFrame:
    """Shares of name lengths, and of endings of `tail` characters that are among a side's k most frequent, of two subsets
    side by side: kind, value, first, second; 0 where a side lacks it."""

    def shares(df: DataFrame, side: str) -> DataFrame:
        named = df.filter(F.length(name) > 0)
        length = named.groupBy(F.length(name).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("length").alias("kind"), "value", "n")
        ends = named.groupBy(F.right(F.col(name), F.lit(tail)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k).select(F.lit("ending").alias("kind"), "value", "n")
        both = length.unionByName(ends).crossJoin(F.broadcast(named.agg(F.count("*").alias("n_all"))))
        return both.select("kind", "value", F.round(F.col("n") / F.col("n_all"), 6).alias(side))

    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return shares(first, "first").join(shares(second, "second"), ["kind", "value"], "full").select("kind", "value", zero("first"), zero("second"))


def compared_characters(first: DataFrame, second: DataFrame, name: str, k: int) -> DataFrame:
    """Characters among the k most frequent of either subset (ties by character), with both shares, difference and lift, the
    widest differences first."""

    def shares(df: DataFrame, side: str) -> DataFrame:
        counts = df.select(F.explode(F.filter(F.split(F.coalesce(name, F.lit("")), ""), lambda c: (c != "") & ~F.rlike(c, F.lit(r"\s")))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n").alias("n_all"))
        return counts.crossJoin(F.broadcast(total)).select("char", (F.col("n") / F.col("n_all")).alias(side))

    a, b = shares(first, "p"), shares(second, "q")
    top = a.orderBy(F.desc("p"), "char").limit(k).select("char").union(b.orderBy(F.desc("q"), "char").limit(k).select("char")).distinct()
    met = top.join(a, "char", "left").join(b, "char", "left").select("char", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return met.select("char", r6("p", "first"), r6("q", "second"), r6(F.col("p") - F.col("q"), "difference"), r6(F.col("p") / F.nullif("q", F.lit(0.0)), "lift")).orderBy(F.desc(F.abs("difference")), "char")


def character_lifts(rows: DataFrame, region: str, name: str) -> DataFrame:
    """region, char, n (names of the region that hold it), lift (its share there over its share in all), with each name's
    characters once."""
    chars = F.array_distinct(F.filter(F.split(F.coalesce(name, F.lit("")), ""), lambda c: (c != "") & ~F.rlike(c, F.lit(r"\s"))))
    sizes = rows.groupBy(region).agg(F.count("*").alias("n_region"))
    cells = rows.select(region, F.explode(chars).alias("char")).groupBy(region, "char").agg(F.count("*").alias("n"))
    every = cells.groupBy("char").agg(F.sum("n").alias("n_char"))
    total = sizes.agg(F.sum("n_region").alias("n_all"))
    met = cells.join(sizes, region).join(every, "char").crossJoin(F.broadcast(total))
    return met.select(region, "char", "n", F.round((F.col("n") / F.col("n_region")) / (F.col("n_char") / F.col("n_all")), 6).alias("lift"))


def top_features(cells: DataFrame, region: str, token: str, metric: str, k: int) -> DataFrame:
    """The k tokens of each region of the largest metric (ties by token), duplicates first reduced to the largest, in long
    form: region, token, metric, rank."""
    best = cells.groupBy(region, token).agg(F.max(metric).alias(metric))
    place = F.row_number().over(Window.partitionBy(region).orderBy(F.desc(metric), token))
    return best.withColumn("rank", place).filter(F.col("rank") <= k)


def feature_matrix(tops: DataFrame, region: str, token: str, metric: str, tokens: Sequence[str]) -> DataFrame:
    """A column for each token, 0 where a region lacks it."""
    return tops.groupBy(region).pivot(token, list(tokens)).agg(F.max(metric)).na.fill(0.0)


def globally_ranked(cells: DataFrame, columns: list[str], metric: str, k: int) -> DataFrame:
    """The first k different rows by the metric, numbered: the order is taken of k rows a task, not of all."""
    top = cells.select(*columns, metric).distinct().orderBy(F.desc(metric), *columns).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), *columns)))


def best_of(cells: DataFrame, key: str, metric: str, largest: bool = True) -> DataFrame:
    """The row of the best metric by key (the least other columns on ties)."""
    rest = [c for c in cells.columns if c not in (key, metric)]
    order = F.struct((-F.col(metric) if largest else F.col(metric)).alias("m"), *rest)
    return cells.filter(F.col(metric).isNotNull()).groupBy(key).agg(F.min_by(F.struct(metric, *rest), order).alias("b")).select(key, "b.*")


def village_subset(rows: DataFrame, key: str, ids: list | None = None, regions: dict[str, list] | None = None, tags: Sequence[Column] = (), like: tuple[str, str] | None = None, sample: int | None = None) -> DataFrame:
    """Rows of the ids, of the regions, with all tags and with a text in a column; sample: so many by a hash of the key."""
    out = rows
    if ids is not None:
        out = out.filter(F.col(key).isin(ids))
    for column, values in (regions or {}).items():
        out = out.filter(F.col(column).isin(values))
    for tag in tags:
        out = out.filter(F.coalesce(tag, F.lit(False)))
    if like:
        out = out.filter(F.contains(like[0], F.lit(like[1])))
    return out if sample is None else out.orderBy(F.md5(F.col(key).cast("string")), key).limit(sample)


def with_optional(rows: DataFrame, key: str, others: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """Left joins by key of only those tables that a filter is given for; the filters hold for the joined columns."""
    out = rows
    for other, test in others.values():
        if test is not None:
            out = out.join(other, key, "left").filter(F.coalesce(test, F.lit(False)))
    return out


def detail(rows: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Each row with the rows of the same key in other tables as structs, null where there is none. parts: at most a row for
    each key."""
    out = rows
    for name, part in parts.items():
        out = out.join(part.select(key, F.struct(*[c for c in part.columns if c != key]).alias(name)), key, "left")
    return out


def vector_by_category(rows: DataFrame, region: str, category: str, value: str, categories: Sequence[str]) -> DataFrame:
    """The values of the categories in order as one vector by region, 0 where there is none."""
    each = [F.coalesce(F.sum(F.when(F.col(category) == c, F.col(value))), F.lit(0.0)) for c in categories]
    return rows.groupBy(region).agg(F.array(*each).alias("vector"))


def compared_vectors(a: Column, b: Column) -> Column:
    """Struct of cosine (0 where a vector is zero), euclid, manhattan, and the difference vector."""
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, z: s + z)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, z: s + z * z))
    cosine = F.coalesce(total(lambda x, y: x * y) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))
    return F.struct(F.round(cosine, 6).alias("cosine"), F.round(F.sqrt(total(lambda x, y: (x - y) * (x - y))), 6).alias("euclid"), F.round(total(lambda x, y: F.abs(x - y)), 6).alias("manhattan"), F.zip_with(a, b, lambda x, y: F.round(x - y, 6)).alias("difference"))


def similar_to(vectors: DataFrame, key: str, vector: str, wanted: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """The k rows of the largest cosine (at least `least`) to each wanted key's vector: wanted, key, cosine, rank. The wanted
    keys are those of a request, few (5,000 at most); all vectors are read once."""
    v = vectors.select(key, F.col(vector).cast("array<double>").alias("v"))
    asked = v.join(F.broadcast(bounded(wanted.select(F.col(key)).distinct())), key).select(F.col(key).alias("wanted"), F.col("v").alias("q"))
    met = v.crossJoin(F.broadcast(asked)).filter(F.col(key) != F.col("wanted")).select("wanted", key, compared_vectors(F.col("v"), F.col("q"))["cosine"].alias("cosine")).filter(F.col("cosine") >= least)
    place = F.row_number().over(Window.partitionBy("wanted").orderBy(F.desc("cosine"), key))
    return met.withColumn("rank", place).filter(F.col("rank") <= k)


def village_features(rows: DataFrame, key: str, name: str, region: str, spatial: DataFrame, k: int) -> DataFrame:
    """Each row with its name's length, its place in space (null if unknown) and the k characters of its region of the
    highest lift, joined by commas in order."""
    tops = top_features(character_lifts(rows, region, name), region, "char", "lift", k)
    joined = tops.groupBy(region).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "char"))), lambda x: x["char"]), ",").alias("characters"))
    return rows.join(spatial, key, "left").join(joined, region, "left").select(key, F.length(name).alias("length"), *[c for c in spatial.columns if c != key], "characters")


def thresholded(cells: DataFrame, filters: Sequence[Column], columns: list[str], metric: str, least: float, k: int) -> DataFrame:
    """The first k different rows that meet all filters with a metric of at least `least`, largest first, ties by columns."""
    out = cells.filter(F.col(metric) >= least)
    for test in filters:
        out = out.filter(test)
    return out.select(*columns, metric).distinct().orderBy(F.desc(metric), *columns).limit(k)
