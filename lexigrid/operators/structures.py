"""Sets, trees, pairs, vectors and geography (survey groups SET, ADV, FN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_sets(a: Column, b: Column) -> Column:
    """same, partial, diff, or unknown when either set is null or empty."""
    empty = lambda x: F.coalesce(F.size(x) <= 0, F.lit(True))
    return F.when(empty(a) | empty(b), "unknown").when(F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)), "same").when(F.arrays_overlap(a, b), "partial").otherwise("diff")


#: Keys of which all pairs are made: locations, regions or labels, not rows.
MOST_KEYS = 5000


def bounded(df: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """df, if it has at most so many rows; else an error, as all pairs of them would be made."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"all pairs are made of at most {most} rows")
    return df


def key_pairs(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Every pair of keys (a < b), of at most MOST_KEYS, with their sets of items compared (same, partial, diff) and their
    Jaccard index. Shared items are counted by an equi-join on items with partial sums, so no set is put together."""
    pairs = rows.select(F.col(key).alias("a"), F.col(item).alias("item")).filter("a IS NOT NULL AND item IS NOT NULL").distinct()
    sizes = bounded(pairs.groupBy("a").agg(F.count("*").alias("na")))
    both = pairs.join(pairs.withColumnRenamed("a", "b"), "item").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    every = sizes.join(sizes.select(F.col("a").alias("b"), F.col("na").alias("nb")), F.col("a") < F.col("b"))
    n = F.coalesce("n", F.lit(0))
    relation = F.when((n == F.col("na")) & (n == F.col("nb")), "same").when(n > 0, "partial").otherwise("diff")
    return every.join(both, ["a", "b"], "left").select("a", "b", relation.alias("relation"), F.round(n / (F.col("na") + F.col("nb") - n), 6).alias("jaccard"))


def tree_paths(df: DataFrame, levels: list[str], blank: str = "(空)") -> DataFrame:
    """Distinct paths of the level columns without the last, with the sorted last level of each, joined by commas."""
    named = df.select(*(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(blank)).alias(c) for c in levels))
    return named.groupBy(*levels[:-1]).agg(F.array_join(F.array_sort(F.collect_set(levels[-1])), ",").alias("leaves"))


def children(df: DataFrame, levels: list[str], path: list) -> DataFrame:
    """Distinct next-level values below a path."""
    test = F.lit(True)
    for name, value in zip(levels, path):
        test = test & F.col(name).eqNullSafe(F.lit(value))
    return df.filter(test).select(F.col(levels[len(path)]).alias("child")).distinct()


def vector_pairs(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine, Euclidean and Manhattan measures of all pairs (a < b) of at most MOST_KEYS vectors."""
    vectors = bounded(vectors)
    v = F.col(vector).cast("array<double>")
    left, right = vectors.select(F.col(key).alias("a"), v.alias("x")), vectors.select(F.col(key).alias("b"), v.alias("y"))
    total = lambda f: F.aggregate(F.zip_with("x", "y", f), F.lit(0.0), lambda s, z: s + z)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, z: s + z * z))
    return left.join(right, F.col("a") < F.col("b")).select(
        "a", "b",
        F.round(total(lambda x, y: x * y) / F.nullif(norm("x") * norm("y"), F.lit(0.0)), 6).alias("cosine"),
        F.round(F.sqrt(total(lambda x, y: (x - y) * (x - y))), 6).alias("euclid"),
        F.round(total(lambda x, y: F.abs(x - y)), 6).alias("manhattan"),
    )


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean vector of each key, as a comma-free long form: key, dimension, mean."""
    return df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("dimension", "value")).groupBy(key, "dimension").agg(F.avg("value").alias("mean"))


def alignment(df: DataFrame, key: str, item: str, token: str) -> DataFrame:
    """For each pair of keys, token x of the first and y of the second on the items they share: the number of items
    for each (x, y). Items meet by an equi-join, so pairs are made per item and not of all rows."""
    bounded(df.select(key).distinct())
    one = df.groupBy(key, item).agg(F.array_join(F.array_sort(F.collect_set(F.col(token).cast("string"))), "|").alias("token"))
    left = one.select(F.col(key).alias("a"), item, F.col("token").alias("x"))
    right = one.select(F.col(key).alias("b"), item, F.col("token").alias("y"))
    return left.join(right, item).filter("a < b").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))


def correspondence_distance(aligned: DataFrame) -> DataFrame:
    """Mean of both conditional entropies of the tokens of two keys, each divided by log(max(number of tokens, 2))."""
    pair = Window.partitionBy("a", "b")
    p = F.col("n") / F.sum("n").over(pair)
    for_x, for_y = Window.partitionBy("a", "b", "x"), Window.partitionBy("a", "b", "y")
    parts = aligned.select("a", "b", "x", "y", p.alias("p"), (F.col("n") / F.sum("n").over(for_x)).alias("y_given_x"), (F.col("n") / F.sum("n").over(for_y)).alias("x_given_y"))
    sums = parts.groupBy("a", "b").agg(
        F.sum(-F.col("p") * F.ln("y_given_x")).alias("hy"), F.sum(-F.col("p") * F.ln("x_given_y")).alias("hx"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny")
    )
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(2)).cast("double"))
    return sums.select("a", "b", F.round((F.col("hy") / log("ny") + F.col("hx") / log("nx")) / 2, 6).alias("distance"))


def best_mapping(aligned: DataFrame) -> DataFrame:
    """The most frequent y of each x of a pair of keys, the smallest on ties."""
    return aligned.groupBy("a", "b", "x").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("y"), F.max("n").alias("n"))


def haversine(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column, radius: float = 6371.0) -> Column:
    """Kilometres on a sphere."""
    half = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), F.lit(2)) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), F.lit(2))
    return 2 * radius * F.asin(F.least(F.sqrt(half), F.lit(1.0)))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a closed ring of structs (x, y), by the parity of the edges that a ray crosses."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))
    def crosses(e):
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
    return F.aggregate(edges, F.lit(False), lambda inside, e: inside != F.coalesce(crosses(e), F.lit(False)))


def character_counts(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The k most frequent characters (white space left out) of each key's texts, ties by character."""
    each = df.select(key, F.explode(F.split(F.regexp_replace(text, r"\s", ""), "")).alias("char")).filter("char <> ''")
    counts = each.groupBy(key, "char").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "char"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def symbol_keys(text: Column, symbols: list[str]) -> Column:
    """Sort keys by a custom symbol order: places of one- or two-character symbols, longest first; unknown ones last."""
    places = F.create_map(*(x for i, s in enumerate(symbols) for x in (F.lit(s), F.lit(i))))
    two = [s for s in symbols if len(s) == 2]
    pattern = "|".join([*two, "."]) if two else "."
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)({pattern})")), lambda s: F.coalesce(F.try_element_at(places, s), F.lit(len(symbols))))


def nested_map(cells: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """A map of inner to value for each outer key; meant for tables whose inner keys are few."""
    return cells.groupBy(outer).agg(F.map_from_entries(F.collect_list(F.struct(inner, value))).alias("cells"))
