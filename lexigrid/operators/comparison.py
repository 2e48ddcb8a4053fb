"""Groups and regions compared: n-grams, shares, distances, tests and samples (survey groups AGG, SET, JOIN, WIN, ADV)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.places import nearest_sites
from lexigrid.operators.structures import bounded
from lexigrid.sources.tables import Rounds

#: Pairs of tokens that one task makes and counts, about.
PAIRS = 1_000_000


def ngrams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Runs of n characters of each text, white space left out, one row for each occurrence."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s", "")
    split = df.select(key, F.filter(F.split(bare, ""), lambda c: c != "").alias("chars")).filter(F.size("chars") >= n)
    places = F.sequence(F.lit(1), F.size("chars") - (n - 1))
    return split.select(key, F.explode(F.transform(places, lambda i: F.array_join(F.slice("chars", i, F.lit(n)), ""))).alias("ngram"))


#: Characters that are counted at a time, and those that \s means.
PIECE_CHARS, SPACES = 1 << 20, np.array([9, 10, 11, 12, 13, 32], np.uint32)


def _piece_counts(keys: np.ndarray, texts: list[str], n: int) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Of each key (a number for each text): its n-grams and their counts."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(texts)), np.array([len(t) for t in texts], np.int64))
    bare = ~np.isin(chars, SPACES)
    chars, owner = chars[bare], owner[bare]
    if len(chars) < n:
        return
    starts = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    runs = np.stack([chars[starts + k] for k in range(n)], axis=1)
    # Up to three characters fit into an integer.
    names = sum(runs[:, k].astype(np.int64) << 21 * k for k in range(n)) if n <= 3 else np.ascontiguousarray(runs).view(np.dtype((np.void, 4 * n)))[:, 0]
    of = keys[owner[starts]]
    for key in np.unique(of):
        mine = np.flatnonzero(of == key)
        _, one, counts = np.unique(names[mine], return_index=True, return_counts=True)
        flat = np.ascontiguousarray(runs[mine[one]]).tobytes().decode("utf-32-le")
        yield int(key), [flat[k : k + n] for k in range(0, len(flat), n)], counts


def ngram_counts(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, ngram, n: the number of each key's n-grams (see ngrams). Tasks count pieces of about PIECE_CHARS characters, and Spark adds
    up the pieces' counts."""
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            codes, texts = names.indices.to_numpy(), batch.column(1).fill_null("")
            edges = np.cumsum(pc.utf8_length(texts).to_numpy()) // PIECE_CHARS
            for lo, hi in zip(*(lambda at: (at[:-1], at[1:]))([0, *(np.flatnonzero(np.diff(edges)) + 1), len(texts)])):
                for code, grams, counts in _piece_counts(codes[lo:hi], texts[lo:hi].to_pylist(), n):
                    own = names.dictionary.take(pa.array(np.full(len(grams), code)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(grams, pa.string()), pa.array(counts)], ["key", "ngram", "n"])

    pieces = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(count, f"key {kind}, ngram string, n bigint")
    return pieces.groupBy(F.col("key").alias(key), "ngram").agg(F.sum("n").alias("n"))


def ngram_shares(df: DataFrame, key: str, text: str, n: int, k: int) -> DataFrame:
    """The k most frequent n-grams of each key (ties by n-gram) with percent of all n-grams of the key.

    Counts are combined before the shuffle, so the windows see one row for each key and n-gram."""
    counts = ngram_counts(df, key, text, n)
    totals = counts.groupBy(key).agg(F.sum("n").alias("n_all"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "ngram"))).filter(F.col("rank") <= k)
    return ranked.join(totals, key).select(key, "ngram", "n", F.round(F.col("n") * 100.0 / F.col("n_all"), 6).alias("percent"), "rank")


def two_groups(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Share of each value inside and outside of a group, and the difference; a side without rows has share 0."""
    inside = F.coalesce(group, F.lit(False)).cast("int")
    counts = df.groupBy(value).agg(F.sum(inside).alias("n_in"), F.sum(1 - inside).alias("n_out"))
    totals = counts.agg(F.sum("n_in").alias("all_in"), F.sum("n_out").alias("all_out"))
    share = lambda n: F.coalesce(F.col(f"n_{n}") / F.nullif(F.col(f"all_{n}"), F.lit(0)), F.lit(0.0))
    return counts.crossJoin(F.broadcast(totals)).select(value, "n_in", "n_out", F.round(share("in"), 6).alias("share_in"), F.round(share("out"), 6).alias("share_out"), F.round(share("in") - share("out"), 6).alias("difference"))


def chi_square_yates(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Chi-square of group by value against all other values, with the continuity correction (never beyond the
    difference itself); null where a margin is empty. significant: over 3.841459, the 5% point of one degree."""
    inside = F.coalesce(group, F.lit(False)).cast("double")
    counts = df.groupBy(value).agg(F.sum(inside).alias("a"), F.sum(1 - inside).alias("b"))
    rows = counts.crossJoin(F.broadcast(counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))))
    a, b, c, d = F.col("a"), F.col("b"), F.col("all_a") - F.col("a"), F.col("all_b") - F.col("b")
    n = F.col("all_a") + F.col("all_b")
    gap = F.abs(a * d - b * c)
    margins = (a + b) * (c + d) * F.col("all_a") * F.col("all_b")
    chi = n * F.pow(gap - F.least(n / 2, gap), F.lit(2.0)) / F.nullif(margins, F.lit(0.0))
    return rows.select(value, F.round(chi, 6).alias("chi_square"), (chi > 3.841459).alias("significant"))


def aligned_groups(first: DataFrame, second: DataFrame, on: list[str], value: str) -> DataFrame:
    """Two aggregates side by side; a cell that one side lacks counts 0."""
    a, b = first.select(*on, F.col(value).alias("first")), second.select(*on, F.col(value).alias("second"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, on, "full").select(*on, zero("first").alias("first"), zero("second").alias("second"), (zero("first") - zero("second")).alias("difference"))


def common_and_own(df: DataFrame, key: str, item: str) -> DataFrame:
    """Items of all keys (common), and items of one key alone (own), by the number of keys that hold an item."""
    pairs = df.select(key, item).filter(F.col(key).isNotNull() & F.col(item).isNotNull()).distinct()
    spread = pairs.groupBy(item).agg(F.count("*").alias("n_keys"), F.min(key).alias(key))
    everything = pairs.agg(F.countDistinct(key).alias("n_all"))
    kind = F.when(F.col("n_keys") == F.col("n_all"), "common").when(F.col("n_keys") == 1, "own")
    return spread.crossJoin(F.broadcast(everything)).select(item, kind.alias("kind"), F.when(kind == "own", F.col(key)).alias(key)).filter("kind IS NOT NULL")


def merged_lists(reference: DataFrame, others: list[DataFrame], key: str, value: str, separator: str = ";") -> DataFrame:
    """A reference list with a column for each other list: all its values of the key in order, joined, or the value
    itself where they are all equal; null where it has none."""

    def joined(df: DataFrame, name: str) -> DataFrame:
        values = F.array_sort(F.collect_list(F.col(value).cast("string")))
        return df.groupBy(key).agg(values.alias("v")).select(key, F.when(F.size("v") > 0, F.when(F.size(F.array_distinct("v")) == 1, F.get("v", F.lit(0))).otherwise(F.array_join("v", separator))).alias(name))

    return reduce(lambda out, x: out.join(joined(x[1], f"value_{x[0]}"), key, "left"), enumerate(others, 1), reference)


def undirected(df: DataFrame, a: str, b: str) -> DataFrame:
    """Edges with their smaller end first, each once, with how often they occur either way."""
    return df.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.count("*").alias("n"))


def positive_pmi(df: DataFrame, holder: str, token: str, least: int) -> DataFrame:
    """Pairs of tokens (a < b) that share at least `least` holders, with their pointwise mutual information (natural
    logarithm) where it is positive. Pairs are made inside a holder, so holders should hold bounded sets of tokens.

    Rows, holders and pairs are dealt into partitions by their number, so a task's memory doesn't grow with the table."""
    rows = df.select(holder, token).filter(F.col(token).isNotNull())
    pairs = Rounds(df.sparkSession).written(rows.repartition(rows.count() // PAIRS + 1, holder, token).distinct(), "pairs")
    counts = pairs.groupBy(token).agg(F.count("*").alias("n"))
    held = F.col("n").cast("double")
    n_all, made = pairs.filter(F.col(holder).isNotNull()).groupBy(holder).agg(F.count("*").alias("n")).agg(F.count("*"), F.coalesce(F.sum(held * (held - 1) / 2), F.lit(0.0))).first()
    parts = int(made / PAIRS) + 1
    dealt = lambda name: pairs.select(holder, F.col(token).alias(name)).repartition(parts, holder)
    both = dealt("a").join(dealt("b"), holder).filter("a < b").select("a", "b").repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= least)
    named = both.join(counts.select(F.col(token).alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col(token).alias("b"), F.col("n").alias("nb")), "b")
    pmi = F.ln(F.col("n_both").cast("double") * F.lit(n_all) / (F.col("na").cast("double") * F.col("nb")))
    return named.select("a", "b", "n_both", F.round(pmi, 6).alias("pmi")).filter("pmi > 0")


def stratified_sample(df: DataFrame, stratum: str, key: str, share: float) -> DataFrame:
    """The share of each stratum, at least one row, by the order of a hash of the key: reruns agree. Rows are placed inside
    the 4096 ranges of the hash's first digits and the ranges' numbers are added up, so no task orders a stratum."""
    digest, most = F.md5(F.col(key).cast("string")), F.greatest(F.floor(F.sum("n").over(Window.partitionBy("_s")) * F.lit(share)), F.lit(1))
    rows = df.withColumns({"_s": F.struct(stratum), "_h": digest, "_r": F.substring(digest, 1, 3)})
    ranges = rows.groupBy("_s", "_r").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_s", "_r", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"), most.alias("_most"))
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_s", "_r").orderBy("_h", key)))
    return placed.join(ranges, ["_s", "_r"]).filter("_before + _k <= _most").select(*df.columns)


def random_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by the order of a hash of the key (all, if fewer): reruns agree."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def grid_sample(df: DataFrame, x: str, y: str, key: str, cells: int = 50) -> DataFrame:
    """One row (the smallest key) of each filled cell of a grid of cells x cells over the extent of the points."""
    box = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)) * cells), F.lit(cells - 1))
    spread = df.crossJoin(F.broadcast(box)).withColumns({"_cx": F.coalesce(cell(x, "_x0", "_x1"), F.lit(0)), "_cy": F.coalesce(cell(y, "_y0", "_y1"), F.lit(0))})
    return spread.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("_cx", "_cy").agg(F.min_by(F.struct(*df.columns), key).alias("one")).select("one.*")


def same_pair_distance(df: DataFrame, key: str, item: str, token: str) -> DataFrame:
    """Of two keys (a < b): 1 - pairs of shared items whose tokens agree under both keys / pairs that agree under either.

    Pairs of items are counted as n(n-1)/2 of each token's items and never made."""
    bounded(df.select(key).distinct())
    one = df.groupBy(key, item).agg(F.min(F.col(token).cast("string")).alias("t"))
    left, right = one.select(F.col(key).alias("a"), item, F.col("t").alias("x")), one.select(F.col(key).alias("b"), item, F.col("t").alias("y"))
    cells = left.join(right, item).filter("a < b").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = cells.groupBy("a", "b").agg(pairs("n").alias("both"))
    side = lambda c: cells.groupBy("a", "b", c).agg(F.sum("n").alias("n")).groupBy("a", "b").agg(pairs("n").alias(f"by_{c}"))
    either = F.col("by_x") + F.col("by_y") - F.col("both")
    return both.join(side("x"), ["a", "b"]).join(side("y"), ["a", "b"]).select("a", "b", F.round(F.coalesce(1 - F.col("both") / F.nullif(either, F.lit(0.0)), F.lit(0.0)), 6).alias("distance"))


def region_jaccard(df: DataFrame, region: str, token: str) -> DataFrame:
    """Jaccard index of the token sets of regions (a < b) that share a token, by an equi-join on tokens."""
    bounded(df.select(region).distinct())
    pairs = df.select(region, token).filter(F.col(token).isNotNull()).distinct()
    sizes = pairs.groupBy(region).agg(F.count("*").alias("n"))
    both = pairs.select(F.col(region).alias("a"), token).join(pairs.select(F.col(region).alias("b"), token), token).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    named = both.join(sizes.select(F.col(region).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(region).alias("b"), F.col("n").alias("nb")), "b")
    return named.select("a", "b", "n_both", F.round(F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both")), 6).alias("jaccard"))


def _cells(vectors: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    """Of each label and dimension: number, mean and variance of the values."""
    long = vectors.select(label, key, F.posexplode(F.col(vector).cast("array<double>")).alias("dimension", "value"))
    return long.groupBy(label, "dimension").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))


def cluster_spread(vectors: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    """Calinski-Harabasz index of labelled vectors (one row): spread between centroids over spread inside clusters; null
    with one label, or with a label for each row."""
    cells = _cells(vectors, label, key, vector)
    overall = cells.groupBy("dimension").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"))
    sums = cells.join(F.broadcast(overall), "dimension").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("centre"), F.lit(2.0))).alias("between"), F.sum(F.col("n") * F.col("variance")).alias("within"))
    sizes = vectors.agg(F.count("*").alias("n"), F.countDistinct(label).alias("k"))
    over = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    value = over("between", F.col("k") - 1) / F.nullif(over("within", F.col("n") - F.col("k")), F.lit(0.0))
    return sums.crossJoin(sizes).select("n", "k", F.round(value, 4).alias("calinski_harabasz"))


def davies_bouldin(vectors: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    """Davies-Bouldin index (one row): the mean over labels of the worst (spread + spread) / distance of centroids; a
    label's spread is the mean distance to its centroid. Pairs are made of labels, not of rows."""
    centres = _cells(vectors, label, key, vector).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dimension", "mean"))), lambda x: x["mean"]).alias("centre"))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, z: s + z))
    spread = vectors.select(label, F.col(vector).cast("array<double>").alias("v")).join(F.broadcast(centres), label).groupBy(label).agg(F.avg(gap("v", "centre")).alias("spread"))
    one = bounded(centres.join(spread, label))
    pairs = one.select(F.col(label).alias("a"), F.col("centre").alias("ca"), F.col("spread").alias("sa")).join(one.select(F.col(label).alias("b"), F.col("centre").alias("cb"), F.col("spread").alias("sb")), F.col("a") != F.col("b"))
    worst = pairs.groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / F.nullif(gap("ca", "cb"), F.lit(0.0))).alias("r"))
    return worst.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


def silhouette(vectors: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distances (one row). The mean squared distance of a row to a cluster follows
    from the cluster's size, sum and sum of squares, so each row meets each label once and no pairs of rows are made."""
    v = vectors.select(key, label, F.col(vector).cast("array<double>").alias("v"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, z: s + z * z)
    sums = v.select(label, F.posexplode("v").alias("dimension", "value")).groupBy(label, "dimension").agg(F.sum("value").alias("total"))
    sums = sums.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dimension", "total"))), lambda x: x["total"]).alias("total"))
    sizes = v.groupBy(label).agg(F.count("*").alias("n"), F.sum(square("v")).alias("squares"))
    clusters = sums.join(sizes, label).select(F.col(label).alias("other"), "total", "n", "squares")
    met = v.crossJoin(F.broadcast(bounded(clusters)))
    dot = F.aggregate(F.zip_with("v", "total", lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    own = F.col("other") == F.col(label)
    total = F.col("n") * square(F.col("v")) - 2 * dot + F.col("squares")
    each = met.groupBy(key).agg(F.max(F.when(own, total / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, total / F.col("n"))).alias("b"))
    value = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return each.agg(F.round(F.avg(value), 6).alias("silhouette"))


def nearest_in_grid(points: DataFrame, places: DataFrame, cell: float) -> DataFrame:
    """The nearest place (ties by id) within `cell` of each point: point_id, place_id, distance.

    points: point_id, x, y; places: place_id, px, py."""
    distance = F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2.0)) + F.pow(F.col("y") - F.col("py"), F.lit(2.0)))
    return nearest_sites(points, places, cell, distance).select("point_id", "place_id", F.round("distance", 6).alias("distance"))


def neighbour_network(edges: DataFrame, starts: DataFrame, depth: int, k: int, most: int | None = None) -> DataFrame:
    """Breadth-first from the start nodes: each step goes to the k heaviest neighbours (ties by node) of the nodes before.
    edges: a, b, weight (undirected; the greatest weight of an edge counts). Gives node, depth and weight (the greatest by
    which the step reached it); most: nodes kept, by depth, weight (greatest first) and node.

    One shuffle join a step against nodes not yet seen; the number of steps is fixed, so the plan is bounded."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).filter("a <> b")
    best = both.groupBy("a", "b").agg(F.max("weight").alias("weight"))
    near = best.withColumn("_k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))).filter(F.col("_k") <= k).drop("_k")
    seen = front = starts.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("double").alias("weight"))
    for step in range(1, depth + 1):
        reached = front.select(F.col("node").alias("a")).join(near, "a").groupBy(F.col("b").alias("node")).agg(F.max("weight").cast("double").alias("weight"))
        front = reached.join(seen, "node", "left_anti").select("node", F.lit(step).alias("depth"), "weight")
        seen = seen.unionByName(front)
    return seen if most is None else seen.orderBy("depth", F.desc("weight"), "node").limit(most)
