"""Distances of locations by how their tokens of shared items correspond (survey group ADV).

A token is the set of an item's values at a location, joined in order. Items meet by an equi-join; what grows with pairs of
locations has at most structures.MOST_KEYS locations. Distances are between 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.structures import bounded
from lexigrid.sources.tables import Rounds

#: Weights of correspondence and structure, of the anchor part and of the shared part.
CORRESPONDENCE, STRUCTURE, ANCHOR, SHARED = 0.85, 0.15, 0.15, 0.20
TINY = 1e-12


def tokens(rows: DataFrame, group: str, location: str, item: str, value: str) -> DataFrame:
    """group, location, item, token. Null and empty values don't count; items without values have no token."""
    used = rows.select(F.col(group).alias("group"), F.col(location).alias("location"), F.col(item).alias("item"), F.col(value).cast("string").alias("value")).filter("value <> ''")
    return used.groupBy("group", "location", "item").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("token"))


def catalogue(found: DataFrame) -> DataFrame:
    """Each token with its number, from 0 in order, and the number of its values. Tokens are types, few beside rows."""
    types = found.select("token").distinct()
    return types.select("token", (F.row_number().over(Window.orderBy("token")) - 1).alias("id"), F.size(F.split("token", r"\|")).alias("n_values"))


def coverage(found: DataFrame, items: DataFrame) -> DataFrame:
    """Of each group and location: items with a token, and their share of the group's items. items: group, item."""
    totals = items.groupBy("group").agg(F.count_distinct("item").alias("n_all"))
    return found.groupBy("group", "location").agg(F.count("*").alias("n_items")).join(totals, "group").select("group", "location", "n_items", F.round(F.col("n_items") / F.col("n_all"), 6).alias("coverage"))


def aligned(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b (a < b), x, y, n: the items that have token x at a and y at b. keys: ["group"], or [] for all groups at
    once, where an item of each group is one of its own."""
    left = found.select("group", "item", F.col("location").alias("a"), F.col("token").alias("x"))
    right = found.select("group", "item", F.col("location").alias("b"), F.col("token").alias("y"))
    return left.join(right, ["group", "item"]).filter("a < b").groupBy(*keys, "a", "b", "x", "y").agg(F.count("*").alias("n"))


def _clipped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def _margins(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cx, cy (numbers of x and of y), total, nx and ny (numbers of different x and y)."""
    by = lambda *more: Window.partitionBy(*keys, "a", "b", *more)
    first = lambda c: F.when(F.row_number().over(by(c).orderBy("x", "y")) == 1, 1).otherwise(0)
    out = cells.withColumns({"cx": F.sum("n").over(by("x")), "cy": F.sum("n").over(by("y")), "fx": first("x"), "fy": first("y")})
    return out.withColumns({"total": F.sum("n").over(by()), "nx": F.sum("fx").over(by()), "ny": F.sum("fy").over(by())}).drop("fx", "fy")


def intra(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, corr (mean conditional entropy over the logarithm of the larger inventory), struct (pairs of items that
    are alike at one location alone, over all pairs) and intra, their blend."""
    rows = _margins(cells, keys)
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    entropy = -(F.col("n") / F.col("total")) * (F.ln(F.col("n") / F.col("cx")) + F.ln(F.col("n") / F.col("cy")))
    # A margin's pairs, dealt over its cells by their share of the margin.
    alike = pairs("cx") * F.col("n") / F.col("cx") + pairs("cy") * F.col("n") / F.col("cy") - 2 * pairs("n")
    sums = rows.groupBy(*keys, "a", "b").agg(F.sum(entropy).alias("h"), F.sum(alike).alias("m"), F.max("total").alias("t"), F.max(F.greatest("nx", "ny", F.lit(2))).alias("k"))
    out = sums.withColumns({"corr": _clipped(F.col("h") / 2 / F.ln(F.col("k").cast("double"))), "struct": F.coalesce(_clipped(F.col("m") / F.nullif(F.col("t") * (F.col("t") - 1) / 2, F.lit(0.0))), F.lit(0.0))})
    return out.select(*keys, "a", "b", "corr", "struct", (CORRESPONDENCE * F.col("corr") + STRUCTURE * F.col("struct")).alias("intra"))


def shared(cells: DataFrame, keys: list[str], model: DataFrame) -> DataFrame:
    """keys, a, b, shared: as corr, but with the conditional probabilities of all groups together (model: aligned(found, []))."""
    known = _margins(model, []).select("a", "b", "x", "y", (F.col("n") / F.col("cx")).alias("px"), (F.col("n") / F.col("cy")).alias("py"), F.greatest("nx", "ny", F.lit(2)).alias("k"))
    rows = cells.join(known, ["a", "b", "x", "y"])
    entropy = F.sum(-F.col("n") * (F.ln(F.col("px") + TINY) + F.ln(F.col("py") + TINY))) / F.sum("n") / 2
    return rows.groupBy(*keys, "a", "b").agg(_clipped(entropy / F.ln(F.max("k").cast("double"))).alias("shared"))


def _mapped(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions: keys, a, b, here and there (whose token and whose counterpart), token, match (the most frequent
    counterpart, the smallest on ties) and w, its share of the shared items."""
    total = F.sum("n").over(Window.partitionBy(*keys, "a", "b"))
    side = lambda *columns: F.struct(*(F.col(c).alias(name) for c, name in zip(columns, ("here", "there", "token", "other"))))
    # Both directions by one explode: of a union of two aggregates over one shuffle, Spark 4.1 may leave a group in two parts.
    rows = cells.withColumn("total", total).select(*keys, "a", "b", "n", "total", F.explode(F.array(side("a", "b", "x", "y"), side("b", "a", "y", "x"))).alias("s"))
    best = F.min_by("s.other", F.struct((-F.col("n")).alias("k"), "s.other")).alias("match")
    return rows.groupBy(*keys, "a", "b", "s.here", "s.there", "s.token").agg(best, (F.sum("n") / F.max("total")).alias("w"))


def values(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, value: the mean Jaccard distance of the value sets of tokens and their counterparts, both ways."""
    p, q = F.split("token", r"\|"), F.split("match", r"\|")
    gap = 1 - F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))
    return _mapped(cells, keys).groupBy(*keys, "a", "b").agg(_clipped(F.sum(F.col("w") * gap) / 2).alias("value"))


def anchors(cells: DataFrame, keys: list[str], profile: DataFrame) -> DataFrame:
    """keys, a, b, anchor: how far tokens and their counterparts lie apart in their locations' inventories, both ways.
    profile: location, value, share, rank_percent. A token's signature is the mean of its known values', or zeros."""
    rows = _mapped(cells, keys)
    used = rows.select(F.col("here").alias("location"), "token").unionByName(rows.select(F.col("there").alias("location"), F.col("match").alias("token"))).distinct()
    parts = used.select("location", "token", F.explode(F.split("token", r"\|")).alias("value")).join(profile, ["location", "value"], "left")
    signs = parts.groupBy("location", "token").agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("s"), F.coalesce(F.avg("rank_percent"), F.lit(0.0)).alias("r"))
    named = lambda where, token, k: signs.select(F.col("location").alias(where), F.col("token").alias(token), F.col("s").alias(f"s{k}"), F.col("r").alias(f"r{k}"))
    met = rows.join(named("here", "token", 1), ["here", "token"]).join(named("there", "match", 2), ["there", "match"])
    gap = F.least(F.lit(1.0), F.sqrt((F.pow(F.col("s1") - F.col("s2"), F.lit(2.0)) + F.pow(F.col("r1") - F.col("r2"), F.lit(2.0))) / 2))
    return met.groupBy(*keys, "a", "b").agg(_clipped(F.sum(F.col("w") * gap) / 2).alias("anchor"))


def distance_matrix(found: DataFrame, weights: DataFrame, mode: str = "intra", profile: DataFrame | None = None, value_weight: float = 0.0) -> DataFrame:
    """a, b (a < b), distance of all pairs of locations: the weighted mean over groups. weights: group, weight.

    mode: intra, anchored (with anchors) or shared. A group that neither has doesn't count, one that a side lacks costs 1;
    without shared items corr, anchors, shared and values are 1 and struct 0. Without any group the distance is 1."""
    keys = ["group"]
    # Both are small beside found, and read again and again.
    steps = Rounds(found.sparkSession)
    cells = steps.written(aligned(found, keys), "cells")
    present = steps.written(found.select("group", "location").distinct(), "present")
    parts = intra(cells, keys)
    if mode == "anchored":
        parts = parts.join(anchors(cells, keys, profile), [*keys, "a", "b"])
        extra, weight = F.coalesce("anchor", F.lit(1.0)), ANCHOR
    elif mode == "shared":
        parts = parts.join(shared(cells, keys, aligned(found, [])), [*keys, "a", "b"])
        extra, weight = F.coalesce("shared", F.lit(1.0)), SHARED
    else:
        extra, weight = F.lit(0.0), 0.0
    if value_weight:
        parts = parts.join(values(cells, keys), [*keys, "a", "b"])
    places = bounded(present.select("location").distinct())
    pairs = places.select(F.col("location").alias("a")).join(places.select(F.col("location").alias("b")), F.col("a") < F.col("b")).crossJoin(F.broadcast(weights))
    has = lambda c: present.select("group", F.col("location").alias(c), F.lit(1).alias(f"has_{c}"))
    rows = pairs.join(has("a"), ["group", "a"], "left").join(has("b"), ["group", "b"], "left").filter("has_a IS NOT NULL OR has_b IS NOT NULL").join(parts, ["group", "a", "b"], "left")
    phoneme = (1 - weight) * F.coalesce("intra", F.lit(CORRESPONDENCE)) + weight * extra
    mixed = (1 - value_weight) * phoneme + value_weight * F.coalesce("value", F.lit(1.0)) if value_weight else phoneme
    each = F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), 1.0).otherwise(mixed)
    sums = rows.groupBy("a", "b").agg((F.sum(F.col("weight") * each) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("d"))
    every = pairs.select("a", "b").distinct()
    return every.join(sums, ["a", "b"], "left").select("a", "b", F.round(F.coalesce("d", F.lit(1.0)), 6).alias("distance"))


def group_diagnostics(found: DataFrame, locations: DataFrame) -> DataFrame:
    """Of each group: locations with tokens, their share of all, mean items a location, different tokens, and a warning."""
    all_ = locations.agg(F.count_distinct("location").alias("n_all"))
    each = found.groupBy("group").agg(F.count_distinct("location").alias("n_locations"), F.count("*").alias("n"), F.count_distinct("token").alias("n_tokens"), F.count_distinct("item").alias("n_items"))
    warning = F.when(F.col("n_items") < 2, "fewer than two items").when(F.col("n_locations") < F.col("n_all"), "not at all locations").otherwise("")
    return each.crossJoin(F.broadcast(all_)).select("group", "n_locations", F.round(F.col("n_locations") / F.col("n_all"), 6).alias("share"), F.round(F.col("n") / F.col("n_locations"), 6).alias("mean_items"), "n_tokens", warning.alias("warning"))
