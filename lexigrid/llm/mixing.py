"""Mixing sources to target weights, by DataFrame functions alone.

Documents get hash-random keys (md5 of a seed and the id). Within a source they are ordered by key, in ranges given
by the key's leading digits; running sums of sizes are taken inside each range and over the ranges' totals, level by
level with 256 ranges each, so no task holds a source. A source's documents are taken in that order up to its budget:
whole epochs first, then up to the cut, where the last document is taken in part.

Targets: `share` of all words, split by weight; a source stops at `most` times its own words and the excess is
shared again by weight among the others. Sources in code-point order, null last, weigh 5, 2, 1, repeating.

Nulls: a null text has size 0; a null id hashes as an empty text. Equal ids are ordered by size; rows that agree in
both are interchangeable, so they are counted before anything is ordered, and come out of their count again: very many rows
without id, or of one id, are few rows in any window. An empty table gives an empty mix. Other columns are ignored. The
list of sources, a row each, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import written

#: Rows that a range of keys should have at most on average; more rows mean another level of 256 ranges.
ROWS_A_RANGE = 2000


SEED = "mix-1:"


def hash_key(seed: str, tie: str | None = None) -> Column:
    """The hash-random key of doc_id, and of the column tie if given, as hex digits."""
    more = [F.lit(":"), F.col(tie).cast("string")] if tie else []
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *more).cast("binary"))


def place(seed: str, tie: str) -> Column:
    """A row's place in the order of a mix with that tie."""
    return F.struct(hash_key(seed, tie).alias("key"), F.col(tie).alias("tie"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, source_size and target. Sources in the order of cap a weight fill up first; the level that is left for
    the others is the same for all of them."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size").cast("double"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(whole).cast("double") - before) / rest
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    at = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("at", at).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def with_positions(sizes: DataFrame, seed: str, tie: str | None = None) -> DataFrame:
    """Adds before: the words of the source's documents ahead in the order of hash keys. sizes: a written table. With tie,
    the order is that of place()."""
    levels, room = 1, 256 * ROWS_A_RANGE
    rows = sizes.count()
    while rows > room:
        levels, room = levels + 1, room * 256
    # Without a tie, a row stands for all rows that agree in source, id and size.
    alike = sizes.withColumn("n", F.lit(1).cast("long")) if tie else sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    keyed = alike.withColumn("key", hash_key(seed, tie)).withColumn("words", F.col("n") * F.col("size"))
    for d in range(levels + 1):
        keyed = keyed.withColumn(f"r{d}", F.substring("key", 1, 2 * d))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    sum_ahead = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    ranges = keyed.groupBy("source", *(f"r{d}" for d in range(levels + 1))).agg(F.sum("words").alias("words"))
    bases = None
    for d in range(1, levels + 1):
        here = ranges.groupBy("source", *(f"r{k}" for k in range(d + 1))).agg(F.sum("words").alias("words"))
        inside = here.withColumn("base", sum_ahead("words", ahead.partitionBy("source", f"r{d - 1}").orderBy(f"r{d}"))).drop("words")
        if bases is not None:
            above = bases.withColumnRenamed("base", "base_above").withColumnRenamed("source", "source_above")
            inside = inside.join(above.select("source_above", F.col(f"r{d - 1}").alias("range_above"), "base_above"), F.col("source").eqNullSafe(F.col("source_above")) & (F.col(f"r{d - 1}") == F.col("range_above")))
            inside = inside.withColumn("base", F.col("base") + F.col("base_above")).drop("source_above", "range_above", "base_above")
        bases = inside
    bases = bases.select(F.col("source").alias("source_of"), F.col(f"r{levels}").alias("range"), "base")
    own = ahead.partitionBy("source", f"r{levels}").orderBy(*(["key", tie] if tie else ["key", "doc_id", "size"]))
    placed = keyed.withColumn("inside", sum_ahead("words", own))
    joined = placed.join(bases, F.col("source").eqNullSafe(F.col("source_of")) & (F.col(f"r{levels}") == F.col("range")))
    if tie:
        return joined.withColumn("before", F.col("base") + F.col("inside")).select(*sizes.columns, "before")
    # Numbered by ten thousands, so no list is long.
    part = F.lit(10_000).cast("long")
    parts = joined.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 10000"))))
    first = F.col("part") * part
    copies = parts.withColumn("copy", F.explode(F.sequence(first, first + F.least(part, F.col("n") - first) - 1)))
    return copies.withColumn("before", F.col("base") + F.col("inside") + F.col("copy") * F.col("size")).select(*sizes.columns, "before")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: str = SEED, tie: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, before, and taken: the words of the document that the mix takes.

    tie: a column of docs with a different number for each row, which then is part of the key and of the result; rows of
    one id or without id get different places, and are spread over ranges.
    """
    sizes = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *([tie] if tie else [])), "sizes")
    goal = targets(sizes, share, most, weights).withColumnRenamed("source", "source_of")
    placed = with_positions(sizes, seed, tie).join(goal, F.col("source").eqNullSafe(F.col("source_of"))).drop("source_of")
    budget = F.floor("target")
    epoch = lambda k: F.greatest(F.lit(0), F.least("size", budget - k * F.col("source_size") - F.col("before")))
    taken = epoch(0)
    for k in range(1, max(1, int(-(-most // 1)))):
        taken = taken + epoch(k)
    return placed.withColumn("taken", taken.cast("long"))


def epochs() -> Column:
    """How many epochs reach a document: whole copies of it that a mix of whole documents holds."""
    budget, size = F.floor("target"), F.greatest("source_size", F.lit(1))
    return F.greatest(F.lit(0), F.ceil((budget - F.col("before")) / size)).cast("int")
