"""Scans along each key's order, with hot keys cut into parts (survey groups WIN, ADV, STR).

A window over a key puts all its rows into one task. laid() cuts the keys that have more than `most` rows into up to PIECES parts at
approximate percentiles of the order's first column, so that rows of one time stay together; windows then go by key and part, and
what a part needs of those before it (the last row, a sum, the last known value) is carried over in a small table of one row
a part. Where no key is hot, nothing is cut, and plans are those of plain windows. Rows of one key and time (or null time)
are one task's.

Null keys are a key; null times come first. The order should be unique where rows are told apart by it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a key may have in one task; parts of a key that has more; keys that are cut, at most.
MOST, PIECES, HOT_KEYS = 200_000, 256, 10_000


@dataclass(frozen=True)
class Laid:
    """Rows with _part: the part of a hot key, counted along the order, or -1."""

    rows: DataFrame
    key: str
    cut: bool

    def own(self, *order: Column | str):
        return Window.partitionBy(self.key, "_part").orderBy(*order)

    def with_carried(self, rows: DataFrame, of_parts: DataFrame, name: str, how: Column) -> DataFrame:
        """rows with `name`: `how` (over the parts before, in order) of of_parts (key, _part and what `how` reads)."""
        if not self.cut:
            return rows.withColumn(name, F.lit(None).cast(of_parts.select(how.alias("x")).schema[0].dataType))
        carried = of_parts.select(F.col(self.key).alias("_key"), F.col("_part").alias("_at"), how.alias(name))
        return rows.join(carried, F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")), "left").drop("_key", "_at")

    def parts(self) -> DataFrame:
        return self.rows.filter("_part >= 0")


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def laid(rows: DataFrame, key: str, at: str, most: int = MOST) -> Laid:
    """rows cut by the number column `at`. Counts rows by key first; there are at most HOT_KEYS keys cut, as each has at least that
    share of all rows, so their percentiles may be broadcast."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    if (largest or 0) <= most:
        return Laid(rows.withColumn("_part", F.lit(-1)), key, False)
    hot = counts.filter(F.col("_n") > max(most, math.ceil(total / HOT_KEYS))).select(F.col(key).alias("_hot"), F.lit(True).alias("_is_hot"))
    marked = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")))
    cuts = marked.groupBy("_hot").agg(F.array_distinct(F.percentile_approx(F.col(at).cast("double"), F.array(*(F.lit(k / PIECES) for k in range(1, PIECES))), F.lit(10_000))).alias("_cuts"))
    placed = rows.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_hot")), "left")
    part = F.when(F.col("_cuts").isNull(), -1).when(F.col(at).isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(at))))
    return Laid(placed.withColumn("_part", part).drop("_hot", "_cuts"), key, True)


def _along(key: str):
    return Window.partitionBy(key).orderBy("_part")


def with_before(line: Laid, order: Sequence[str], columns: Sequence[str], name: str = "_before") -> DataFrame:
    """Each row with the columns of the row before, as a struct; null for a key's first."""
    row = F.struct(*columns)
    rows = line.rows.withColumn(name, F.lag(row).over(line.own(*order)))
    ends = line.parts().groupBy(line.key, "_part").agg(F.max_by(row, F.struct(*order)).alias("_end"))
    rows = line.with_carried(rows, ends, "_carried", F.lag("_end").over(_along(line.key)))
    return rows.withColumn(name, F.coalesce(name, "_carried")).drop("_carried")


def with_running(line: Laid, order: Sequence[Column | str], value: Column, name: str, ties: bool = False) -> DataFrame:
    """Each row with the sum of value from the key's beginning up to it; ties: and of all rows that are equal in the (one) order."""
    own = line.own(*order)
    frame = own.rangeBetween(Window.unboundedPreceding, 0) if ties else own.rowsBetween(Window.unboundedPreceding, 0)
    sums = line.parts().groupBy(line.key, "_part").agg(F.sum(value).alias("_sum"))
    rows = line.with_carried(line.rows.withColumn(name, F.sum(value).over(frame)), sums, "_carried", F.sum("_sum").over(_along(line.key).rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce("_carried", F.lit(0))).drop("_carried")


def with_known(line: Laid, order: Sequence[str], value: str, name: str, backward: bool = True) -> DataFrame:
    """Each row with the nearest value that isn't null at or before it (or at or after it), along the order."""
    along = [F.asc(c) if backward else F.desc(c) for c in order]
    rows = line.rows.withColumn(name, F.last(value, ignorenulls=True).over(line.own(*along).rowsBetween(Window.unboundedPreceding, 0)))
    known = line.parts().filter(F.col(value).isNotNull()).groupBy(line.key, "_part").agg((F.max_by if backward else F.min_by)(value, F.struct(*order)).alias("_end"))
    if line.cut:  # parts without a value are passed over, so each part that has rows gets a row
        known = line.parts().select(line.key, "_part").distinct().alias("p").join(known.alias("k"), F.expr(f"p.`{line.key}` <=> k.`{line.key}` AND p._part = k._part"), "left").select(f"p.{line.key}", "p._part", "k._end")
    other = Window.partitionBy(line.key).orderBy("_part" if backward else F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    rows = line.with_carried(rows, known, "_carried", F.last("_end", ignorenulls=True).over(other))
    return rows.withColumn(name, F.coalesce(name, "_carried")).drop("_carried")


def islands(rows: DataFrame, key: str, order: str, flag: Column, least: int = 1, most: int = MOST) -> DataFrame:
    """key, length, first and last of runs of at least `least` consecutive rows for which the flag holds. order: a number or time."""
    number = F.col(order).cast("double") if dict(rows.dtypes)[order] != "timestamp" else micros(F.col(order)).cast("double")
    marked = rows.select(key, order, F.coalesce(flag, F.lit(False)).alias("_flag"), number.alias("_number"))
    line = laid(marked, key, "_number", most)
    edge = with_before(line, [order], ["_flag"]).withColumn("_new", (F.col("_flag") & ~F.coalesce("_before._flag", F.lit(False))).cast("long"))
    named = with_running(Laid(edge, key, line.cut), [order], F.col("_new"), "_island").filter("_flag")
    return named.groupBy(key, "_island").agg(F.count("*").alias("length"), F.min(order).alias("first"), F.max(order).alias("last")).filter(F.col("length") >= least).drop("_island")


def counts_within(rows: DataFrame, key: str, at: str, seconds: float, name: str, own_time: bool = True, most: int = MOST) -> DataFrame:
    """rows with the number of the key's rows in so many seconds up to each one; own_time: with those of its own time. It is the
    difference of two running counts, one at the row's time and one where the window begins, so a window of any length
    costs two places a row. Rows without time get null."""
    timed = rows.filter(F.col(at).isNotNull())
    held = timed.select(F.monotonically_increasing_id().alias("_id"), F.struct(*rows.columns).alias("_row"), F.col(key).alias("_k"), micros(F.col(at)).alias("_t"))
    event = lambda t, row, sign, carried: F.struct(t.alias("t"), F.lit(row).alias("row"), F.lit(sign).alias("sign"), carried.alias("carried"))
    none = F.when(F.lit(False), F.col("_row"))
    end = event(F.col("_t") - (0 if own_time else 1), 0, 1, F.col("_row"))
    begin = event(F.col("_t") - int(seconds * 1_000_000) - 1, 0, -1, none)
    events = held.select("_id", "_k", F.explode(F.array(end, begin, event(F.col("_t"), 1, 0, none))).alias("e")).select("_id", "_k", "e.*")
    counted = with_running(laid(events, "_k", "t", 3 * most), ["t"], F.col("row"), "_c", ties=True).filter("sign <> 0")
    once = counted.groupBy("_id").agg(F.first("carried", ignorenulls=True).alias("_row"), F.sum(F.col("sign") * F.col("_c")).alias("_n"))
    lost = rows.filter(F.col(at).isNull()).withColumn(name, F.lit(None).cast("long"))
    return once.select("_row.*", F.col("_n").alias(name)).unionByName(lost)


def joined_by_time(left: DataFrame, right: DataFrame, key: str, at: str, values: Sequence[str], direction: str = "nearest", within: float | None = None, most: int = MOST) -> DataFrame:
    """left's rows, each with the values (and time_of) of one row of right of its key: the last one at or before its time
    (backward), the first at or after (forward) or the nearest in time (of two as near, the earlier); within: at most so far off.

    `at` is a number in both. Of right's rows of one key and time that with the largest values counts. Both sides are put in one
    order and scanned, so no pairs are made; left's rows without time, and those that find none, get nulls.
    """
    place = F.max(F.struct(F.col(at).alias("time_of"), *values)).alias("_right")
    kept = F.struct(*left.columns)
    one = right.filter(F.col(at).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(at).cast("double").alias("_t")).agg(place)
    one = one.select("_k", "_t", F.lit(0).alias("_side"), F.lit(None).cast(left.select(kept.alias("x")).schema[0].dataType).alias("_left"), "_right")
    two = left.select(F.col(key).alias("_k"), F.col(at).cast("double").alias("_t"), F.lit(1).alias("_side"), kept.alias("_left"), F.lit(None).cast(one.schema["_right"].dataType).alias("_right"))
    line = laid(one.unionByName(two), "_k", "_t", most)
    found = line.rows
    if direction != "forward":
        found = with_known(line, ["_t", "_side"], "_right", "_back")
    if direction != "backward":
        # From the end, rows of left come after that of right of their time.
        turned = Laid(found.withColumn("_first", -F.col("_side")), "_k", line.cut)
        found = with_known(turned, ["_t", "_first"], "_right", "_next", backward=False)
    found = found.filter("_side = 1")
    none = F.lit(None).cast(one.schema["_right"].dataType)
    back = F.col("_back") if direction != "forward" else none
    ahead = F.col("_next") if direction != "backward" else none
    gap = lambda c: F.abs(c["time_of"].cast("double") - F.col("_t"))
    best = F.when(ahead.isNull() | (gap(back) <= gap(ahead)), back).otherwise(ahead)
    found = found.withColumn("_best", F.when(F.col("_t").isNotNull(), best))
    if within is not None:
        found = found.withColumn("_best", F.when(gap(F.col("_best")) <= within, F.col("_best")))
    return found.select("_left.*", "_best.*")


def number_of(rows: DataFrame, order: str) -> Column:
    """A number along the order of the column: numbers, times and dates; 0 for other types, whose keys aren't cut."""
    kind = dict(rows.dtypes)[order]
    if kind.startswith("timestamp"):
        return micros(F.col(order))
    if kind == "date":
        return F.datediff(F.col(order), F.lit("1970-01-01").cast("date"))
    return F.col(order).cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else F.lit(0)


def line_of(rows: DataFrame, key: str, order: str, most: int = MOST) -> Laid:
    """rows laid along the column."""
    return laid(rows.withColumn("_number", number_of(rows, order)), key, "_number", most)


def silences(frames: DataFrame, key: str, at: str, level: str, threshold: float, most: int = MOST) -> DataFrame:
    """key, kind (silence or sound), first and last time and frames of each stretch of frames under the threshold, or not under it.
    A frame without level is silent."""
    quiet = F.coalesce(F.col(level) < threshold, F.lit(True))
    parts = [islands(frames, key, at, flag, most=most).withColumn("kind", F.lit(name)) for name, flag in (("silence", quiet), ("sound", ~quiet))]
    return parts[0].unionByName(parts[1]).select(key, "kind", "first", "last", "length")


def voiced_spans(frames: DataFrame, pitch: DataFrame, key: str, at: str, level: str, tone: str, threshold: float, most: int = MOST) -> DataFrame:
    """Of each key: first and last time of frames at or over the threshold whose nearest pitch frame has a tone over 0, and the core,
    from a fifth to four fifths of that span. `at` is a number in both."""
    met = joined_by_time(frames.filter(F.col(level) >= threshold).select(key, at), pitch.select(key, at, tone), key, at, [tone], most=most)
    spans = met.filter(F.col(tone) > 0).groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    share = lambda k: F.round(F.col("first") + (F.col("last") - F.col("first")) * k, 6)
    return spans.select(key, "first", "last", share(0.2).alias("core_first"), share(0.8).alias("core_last"))
