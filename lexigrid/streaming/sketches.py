"""Distinct users and quantiles of micro-batches as sketches that merge (survey groups STR, AGG).

Each batch adds a small row for each key and hour: a count, a HyperLogLog sketch of users and a KLL sketch of values, written by
sum_stream(). Any range of batches, hours or keys is put together when it is read, so no batch reads what earlier ones wrote,
and a repeated batch overwrites its own rows. With 2^12 registers the standard error of distinct counts is 1.6 percent; with
k = 400 a quantile's rank is within about 0.9 percent. distinct_pairs() is the exact form, a row for each key, day and user.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTERS, KLL = 12, 400


def sketched(batch: DataFrame, keys: Sequence[str], at: str, user: str, value: str) -> DataFrame:
    """keys, bucket (the hour), n, users and amounts (sketches; null users and values take no part)."""
    return batch.groupBy(*keys, F.date_trunc("hour", at).alias("bucket")).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(user, REGISTERS).alias("users"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL).alias("amounts")
    )


def read_sketches(rows: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """keys, n, users (the estimate) and a column q<percent> for each quantile, of sketched rows."""
    merged = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.kll_merge_agg_double("amounts").alias("amounts"))
    held = F.kll_sketch_get_n_double("amounts") > 0
    named = [F.when(held, F.kll_sketch_get_quantile_double("amounts", F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles]
    return merged.select(*keys, "n", "users", *named)


def sketch_totals(spark: SparkSession, path: str, keys: Sequence[str], quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """read_sketches() of all batches in the folder of a sum_stream()."""
    return read_sketches(spark.read.parquet(path), keys, quantiles)


def distinct_pairs(batch: DataFrame, keys: Sequence[str], at: str, user: str) -> DataFrame:
    """Different keys, day and user of a batch; those of several batches are made distinct when they are read."""
    return batch.filter(F.col(user).isNotNull()).select(*keys, F.to_date(at).alias("day"), F.col(user).alias("user")).distinct()


def distinct_totals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and users, exactly, of distinct_pairs() rows."""
    return rows.groupBy(*keys).agg(F.countDistinct("user").alias("users"))
