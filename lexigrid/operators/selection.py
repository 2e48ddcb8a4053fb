"""Filters, facets, paging and text replacement (survey groups FLT, ORD, SRC)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(filters: dict[str, list]) -> Column:
    """AND over columns of OR over values; a None in a list also matches null and the empty text."""
    parts = []
    for name, values in filters.items():
        some = [v for v in values if v is not None]
        test = F.col(name).isin(some) if some else F.lit(False)
        if len(some) < len(values):
            test = test | F.col(name).isNull() | (F.col(name).cast("string") == "")
        parts.append(test)
    return reduce(and_, parts, F.lit(True))


def contains_text(columns: list[str], text: str) -> Column:
    """Any of the columns holds the text, letter case ignored, wildcards taken literally."""
    return reduce(or_, [F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c in columns], F.lit(False))


def facet(df: DataFrame, target: str, filters: dict[str, list], limit: int = 1000) -> DataFrame:
    """Values of one column under the filters on all other columns, sorted."""
    others = {k: v for k, v in filters.items() if k != target}
    return df.filter(matches(others)).select(target).distinct().orderBy(target).limit(limit)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page; the order must end in a unique key for pages to fit together."""
    return df.orderBy(*order).offset(offset).limit(limit)


def excluded_paths(name: str, rules: list[str]) -> Column:
    """True for paths that no rule names; a rule that ends in * is a prefix."""
    hit = [F.startswith(F.col(name), F.lit(r[:-1])) if r.endswith("*") else F.col(name) == r for r in rules]
    return ~F.coalesce(reduce(or_, hit, F.lit(False)), F.lit(False))


def replace_preview(df: DataFrame, columns: list[str], find: str, mode: str) -> DataFrame:
    """How many rows a replacement would touch."""
    return df.filter(_touched(columns, find, mode)).agg(F.count("*").alias("n_rows"))


def _touched(columns: list[str], find: str, mode: str) -> Column:
    test = {
        "contains": lambda c: F.contains(F.col(c), F.lit(find)),
        "exact": lambda c: F.col(c) == find,
        "empty": lambda c: F.col(c).isNull() | (F.col(c) == ""),
    }[mode]
    return F.coalesce(reduce(or_, [test(c) for c in columns]), F.lit(False))


def replace_all(df: DataFrame, columns: list[str], find: str, put: str, mode: str) -> DataFrame:
    """contains: replaces inside every listed column. exact and empty: overwrite every listed column of a touched row."""
    if mode == "contains":
        return df.withColumns({c: F.replace(F.col(c), F.lit(find), F.lit(put)) for c in columns})
    touched = _touched(columns, find, mode)
    return df.withColumns({c: F.when(touched, F.lit(put)).otherwise(F.col(c)) for c in columns})


def by_pairs(df: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key pair is listed; Spark picks the join by the list's size."""
    return df.join(pairs.select(*on).distinct(), on, "left_semi")


def equal_count(df: DataFrame, name: str, value: object) -> DataFrame:
    """Rows whose column equals the value; a None means null."""
    return df.filter(F.col(name).eqNullSafe(F.lit(value))).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """Different values of a column in order, null left out."""
    return df.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name)


def distinct_words(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: the number of different trimmed, not empty values of each column."""
    word = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return df.agg(*(F.countDistinct(word(c)).alias(c) for c in names))


def with_match(df: DataFrame, other: DataFrame, on: Column, columns: list[str]) -> DataFrame:
    """Rows for which the other table has a match (EXISTS), each once."""
    return df.join(other, on, "left_semi").select(*columns)


def with_many(df: DataFrame, key: str, other: DataFrame, other_key: str, least: int, columns: list[str]) -> DataFrame:
    """Rows whose key occurs at least so often in the other table."""
    many = other.groupBy(F.col(other_key).alias(key)).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return df.join(many, key, "left_semi").select(*columns)
