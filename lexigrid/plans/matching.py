"""Queries of names matched with terms in batches. No SQL: the longest common subsequence isn't one of its functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.operators import matching
from lexigrid.plans.queries import query
from lexigrid.sources.tables import table

#: Letters that sound alike, each with the sign of their sound.
SOUNDS = [("c", "k"), ("q", "k"), ("z", "s"), ("y", "i"), ("v", "f"), ("w", "f"), ("d", "t"), ("b", "p"), ("e", ""), ("h", "")]


def _words(spark, d, name, column):
    return table(spark, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias(column)).distinct()


@query()
def adv39_fuzzy_matches(spark, d):
    """All words of documents, as names, for all words of benchmark, as terms."""
    terms = _words(spark, d, "benchmark", "term")
    return matching.match_batch(_words(spark, d, "documents", "name"), terms.withColumn("variant", F.col("term")), 0.7, spark.createDataFrame(SOUNDS, "char string, sound string"))
