"""Queries of the clusters. Models can't be expressed in SQL; tests hold them against known groups and brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.operators import clusters as cl
from lexigrid.plans.queries import query
from lexigrid.sources.tables import table


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@query()
def adv13_clustered(spark, d):
    return cl.clustered(table(spark, d, "embeddings"), "vec_id", "embedding", 10).select("vec_id", "cluster")


@query()
def adv13_mixture(spark, d):
    return cl.clustered(table(spark, d, "embeddings"), "vec_id", "embedding", 4, "mixture", components=4).select("vec_id", "cluster")


@query()
def adv15_cluster_profiles(spark, d):
    found = cl.clustered(table(spark, d, "embeddings"), "vec_id", "embedding", 10, scale=True, components=8)
    return cl.cluster_profiles(found).select("cluster", "n")


@query()
def adv15_dense(spark, d):
    points = _points(spark, d)
    return cl.dense_clusters(points, "vec_id", "x", "y", cl.radius_guess(points, "vec_id", "x", "y", 4) / 2, 5)


@query()
def adv16_scanned(spark, d):
    return cl.scanned(table(spark, d, "embeddings"), "vec_id", "embedding", [2, 4, 8])


@query()
def adv17_spatial(spark, d):
    """Clusters of space and size together."""
    rows = table(spark, d, "embeddings").join(table(spark, d, "part").select(F.col("p_partkey").alias("vec_id"), "p_size"), "vec_id")
    made = cl.combined(rows, "vec_id", [F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1)), F.col("p_size")], [1.0, 1.0, 0.02])
    return cl.clustered(made, "vec_id", "vector", 5).select("vec_id", "cluster")


@query()
def adv17_hierarchical(spark, d):
    rows = table(spark, d, "embeddings").withColumn("half", F.col("label") % 5)
    return cl.nested_labels(rows, "vec_id", ["label", "half"], "embedding", 3)


@query()
def adv20_subset_clusters(spark, d):
    """Clusters of the vectors of some labels alone."""
    return cl.clustered(table(spark, d, "embeddings").filter("label < 5"), "vec_id", "embedding", 5, "bisecting").select("vec_id", "cluster")


@query()
def adv12_reduced(spark, d):
    """Principal components of the scaled vectors, up to sign."""
    return cl.reduced(table(spark, d, "embeddings"), "vec_id", "embedding", 2)
