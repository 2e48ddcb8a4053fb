"""Clusters of vectors by Spark ML (survey group ADV): scaling, reduction, k-means and mixtures, scans over k, profiles.

Vectors are arrays of numbers of one length; rows whose vector is null or holds nulls take no part. Labels of different
runs aren't comparable; a seed makes a run repeatable on the same partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def features(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and features (a vector of doubles)."""
    v = F.col(vector).cast("array<double>")
    return rows.select(key, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull())).select(key, array_to_vector("_v").alias("features"))


def combined(rows: DataFrame, key: str, columns: Sequence[Column], weights: Sequence[float]) -> DataFrame:
    """key and a vector of weighted columns, null as 0: features of space beside those of characters, for instance."""
    return rows.select(key, F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) * w for c, w in zip(columns, weights))).alias("vector"))


def prepared(rows: DataFrame, scale: bool, components: int | None) -> DataFrame:
    """features scaled to mean 0 and deviation 1, and reduced to so many principal components."""
    stages, column = [], "features"
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol=column, outputCol="_scaled"))
        column = "_scaled"
    if components:
        stages.append(PCA(k=components, inputCol=column, outputCol="_reduced"))
        column = "_reduced"
    if not stages:
        return rows
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    return out.withColumn("features", F.col(column)).drop("_scaled", "_reduced")


def reduced(rows: DataFrame, key: str, vector: str, components: int) -> DataFrame:
    """key and p1, p2, ...: the scaled vectors' principal components, rounded to 6 places."""
    found = prepared(features(rows, key, vector), True, components).select(key, vector_to_array("features").alias("p"))
    return found.select(key, *(F.round(F.get("p", F.lit(k)), 6).alias(f"p{k + 1}") for k in range(components)))


def clustered(rows: DataFrame, key: str, vector: str, k: int, method: str = "kmeans", scale: bool = False, components: int | None = None, seed: int = 7) -> DataFrame:
    """key, cluster and features. method: kmeans, mixture (Gaussians) or bisecting (a hierarchy from the top)."""
    kinds = {"kmeans": KMeans, "mixture": GaussianMixture, "bisecting": BisectingKMeans}
    used = prepared(features(rows, key, vector), scale, components)
    model = kinds[method](k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(used)
    return model.transform(used).select(key, "cluster", "features")


def scanned(rows: DataFrame, key: str, vector: str, ks: Sequence[int], seed: int = 7) -> DataFrame:
    """Of each k: silhouette (squared Euclidean) and cost of k-means over the same features, which stay cached for the scan."""
    used = features(rows, key, vector).cache()
    found = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(used)
        found.append((k, float(ClusteringEvaluator().evaluate(model.transform(used))), float(model.summary.trainingCost)))
    used.unpersist()
    return rows.sparkSession.createDataFrame(found, "k int, silhouette double, cost double")


def cluster_profiles(found: DataFrame) -> DataFrame:
    """Rows and centre of each cluster of clustered(): cluster, n, centre."""
    long = found.select("cluster", F.posexplode(vector_to_array("features")).alias("i", "x"))
    cells = long.groupBy("cluster", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return cells.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("centre"))


def nested_labels(rows: DataFrame, key: str, levels: Sequence[str], vector: str, k: int, seed: int = 7) -> DataFrame:
    """Clusters of the mean vectors of each level's regions: level, region, cluster."""
    out = None
    for level in levels:
        long = rows.filter(F.col(level).isNotNull()).select(F.col(level).cast("string").alias("region"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
        means = long.groupBy("region", "i").agg(F.avg("x").alias("m")).groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("mean"))
        part = clustered(means, "region", "mean", k, seed=seed).select(F.lit(level).alias("level"), "region", "cluster")
        out = part if out is None else out.unionByName(part)
    return out


def dense_clusters(points: DataFrame, key: str, x: str, y: str, radius: float, least: int, most_rounds: int = 50) -> DataFrame:
    """Density clusters of points of the plane: key and cluster (its least core key; null for noise).

    A core point has at least `least` points, itself among them, within the radius; cores within the radius of one another
    are one cluster, other points belong to the nearest core within the radius. Points meet in a grid of the radius, by an
    equi-join; labels spread by the least label around, at most so many rounds (an error, if they don't settle)."""
    from lexigrid.sources.tables import export

    spark = points.sparkSession
    at = lambda c: F.floor(F.col(c) / radius)
    own = points.select(F.col(key).alias("a"), F.col(x).alias("x"), F.col(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    laid = own.withColumns({"cx": at("x"), "cy": at("y")})
    around = own.select(F.col("a").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.sequence(at("x") - 1, at("x") + 1)).alias("cx"), F.col("y")).select("b", "bx", "by", "cx", F.explode(F.sequence(at("y") - 1, at("y") + 1)).alias("cy"))
    near = laid.join(around, ["cx", "cy"]).withColumn("d", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))).filter(F.col("d") <= radius).select("a", "b", "d")
    near = spark.read.parquet(export(near, "parquet"))
    cores = spark.read.parquet(export(near.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("a"), "parquet"))
    links = near.join(cores, "a", "left_semi").join(cores.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    labels = cores.select("a", F.col("a").alias("label"))
    for _ in range(most_rounds):
        best = links.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(best, "a").join(labels.select(F.col("a").alias("near"), F.col("label").alias("further")), "near").select("a", "label", F.least("near", "further").alias("next"))
        moved = spark.read.parquet(export(moved, "parquet"))
        labels = moved.select("a", F.col("next").alias("label"))
        if moved.filter("next < label").isEmpty():
            break
    else:
        raise ValueError(f"labels don't settle in {most_rounds} rounds")
    reach = near.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min(F.struct("d", "b", "label")).alias("best"))
    named = reach.join(labels, "a", "left").select(F.col("a").alias(key), F.coalesce("label", "best.label").alias("cluster"))
    return points.select(key).join(named, key, "left")


def radius_guess(points: DataFrame, key: str, x: str, y: str, k: int, sample: int = 2000) -> float:
    """The 90th percentile of the distance to the k-th nearest of a sample of at most so many points (by a hash of the key), a
    radius to begin with; 0 with no more than k points."""
    rows = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL").orderBy(F.md5(F.col(key).cast("string")), key).limit(sample)
    met = rows.crossJoin(F.broadcast(rows.select(F.col(key).alias("_b"), F.col("x").alias("bx"), F.col("y").alias("by")))).filter(F.col(key) != F.col("_b"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("d", "_b"))
    kth = met.withColumn("d", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))).withColumn("k", place).filter(F.col("k") == k)
    return float(kth.agg(F.percentile_approx("d", F.lit(0.9))).first()[0] or 0.0)
