"""Nearest neighbours by an adaptive dimension scan inside probed lists.

Vectors are assigned to the nearest of the centroids of a bounded sample, and lists are split into tiles of a
bounded size, so that a list with a third of all vectors is many tiles. Queries, in blocks, meet the tiles of the lists
they probe. In a tile the vectors are rotated at random and read in column blocks: after each block a candidate is
abandoned when its partial distance, scaled to all dimensions, exceeds the best-known k-th distance by a
margin that a hypothesis test on random rotations gives. Survivors are measured exactly on the original vectors.

A first pass over each query's nearest list gives it a k-th distance, with which the second pass abandons early. How many
lists a query probes is measured on the sample: as many as hold a given share of its vectors' nearest neighbours, so data in
clusters need few. Empty lists don't count as probes, and queries that found fewer than k go on to all the others.

Nulls: vectors that are null, zero, hold null or non-finite components, or have another length than most of the
sample, take no part; nor do rows without id. Rows are told apart by a number of their own: other rows with a query's id
are its candidates, and each row of a repeated query id is a query. Ties go to the smaller id. Fewer candidates than k
give all of them. Empty tables give empty results.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import numbered, scratch, written

TILE = 4096
BLOCK = 16
#: Of the test: with this many deviations a candidate that belongs is abandoned in well under one of a hundred cases.
DEVIATIONS = 2.1


class Index(NamedTuple):
    centroids: np.ndarray
    rotation: np.ndarray
    probe_share: float


def _fine(name: str):
    v = F.col(name)
    return F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0)


def fit(vectors: DataFrame, n_lists: int, sample: int = 20_000, rounds: int = 10, seed: int = 11, k: int = 10, found: float = 0.98) -> Index:
    """Centroids by k-means over a sample of at most `sample` vectors (by a hash of the id), a random rotation, and the share
    of lists that holds a share `found` of the k nearest of 256 of the sample's vectors."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().column("v").combine_chunks()
    lengths = np.asarray(rows.value_lengths())
    if not len(lengths):
        return Index(np.zeros((1, 1)), np.eye(1), 1.0)
    usual = np.bincount(lengths).argmax()
    data = rows.filter(pa.array(lengths == usual)).flatten().to_numpy().reshape(-1, usual)
    random = np.random.RandomState(seed)
    distinct = data[np.sort(np.unique(data, axis=0, return_index=True)[1])]
    centres = distinct[random.permutation(len(distinct))[:n_lists]]
    for _ in range(rounds):
        near = _nearest(data, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        sizes = np.bincount(near, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    rotation, _ = np.linalg.qr(random.normal(size=(usual, usual)))
    centres = np.unique(centres, axis=0)
    return Index(centres, rotation, _probe_share(data, centres, k, found))


def _probe_share(data: np.ndarray, centres: np.ndarray, k: int, found: float) -> float:
    """The sample is thinner than the table, so its neighbours are farther and in more lists than the table's."""
    if len(data) < 2:
        return 1.0
    asked = data[:256]
    far = (asked**2).sum(axis=1)[:, None] - 2 * asked @ data.T + (data**2).sum(axis=1)
    np.fill_diagonal(far, np.inf)
    k = min(k, len(data) - 1)
    best = np.argpartition(far, k - 1, axis=1)[:, :k]
    rank = np.argsort(_nearest(asked, centres, len(centres)), axis=1)
    ranks = np.sort(np.take_along_axis(rank, _nearest(data, centres)[:, 0][best], axis=1).ravel())
    return float((ranks[min(len(ranks) - 1, int(np.ceil(found * len(ranks))) - 1)] + 1) / len(centres))


def _nearest(data: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    far = -2 * data @ centres.T + (centres**2).sum(axis=1)
    if k == 1:
        return far.argmin(axis=1)[:, None]
    if k >= len(centres):
        return np.argsort(far, axis=1, kind="stable")
    some = np.argpartition(far, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def assigned(vectors: DataFrame, index: Index, probes: int) -> DataFrame:
    """Adds lists: the nearest `probes` lists, nearest first; vectors of another length are left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    kinds = vectors.dtypes

    def assign(batches):
        centres = shared.value.centroids
        width = centres.shape[1]
        for batch in batches:
            batch = batch.filter(pa.array(np.asarray(batch.column("v").value_lengths()) == width))
            if batch.num_rows:
                near = _nearest(_matrix(batch.column("v"), width), centres, probes).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "lists"])

    return vectors.mapInArrow(assign, ", ".join(f"{k} {t}" for k, t in kinds) + ", lists array<int>")


def scan(x: np.ndarray, q: np.ndarray, rotated: np.ndarray, q_rotated: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x that may be among the k nearest to q, with exact distances; limit: a distance known to suffice, or
    over 1e150 if none is: then at least k rows (all, if fewer) are found."""
    width = x.shape[1]
    alive, partial = np.arange(len(x)), np.zeros(len(x))
    bound = min(limit, 1e150) ** 2
    for lo in range(0, width, BLOCK):
        hi = min(lo + BLOCK, width)
        part = rotated[alive, lo:hi] if lo else rotated[:, lo:hi]
        partial = partial + ((part - q_rotated[lo:hi]) ** 2).sum(axis=1)
        if hi == width:
            break
        if not lo and len(x) > 2 * k:
            # The candidates nearest in the first block give a k-th distance before anything is abandoned.
            first = np.argpartition(partial, 2 * k)[: 2 * k]
            bound = min(bound, np.partition(((x[first] - q) ** 2).sum(axis=1), k - 1)[k - 1])
        keep = partial * (width / hi) <= bound * (1 + DEVIATIONS / np.sqrt(hi)) ** 2
        alive, partial = alive[keep], partial[keep]
    if limit >= 1e150 and len(alive) < min(k, len(x)):
        alive, partial = np.arange(len(x)), ((rotated - q_rotated) ** 2).sum(axis=1)
        bound = np.partition(partial, min(k, len(x)) - 1)[min(k, len(x)) - 1]
    if len(alive) > k:
        bound = min(bound, np.partition(partial, k - 1)[k - 1])
    alive = alive[partial <= bound * (1 + 1e-9) + 1e-12]
    return alive, np.sqrt(((x[alive] - q) ** 2).sum(axis=1))


def _search(base: DataFrame, queries: DataFrame, index: Index, k: int, sizes: DataFrame) -> DataFrame:
    """base: row_key, vec_id, v, list. queries: query_key, query_id, q, limit, list. sizes: list and splits, a row for each
    list, so it may be broadcast. Up to k rows (and ties) per query and tile. The tiles of a list are repeated for blocks
    of the queries that probe it."""
    shared = queries.sparkSession.sparkContext.broadcast(index)
    probed = queries.groupBy("list").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("blocks"))
    tiled = F.broadcast(sizes.join(F.broadcast(probed), "list"))

    def look(mine: pa.Table, asked: pa.Table) -> pa.Table:
        rotation = shared.value.rotation
        width = len(rotation)
        if mine.num_rows and asked.num_rows:
            x, ids, rows = _matrix(mine.column("v"), width), mine.column("vec_id").to_numpy(), mine.column("row_key").to_numpy()
            qs, keys, names, limits = _matrix(asked.column("q"), width), *(asked.column(c).to_numpy() for c in ("query_key", "query_id", "limit"))
            rotated, q_rotated = x @ rotation, qs @ rotation
            out = []
            for n in range(len(qs)):
                at, score = scan(x, qs[n], rotated, q_rotated[n], k + int((rows == keys[n]).any()), limits[n])
                other = rows[at] != keys[n]
                at, score = at[other], score[other]
                best = np.lexsort((ids[at], score))[:k]
                out.append((np.full(len(best), keys[n]), np.full(len(best), names[n]), ids[at[best]], score[best]))
            key, query, found, score = (np.concatenate([o[i] for o in out]) for i in range(4))
        else:
            key, query, found, score = *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0)
        return pa.table({"query_key": key, "query_id": query, "vec_id": found, "score": score})

    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = lambda key, n: F.pmod(F.xxhash64(key, F.lit(5)), F.col(n)).cast("int")
    left = base.join(tiled, "list").select("row_key", "vec_id", "v", "list", dealt("row_key", "splits").alias("split"), F.explode(up_to("blocks")).alias("block"))
    right = queries.join(tiled, "list").select("query_key", "query_id", "q", "limit", "list", F.explode(up_to("splits")).alias("split"), dealt("query_key", "blocks").alias("block"))
    key = ("list", "split", "block")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(look, "query_key bigint, query_id bigint, vec_id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_key").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_key", "query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", n_lists: int | None = None, probe_share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others of the vectors for which the condition `queries` on
    vec_id holds. n_lists: about half the square root of the number of vectors, 512 at most, unless given.
    probe_share: the share of lists that a query probes, as measured by fit() unless given.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(_fine("v"))
    total = vectors.count()
    n_lists = n_lists or int(min(512, max(4, round(total**0.5 / 2))))
    with scratch(vectors.sparkSession):  # all but the result goes when it is written
        index = fit(rows, n_lists, k=k)
        base = numbered(assigned(rows, index, 1).select("vec_id", "v", F.col("lists")[0].alias("list")), "lists")
        sizes = written(base.groupBy("list").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("splits")).coalesce(1), "sizes")
        asked = base.select("row_key", "vec_id", "v").filter(queries(F.col("vec_id")))
        filled = sorted(r.list for r in sizes.select("list").collect())
        if not filled:
            return rows.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0D AS score").limit(0)
        probes = min(len(filled), max(2, int(np.ceil((probe_share or index.probe_share) * len(filled)))))
        every = F.array(*map(F.lit, filled))
        lists = F.transform("lists", lambda k: F.get(every, k)).alias("lists")
        asked = written(assigned(asked, index._replace(centroids=index.centroids[filled]), probes).select(F.col("row_key").alias("query_key"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), lists), "queries")
        columns = ("query_key", "query_id", "q", "limit")
        opened = asked.withColumn("limit", F.lit(1e300)).select(*columns, F.col("lists")[0].alias("list"))
        near = written(_best(_search(base, opened, index, k, sizes), k), "near")
        limits = near.groupBy("query_key").agg(F.max("score").alias("worst"), F.count("*").alias("n")).select("query_key", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(1e300)).alias("limit"))
        further = asked.join(limits, "query_key", "left").withColumn("limit", F.coalesce("limit", F.lit(1e300)))
        further = further.select(*columns, F.explode(F.slice("lists", 2, probes)).alias("list"))
        found = written(_best(near.drop("rank").unionByName(_search(base, further, index, k, sizes)), k), "found", keep=True)
        enough = found.groupBy("query_key").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_key")
        short = asked.join(enough, "query_key", "left_anti").withColumn("limit", F.lit(1e300)).select(*columns, F.explode(F.array_except(every, "lists")).alias("list"))
        if not short.isEmpty():
            found = written(_best(found.drop("rank").unionByName(_search(base, short, index, k, sizes)), k), "found", keep=True)
    return found.drop("query_key")
