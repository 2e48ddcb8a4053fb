"""Micro-batches of usage rows (survey group STR): appended logs, additive sums by key, and a sliding limit with state.

Sums are kept as one small table for each batch, which a batch that is repeated overwrites; reading adds them up, and
compact() puts finished batches together. So no batch reads or rewrites what earlier ones wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bucket_counts(rows: DataFrame, keys: list[str], at: str, units: tuple[str, ...] = ("hour", "day")) -> DataFrame:
    """Rows per key in tumbling buckets of several units."""
    units_of = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(u, F.col(at)).alias("bucket")) for u in units]))
    return rows.select(*keys, units_of.alias("b")).groupBy(*keys, F.col("b.unit").alias("unit"), F.col("b.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def merged(old: DataFrame | None, new: DataFrame, keys: list[str], sums: list[str], latest: Sequence[str] = ()) -> DataFrame:
    """Old rows and a batch's rows by key, with sums added up and the largest of latest."""
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest])


def sum_stream(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes what aggregate makes of each batch to path/batch=<number>; trigger as in DataStreamWriter."""

    def write(batch: DataFrame, number: int) -> None:
        aggregate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def count_stream(stream: DataFrame, keys: list[str], at: str, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of a stream's rows in hour and day buckets by key."""
    return sum_stream(stream, lambda batch: bucket_counts(batch, keys, at), path, checkpoint)


def totals(spark: SparkSession, path: str, keys: list[str], sums: list[str], latest: Sequence[str] = ()) -> DataFrame:
    """All batches' rows of a sum_stream by key, with sums added up and the largest of latest; see compact()."""
    files, folder = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    aside = [int(n[9:]) for n in names if n.startswith("_compact-") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    upto = max(aside, default=-1)
    parts = [f"{path}/_compact-{upto}"] if aside else []
    parts += [f"{path}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) > upto]
    return merged(None, spark.read.parquet(*parts), keys, sums, latest)


def compact(spark: SparkSession, path: str, upto: int, keys: list[str], sums: list[str], latest: Sequence[str] = ()) -> None:
    """Puts the batches up to that number together as one of that number, in the same folder, while no batch up to it is being
    written. The sums are written aside first; then the old batches are deleted, and the new one is moved to its name. A
    compaction that stopped in between is taken up by the next one (or by totals(), which reads what was written aside in place of the
    batches that it holds), so nothing counts twice or is lost."""
    files, folder = _files(spark, path)
    aside = f"{path}/_compact-{upto}"
    done = [s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().startswith("_compact-")]
    whole = f"_compact-{upto}" in done and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{aside}/_SUCCESS"))
    if not whole:
        old = spark.read.parquet(path).filter(F.col("batch") <= upto).drop("batch")
        merged(None, old, keys, sums, latest).write.mode("overwrite").parquet(aside)
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) <= upto:
            files.delete(status.getPath(), True)
    files.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={upto}"))


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def activity(batch: DataFrame, key: str, seconds: str, at: str) -> DataFrame:
    """Seconds and latest time of each key in a batch."""
    return batch.groupBy(key).agg(F.sum(seconds).alias(seconds), F.max(at).alias(at))


def append_stream(stream: DataFrame, path: str, checkpoint: str, only: Column | None = None, **trigger) -> StreamingQuery:
    """Appends the rows (that meet a condition) to Parquet files, each row once whatever fails."""
    rows = stream if only is None else stream.filter(only)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keyword_rows(rows: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """A row for each field of a JSON object: keep, field, value; rows that aren't objects, and empty values, give none."""
    fields = rows.select(*keep, F.explode(F.from_json(body, "map<string,string>")).alias("field", "value"))
    return fields.filter("trim(value) <> ''")


def _admit(times: list[float], at: float, seconds: int, most: int) -> tuple[list[float], bool]:
    """The accepted times still in the window, with this one if there is room; a rejected one doesn't count."""
    live = [t for t in times if t > at - seconds]
    return (live + [at], True) if len(live) < most else (live, False)


def limit_stream(stream: DataFrame, key: str, at: str, seconds: int, most: int, delay: str | None = None) -> DataFrame:
    """The stream's key and time with accepted: whether fewer than `most` accepted rows of the key were in the seconds before.
    The state of a key is at most so many times. delay: how far the watermark is behind the latest time; rows older than it
    are dropped, and a key's state goes when the watermark has passed its last accepted row by the seconds. Without delay
    no row is late, and the state of every key stays."""

    def judge(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("at")
        accepted = []
        for t in rows["at"]:
            times, ok = _admit(times, t.timestamp(), seconds, most)
            accepted.append(ok)
        state.update((times,))
        if delay:
            state.setTimeoutTimestamp(max(int((max(times) + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": name[0], "at": rows["at"], "accepted": accepted})

    rows = (stream.withWatermark(at, delay) if delay else stream).select(F.col(key).alias("key"), F.col(at).alias("at"))
    kind = dict(rows.dtypes)
    expiry = GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(judge, f"key {kind['key']}, at {kind['at']}, accepted boolean", "times array<double>", "append", expiry)


def limited(rows: DataFrame, key: str, at: str, order: str, seconds: int, most: int) -> DataFrame:
    """As limit_stream for a table, with order: a number that orders rows of one time. Rows are streamed through each task in
    order, so a key of any size holds `most` times alone."""

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = None, []
        for part in parts:
            accepted = []
            for name, t in zip(part["key"], part["t"]):
                if name != last:
                    last, times = name, []
                times, ok = _admit(times, t, seconds, most)
                accepted.append(ok)
            yield pd.DataFrame({"key": part["key"], "number": part["number"], "accepted": accepted})

    used = rows.select(F.col(key).alias("key"), F.col(order).alias("number"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t")).filter("key IS NOT NULL AND t IS NOT NULL")
    kind = dict(used.dtypes)
    return used.repartition("key").sortWithinPartitions("key", "t", "number").mapInPandas(judge, f"key {kind['key']}, number {kind['number']}, accepted boolean")
