"""Sessions of a stream whose state expires (survey group STR).

The watermark runs `delay` behind the latest time seen. Rows older than it are dropped, and a key's state goes when the watermark
has passed its last row by the gap, so the state's size follows the keys of the last gap and delay and not all keys ever
seen. Null keys and times take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_stream(stream: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """key, first, last and rows of each session, once it is over: rows less than the gap apart are one session."""
    timed = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    made = timed.groupBy(F.col(key).alias("key"), F.session_window(at, gap).alias("session")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return made.select("key", "first", "last", "n")


def history_stream(stream: DataFrame, key: str, at: str, value: str, most: int, gap_seconds: int, delay: str) -> DataFrame:
    """key, n_changes and history (the last `most` different values in a row, joined by commas), once the key has had no row for
    the gap: how its value changed. Rows of a batch go in the order of time; null values are left out."""

    def follow(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, changes, values, _ = state.get
            state.remove()
            yield pd.DataFrame({"key": [name[0]], "n_changes": [changes], "history": [",".join(values)]})
            return
        last, changes, values, until = state.get if state.exists else (None, 0, [], 0)
        values = list(values)
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        for v in rows["value"]:
            if v is not None and v == v and v != last:
                changes += last is not None
                last, values = v, [*values, v][-most:]
        until = max(until, int(rows["at"].max().timestamp() * 1000))
        state.update((last, changes, values, until))
        state.setTimeoutTimestamp(max(until + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    timed = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    rows = timed.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(value).cast("string").alias("value"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandasWithState(
        follow, f"key {kind}, n_changes bigint, history string", "last string, changes bigint, history array<string>, until bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
