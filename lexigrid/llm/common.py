"""Vectorised text helpers and shared-folder paths used by the operators of this subpackage.

Everything here works on one Arrow batch inside a task. Texts are cut into slices of a bounded number of
bytes first, so memory follows the longest single text and not the partition.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words once A-Z are lower-cased: digits, a-z and every byte of a character outside ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Bytes other than space and the control characters 9 to 13.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array, kind: pa.DataType | None = None) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (or, of kind large_binary, a binary one) and n + 1 offsets; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(kind or pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if kind else "")
    _, where, data = texts.buffers()
    if not len(texts) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES, rows: int = 5000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text and so many rows, of one row at least."""
    offsets = text_bytes(texts)[1]
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield at, to
        at = to


class Words(NamedTuple):
    """Words of a slice: byte ranges in the lower-cased bytes, 64-bit hashes, and the first word of each text."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    @property
    def texts(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.firsts) - 1), self.counts)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = np.uint64(0x9E3779B97F4A7C15)


def _eights(raw: np.ndarray) -> np.ndarray:
    """At each byte and one beyond the last, the eight bytes from there as an integer, with zeros after the end."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word's bytes and length: words of up to seven bytes never agree, and longer ones are scrambled
    eight bytes at a time, so that no pattern of letters makes words agree."""
    eights, sizes = _eights(raw), ends - starts
    state = eights[starts] & _MASKS[np.minimum(sizes, 8)]
    long = np.flatnonzero(sizes > 7)
    state[sizes <= 7] |= sizes[sizes <= 7].astype(np.uint64) << np.uint64(56)
    state = mix64(state)
    state[long] = mix64(state[long] + sizes[long].astype(np.uint64) * _LONG)
    more = long[sizes[long] > 8]
    done = 8
    while len(more):
        chunk = eights[starts[more] + done] & _MASKS[np.minimum(sizes[more] - done, 8)]
        state[more] = mix64((state[more] ^ chunk) + _LONG)
        done += 8
        more = more[sizes[more] > done]
    return state


def unlike(words: Words, other: np.ndarray) -> np.ndarray:
    """The numbers of words whose bytes differ from those of the words with the numbers `other`, which have their hashes."""
    eights, sizes = _eights(words.raw), words.ends - words.starts
    check = np.flatnonzero((sizes > 7) & (other != np.arange(len(other))))
    bad, done = [check[sizes[check] != sizes[other[check]]]], 0
    check = check[sizes[check] == sizes[other[check]]]
    while len(check):
        apart = (eights[words.starts[check] + done] ^ eights[words.starts[other[check]] + done]) & _MASKS[np.minimum(sizes[check] - done, 8)] != 0
        bad.append(check[apart])
        done += 8
        check = check[~apart & (sizes[check] > done)]
    return np.concatenate(bad)


def word_strings(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Words as strings, of bytes that are inside a word and where each word starts and ends in them."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    data = pa.py_buffer(raw[inside].tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), data])


def word_edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that are inside a word, never over the edge of two texts, and each run's text."""
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    before[edge] = False
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def find_words(texts: pa.Array, kind: np.ndarray = WORD, cut: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Maximal runs of bytes of `kind` in the A-Z-lower-cased texts; words never span texts.

    cut: runs are cut besides between a byte of the first mask and one of the second.
    Hashes are 64 bits (see word_hashes): for words of over seven bytes, among a billion different ones that aren't made
    to collide, the chance that any two agree is under 3 in 100. Where that isn't enough, unlike() compares bytes.
    """
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    inside = kind[raw]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(raw):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[:-1][np.diff(offsets) > 0]
        before[edge] = False
        after[edge[edge > 0] - 1] = False
        if cut is not None:
            places = np.flatnonzero(cut[0][raw[:-1]] & cut[1][raw[1:]])
            before[places + 1] = False
            after[places] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(raw, starts, ends, word_hashes(raw, starts, ends), np.searchsorted(starts, offsets))


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers, then the same for the next one."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out[:0]
    s, c = starts[has], counts[has]
    out[0] = s[0]
    heads = np.cumsum(c)[:-1]
    out[heads] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out, out=out)


def lists(flat: np.ndarray | pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


#: The folders that each open scratch() block of the current thread (or task of an event loop) is to delete.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """At the end of the block, deletes the folders that were named in it and aren't kept. For work whose results are written
    in the block: nothing that is read later may depend on the deleted folders. Blocks of other threads are others: a table is
    deleted by the block that it was written in alone."""
    made: list[str] = []
    before = _scratch.set((*_scratch.get(), made))
    try:
        yield
    finally:
        _scratch.reset(before)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share. Where that is unset, a local one in local
    mode; on a cluster an error, as executors would write to their own disks. keep: the innermost scratch() block leaves it to
    the one around it, if any."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/lexigrid-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    blocks = _scratch.get()[:-1] if keep else _scratch.get()
    if blocks:
        blocks[-1].append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name, keep)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """All columns in one, `row`, so that none of their names can clash with others."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"))


def numbered(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The written rows with row_key (df has no column of that name): a different number for each, from its file and its place there, so it stays the same
    however often the rows are read."""
    rows = written(df, name, keep, maxRecordsPerFile="0")
    file = F.regexp_extract("_metadata.file_name", r"^part-(\d+)-", 1).cast("long")
    return rows.select(*df.columns, (F.shiftleft(file, 33) + F.col("_metadata.row_index")).alias("row_key"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, of: int):
    """crc32 of the id as text, modulo `of`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


#: Keys with at least so many rows are dealt over several tasks, and at most so many keys are.
HOT_ROWS, HOT_KEYS = 256, 100_000


def hot_salts(counts: DataFrame, key: str, rows: str) -> tuple[DataFrame, int]:
    """Of counts (a row for each key, with its number of rows): the key and salts (the tasks to deal it over) of hot keys,
    and the rows that a task gets. There are at most HOT_KEYS of them, as each has at least that share of all
    rows, so they may be broadcast."""
    total = counts.agg(F.sum(rows)).first()[0] or 0
    part = max(HOT_ROWS, math.ceil(total / HOT_KEYS))
    return counts.filter(F.col(rows) > part).select(key, F.ceil(F.col(rows) / part).cast("int").alias("salts")), part


def salted_join(large: DataFrame, small: DataFrame, hot: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """large joined with small (a row for each key) by key; the rows of hot keys (see hot_salts) are dealt over tasks by the
    column spread, and their one small row is repeated for each."""
    hot = F.broadcast(hot)
    dealt = large.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(spread), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = small.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, [key, "salt"], how).drop("salt")
