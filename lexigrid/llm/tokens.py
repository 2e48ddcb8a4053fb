"""Token-ID output: encoding with a public tokenizer, Parquet token tables, and flat files with a separator scan.

Encoding: every text is cut at places where the tokenizer always begins a new piece (white space, and between an
ASCII letter and the punctuation or digit after it), each different piece is encoded once by the tokenizers
library and kept (those of letters alone many in one text), and the ids are put together per text. Texts with "<|", which may hold the names of special
tokens, are given to the library whole. The result equals encoding whole texts; a test holds the two together.

Nulls: a null text is an empty one and has the end id alone. A null id sorts first, and rows of one id by a hash of their
texts, so reruns agree and the rows of one id may be in several files. Columns other than the id and the text are ignored;
repeated rows are written as often as they occur.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import NONSPACE, find_words, lists, runs, shared_folder, slices, text_bytes, unlike, written

#: A new piece always begins between a byte of the first mask and one of the second.
CUTS = np.zeros((2, 256), bool)
CUTS[0, 97:123] = CUTS[1, [ord(c) for c in ".,;:!?)(\"-'0123456789"]] = True
#: Pieces that a worker keeps; beyond, it starts anew.
KEPT_PIECES = 400_000


class Encoder:
    """A tokenizer of the tokenizers library that ignores letter case and white space, with a bounded memory of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        #: By id: whether a token is the last of its word.
        self.last = np.zeros(max(words.values(), default=0) + 1, bool)
        self.last[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.flat, self.begin, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used = 0

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and the number of each, from the library piece by piece."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(length.sum())), length

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _library, for pieces of letters: many in one text, cut where tokens end words. Each piece has one word end
        at least; where there are not just as many as pieces, piece by piece."""
        groups = [pieces[k : k + 200] for k in range(0, len(pieces), 200)]
        texts = [" ".join(g) for g in groups]
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = []
        for group, ids in zip(groups, found):
            ends = np.flatnonzero(self.last[ids]) + 1
            whole = len(ends) == len(group) and ends[-1] == len(ids)
            parts.append((ids, np.diff(ends, prepend=0)) if whole else self._library(group))
        return tuple(np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [x.decode() for x in pieces]
        plain = [x.isalpha() for x in texts]
        pieces = [x for x, y in zip(pieces, plain) if y] + [x for x, y in zip(pieces, plain) if not y]
        (ids, length), (more, further) = self._joined([x for x, y in zip(texts, plain) if y]), self._library([x for x, y in zip(texts, plain) if not y])
        ids, length = np.concatenate([ids, more]), np.concatenate([length, further])
        first = len(self.places)
        while first + len(pieces) > len(self.begin):
            self.begin, self.length = np.concatenate([self.begin] * 2), np.concatenate([self.length] * 2)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[first : first + len(pieces)] = self.used + np.cumsum(length) - length
        self.length[first : first + len(pieces)] = length
        self.used += len(ids)
        self.places.update(zip(pieces, range(first, first + len(pieces))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, one after another, and n + 1 offsets."""
        raw, offsets = text_bytes(texts)
        odd = np.zeros(len(texts), bool)
        marks = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        if len(marks):
            odd[np.searchsorted(offsets, marks, "right") - 1] = True
            texts = pa.array(np.where(odd, "", texts.fill_null("").to_numpy(zero_copy_only=False)), pa.large_string())
        words = find_words(texts, NONSPACE, CUTS)
        codes, kinds = pd.factorize(words.hashes)
        one = np.empty(len(kinds), np.int64)
        one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        # Different pieces of one hash: their texts are given to the library whole.
        odd[words.texts[unlike(words, one[codes])]] = True
        if len(self.places) + len(one) > KEPT_PIECES and len(self.places):
            self.forget()
        data = words.raw.tobytes()
        pieces = [data[a:b] for a, b in zip(words.starts[one].tolist(), words.ends[one].tolist())]
        new = [x for x in pieces if x not in self.places]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))[codes]
        number = self.length[place].astype(np.int64)
        ids = self.flat[runs(self.begin[place], number)]
        ends = np.concatenate([[0], np.cumsum(number)])[words.firsts]
        if not odd.any():
            return ids, ends
        whole = iter(self.tokenizer.encode_batch_fast([x.as_py() for x, o in zip(_rows(raw, offsets), odd) if o], add_special_tokens=False))
        parts = [np.array(next(whole).ids, np.int32) if o else ids[ends[k] : ends[k + 1]] for k, o in enumerate(odd)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _rows(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(raw.tobytes()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of its text with the end id after them, in the order of the rows."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                ids, ends = tool.encode(texts[a:b])
                ids = np.insert(ids, ends[1:], end_id)
                yield pa.RecordBatch.from_arrays([names[a:b], lists(ids, ends + np.arange(len(ends)))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(encode, "doc_id bigint, ids array<int>")


def write_token_table(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 8 << 20, page_rows: int = 1000, codec: str = "zstd") -> None:
    """Writes doc_id, n_tokens and ids as Parquet in ascending doc_id order: files are ranges of ids, sorted inside.

    Ids are dictionary-encoded where their dictionary fits a page and delta-encoded otherwise; doc_id and n_tokens
    are delta-encoded. Small row groups and pages with a column index let a reader fetch a range of documents, or
    counts without ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        encoded(spread, tokenizer, end_id)
        .select("doc_id", F.size("ids").alias("n_tokens"), "ids")
        .write.option("compression", codec)
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.column.index.truncate.length", 64)
        .parquet(path)
    )


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and ids of a token table, with the number of its file and of the row in it."""
    rows = spark.read.schema("doc_id bigint, n_tokens int, ids array<int>").parquet(path)
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    return rows.select(file.alias("file"), F.expr("_metadata.row_index").alias("row"), "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The rows of the token table whose doc_id is from first to last; other row groups and pages aren't read."""
    return read_token_table(spark, path).filter(F.col("doc_id").between(first, last))


def read_tokens(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """The tokens from number begin to before end of the whole table: doc_id, start (the number of the row's first token
    in the table) and ids, cut to that range. Where documents start comes from n_tokens alone; ids are read of the
    files and rows that the range touches."""
    rows = read_token_table(spark, path)
    starts = with_starts(rows.select("file", "row", "n_tokens"), ["file", "row"])
    touched = starts.filter((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin)).select("file", "row", "start")
    low = F.greatest(F.lit(begin) - F.col("start"), F.lit(0)).cast("int")
    high = F.least(F.lit(end) - F.col("start"), F.col("n_tokens")).cast("int")
    return rows.join(touched, ["file", "row"]).select("doc_id", (F.col("start") + low).alias("start"), F.slice("ids", low + 1, high - low).alias("ids"))


def ids_digest(tokens: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sums, pa.int64())], [*keep, "ids_crc32"])

    kinds = dict(tokens.dtypes)
    return tokens.select(*keep, "ids").mapInArrow(digest, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", ids_crc32 bigint")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the token table of all documents to the shared folder and digests what is read back from its files."""
    spark = docs.sparkSession
    path = shared_folder(spark, "tokens")
    write_token_table(docs, path, tokenizer, end_id)
    return digests_of(spark, path)


def digests_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from a token table; the ids are digested before anything is joined.

    The totals behind start need n_tokens alone, so they come from scans of that column and ids are read once."""
    rows = read_token_table(spark, path)
    digested = ids_digest(rows, ["file", "row", "doc_id", "n_tokens"])
    return with_starts(digested, ["file", "row"], rows.select("file", "row", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


def with_starts(rows: DataFrame, order: list[str], counts: DataFrame | None = None, piece: int = 4096) -> DataFrame:
    """Adds start, the exclusive prefix sum of n_tokens over (file, row), by pieces of rows, files, then everything.

    order: the columns of the file's number and the row's number in it. counts: the same rows' order and n_tokens,
    where they are cheaper to compute than the rows.
    """
    file, row = order
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_pieces = lambda df: df.withColumn("piece", F.expr(f"{row} div {piece}"))
    cut = in_pieces(rows)
    totals = in_pieces(rows if counts is None else counts).groupBy(file, "piece").agg(F.sum("n_tokens").alias("total"))
    files = totals.groupBy(file).agg(F.sum("total").alias("total"))
    files = files.select(file, F.coalesce(F.sum("total").over(before.orderBy(file)), F.lit(0)).alias("file_start"))
    bases = (
        totals.withColumn("part_start", F.coalesce(F.sum("total").over(before.partitionBy(file).orderBy("piece")), F.lit(0)))
        .join(files, file)
        .select(file, "piece", (F.col("file_start") + F.col("part_start")).alias("base"))
    )
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy(file, "piece").orderBy(row)), F.lit(0))
    return cut.withColumn("inside", inside).join(bases, [file, "piece"]).withColumn("start", F.col("base") + F.col("inside")).drop("inside", "base", "piece")


# Flat files and the separator scan


def write_flat(docs: DataFrame, path: str, tokenizer: str, separator: int, rows_a_file: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes flat files of unsigned 16-bit little-endian ids, each document ended by the separator, with no index.

    Spark's text writer ends each row with a line separator of any bytes; here a row is a document's ids and
    the "line separator" is the separator's id, whose two bytes ISO-8859-1 leaves as they are. The separator must be
    outside the vocabulary, so that no text can hold it and no token is lost; ids that 16 bits can't hold are errors.
    """
    if not 0 <= separator < 1 << 16:
        raise ValueError("the separator must be an id under 65536")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts):
                ids, ends = tool.encode(texts[a:b])
                if len(ids) and ids.max() >= 1 << 16:
                    raise ValueError(f"id {ids.max()} needs more than 16 bits")
                if (ids == separator).any():
                    raise ValueError(f"the separator {separator} is an id of the vocabulary")
                flat = ids.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([flat[2 * i : 2 * j] for i, j in zip(ends[:-1], ends[1:])], pa.binary())], ["ids"])

    mark = int(separator).to_bytes(2, "little").decode("latin-1")
    (
        docs.select(F.col(text_col).cast("string"))
        .mapInArrow(pack, "ids binary")
        .select(F.col("ids").cast("string"))
        .write.option("lineSep", mark)
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", rows_a_file)
        .text(path)
    )


BLOCK = "file string, size bigint, split bigint, block bigint, bytes bigint, n_odd bigint, last_odd bigint, n_even bigint, last_even bigint, odd array<bigint>, even array<bigint>"


def _found(data: np.ndarray, low: int, high: int, breaks: np.ndarray) -> np.ndarray:
    """Places of the byte low with the byte high after it, in data cut at breaks (first bytes of pieces)."""
    places = np.flatnonzero((data[:-1] == low) & (data[1:] == high))
    return places[~np.isin(places + 1, breaks)] if len(places) else places


def scan_separators(spark: SparkSession, path: str, separator: int, block_bytes: int = 1 << 20) -> DataFrame:
    """Documents of flat token files of unsigned 16-bit little-endian ids: file (its name), doc (its number there, from 0),
    start and n_tokens, with the separator counted; the last may lack its separator (ended is false).

    Spark deals byte ranges of the files over tasks, of spark.sql.files.maxPartitionBytes each, so a file of any size is
    read by many. The bytes come as runs between bytes of the value 10, whose number is about one in a hundred or more in
    files of ids; the separator must not hold that byte. Runs are put together to blocks of block_bytes, and each is searched
    as one vector. A task doesn't know whether its first byte begins an id, so a block keeps places at odd and even
    bytes; running sums of bytes over the blocks tell which hold. A document starts after the last separator
    before its own, in that block or an earlier one: the running maximum over the blocks' last separators, and the
    running sum over their numbers of separators, carry both across blocks and tasks. An odd last byte is passed over.
    """
    low, high = divmod(separator, 256)[::-1]
    if not 0 <= separator < 1 << 16 or 10 in (low, high):
        raise ValueError("the separator must be an id under 65536 without a byte of the value 10")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, held = 0, None, []

        def blocks(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            data, breaks = text_bytes(pa.concat_arrays([r.column(3) for r in rows]), pa.large_binary())
            breaks = breaks[1:]
            places = _found(data, low, high, breaks)
            places = places + np.searchsorted(breaks, places, "right")  # the bytes of the value 10 before them
            one = [rows[0].column(k)[0].as_py() for k in range(3)]
            parts = [places[places % 2 == 1], places[places % 2 == 0]]
            ends = [x for p in parts for x in (len(p), int(p[-1]) if len(p) else None)]
            arrays = [pa.array([x], pa.string() if k == 0 else pa.int64()) for k, x in enumerate((*one, block, int(breaks[-1]) + len(breaks), *ends))] + [lists(p, np.array([0, len(p)])) for p in parts]
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in BLOCK.split(", ")])

        size = 0
        for batch in batches:
            # A task may read several ranges; their rows come one range after another.
            names = pc.binary_join_element_wise(batch.column(0), batch.column(2).cast(pa.string()), ":").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and (names[a] != last or size >= block_bytes):
                    yield blocks(held)
                    block, held, size = block + 1, [], 0
                last = names[a]
                held.append(batch.slice(a, b - a))
                size += int(pc.sum(pc.binary_length(held[-1].column(3))).as_py()) + b - a
        if held:
            yield blocks(held)

    lines = spark.read.option("lineSep", "\n").text(path)
    given = lines.select(
        F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary")
    )
    raw = written(given.mapInArrow(search, BLOCK), "blocks")
    # The scan over a file's blocks has a short row for each; places are read again afterwards, in no order.
    short = raw.drop("odd", "even")
    so_far = Window.partitionBy("file").orderBy("split", "block")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    # Spark drops a byte order mark, three bytes, at the beginning of a file: then the bytes seen are fewer than the file's.
    at = F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.when(F.sum("bytes").over(whole) < F.col("size"), 3).otherwise(0)
    half = lambda name: F.when(F.col("at") % 2 == 0, F.col(f"{name}_even")).otherwise(F.col(f"{name}_odd"))
    placed = short.withColumn("at", at).select("file", "split", "block", "at", F.expr("size div 2").alias("upto"), half("n").alias("number"), F.shiftright(half("last") + F.col("at"), 1).alias("last"))
    scanned = (
        placed.withColumn("docs_before", F.coalesce(F.sum("number").over(before), F.lit(0)))
        .withColumn("from", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))
        .withColumn("final", F.lead("block").over(so_far).isNull())
    )
    chosen = F.when(F.col("at") % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    stitched = scanned.join(raw.select("file", "split", "block", "odd", "even"), ["file", "split", "block"]).withColumn("places", F.transform(chosen, lambda p: F.shiftright(p + F.col("at"), 1)))
    tail = F.when(F.col("final") & (F.greatest(F.col("from"), F.coalesce(F.col("last") + 1, F.lit(0))) < F.col("upto")), F.array(F.col("upto") - 1))
    found = stitched.select("file", "docs_before", "from", "number", F.posexplode(F.concat("places", F.coalesce(tail, F.array().cast("array<bigint>")))).alias("k", "place"), "places")
    start = F.when(F.col("k") == 0, F.col("from")).otherwise(F.get("places", F.col("k") - 1) + 1)
    return found.select("file", (F.col("docs_before") + F.col("k")).alias("doc"), start.alias("start"), (F.col("place") - start + 1).alias("n_tokens"), (F.col("k") < F.col("number")).alias("ended"))
