"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each row is a segment, that is a slice of documents with its own sorted
dictionary of terms and, for each term, the ascending positions of its occurrences. Segments are bounded by bytes
of text, so one term that is in every document is spread over all segments. A phrase is looked up in a segment
from its rarest term there: the postings of that term, moved back by the term's offset, are candidate starts, and
the offset-adjusted postings of the next rarest terms are intersected with them in turn. Each window is filed under the term
that fewest windows hold, and a segment looks only at the windows filed under terms of its dictionary, so its cost follows
its own size and not the number of windows.

Nulls: a null text has no words; a null doc_id is carried through. Empty tables give empty results. Columns other
than the id and the text are ignored. Repeated documents each give a row; repeated query ids count once.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import find_words, lists, runs, slices, written

SEGMENT = "segment bigint, doc_ids array<bigint>, word_counts array<int>, terms array<bigint>, term_counts array<int>, positions array<int>"
#: Windows that one pass over the index takes; they are broadcast, ten terms of eight bytes each and as much again for
#: what finds them.
WINDOWS_A_PASS = 500_000


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the positional index of all words of all texts to the shared folder and returns it. A row group holds one segment:
    Spark's writer and reader have a whole row group in memory, and by its bytes alone Parquet ends one after a hundred rows at the
    earliest, which would be all segments of a task."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                words = find_words(texts[a:b])
                order = np.argsort(words.hashes, kind="stable")
                ordered = words.hashes[order]
                heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else order
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([secrets.randbits(62)]),
                        one(ids[a:b].cast(pa.int64()), None),
                        one(words.counts, pa.int32()),
                        one(ordered[heads].view(np.int64), pa.int64()),
                        one(np.diff(np.append(heads, len(ordered))), pa.int32()),
                        one(order, pa.int32()),
                    ],
                    ["segment", "doc_ids", "word_counts", "terms", "term_counts", "positions"],
                )

    # Ids and postings are bit-packed; a dictionary of them would only grow beside them.
    return written(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(segments, SEGMENT),
        "postings",
        **{"parquet.enable.dictionary": "false", "parquet.writer.version": "v2", "parquet.block.row.count.limit": "1"},
    )


def windows_of(queries: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Every run of `size` words of each query text (all its words if fewer, none if it has none): id, terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            for a, b in slices(texts):
                words = find_words(texts[a:b])
                counts = words.counts
                number = np.where(counts > size, counts - size + 1, (counts > 0).astype(np.int64))
                starts = runs(words.firsts[:-1], number)
                length = np.repeat(np.minimum(counts, size), number)
                flat = words.hashes[runs(starts, length)].view(np.int64)
                owner = np.repeat(np.arange(b - a), number)
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b].take(pa.array(owner)), lists(flat, np.concatenate([[0], np.cumsum(length)]))], ["query_id", "terms"]
                )

    return queries.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        cut, "query_id bigint, terms array<bigint>"
    )


class Segment:
    """One row of the index, ready for lookups."""

    def __init__(self, row: dict[str, pa.ListScalar]):
        get = lambda k: row[k].values.to_numpy(zero_copy_only=False)
        self.terms, counts, self.positions = get("terms").view(np.uint64), get("term_counts").astype(np.int64), get("positions").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.word_counts = get("word_counts").astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.word_counts)])
        self.n = max(int(self.firsts[-1]), 1)
        self.postings = np.repeat(np.arange(len(self.terms)), counts) * self.n + self.positions

    def look_up(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms in the dictionary, and how often they occur (0: not at all)."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, np.where(self.terms[at] == terms, np.diff(self.starts)[at], 0)

    def phrases(self, terms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the phrases that occur and the positions at which they do. terms: a padded row for each phrase."""
        width = terms.shape[1]
        at, found = self.look_up(terms)
        found = np.where(np.arange(width) < lengths[:, None], found, np.iinfo(np.int64).max)
        alive = np.flatnonzero((found > 0).all(axis=1) & (lengths > 0))
        at, found = at[alive], found[alive]
        rarest_first = np.argsort(found, axis=1, kind="stable")
        rows = np.arange(len(alive))
        if not len(alive):
            return alive, alive
        slot = rarest_first[:, 0]
        number = found[rows, slot]
        phrase = np.repeat(rows, number)
        begin = self.positions[runs(self.starts[at[rows, slot]], number)] - slot[phrase]
        for k in range(1, width):
            more = lengths[alive][phrase] > k
            if not more.any():
                break
            slot = rarest_first[phrase, k]
            wanted = at[phrase, slot] * self.n + begin + slot
            place = np.minimum(np.searchsorted(self.postings, wanted), len(self.postings) - 1)
            inside = (begin + slot >= 0) & (begin + slot < self.n)
            keep = ~more | (inside & (self.postings[place] == wanted))
            phrase, begin = phrase[keep], begin[keep]
        phrase_of = alive[phrase]
        doc = np.searchsorted(self.firsts, begin, "right") - 1
        keep = (begin >= 0) & (begin + lengths[phrase_of] <= self.firsts[np.minimum(doc + 1, len(self.firsts) - 1)])
        return phrase_of[keep], begin[keep]

    def near(self, terms: np.ndarray, length: int, slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term within `slop` words in the same text."""
        at, found = self.look_up(terms[:length])
        if not length or not (found > 0).all():
            return np.zeros(0, np.int64)
        order = np.argsort(found, kind="stable")
        of = lambda k: self.positions[self.starts[at[k]] : self.starts[at[k] + 1]]
        begin = of(order[0])
        for k in order[1:]:
            doc = np.searchsorted(self.firsts, begin, "right") - 1
            low, high = np.maximum(begin - slop, self.firsts[doc]), np.minimum(begin + slop, self.firsts[doc + 1] - 1)
            begin = begin[np.searchsorted(of(k), high, "right") > np.searchsorted(of(k), low)]
        return begin


def _blocks(windows: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query windows in blocks of a bounded size: ids, padded terms, lengths."""
    rows = windows.toLocalIterator()
    while block := list(islice(rows, WINDOWS_A_PASS)):
        lengths = np.array([len(r[1]) for r in block], np.int64)
        terms = np.zeros((len(block), int(lengths.max(initial=0))), np.int64)
        for k, r in enumerate(block):
            terms[k, : len(r[1])] = r[1]
        yield np.array([np.nan if r[0] is None else r[0] for r in block], object), terms.view(np.uint64), lengths


class Windows(NamedTuple):
    """A block of query windows, filed under one term each."""

    item_of: np.ndarray
    items: pa.Array
    terms: np.ndarray
    lengths: np.ndarray
    keys: np.ndarray
    firsts: np.ndarray
    order: np.ndarray

    def of_segment(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of the windows that are filed under one of these terms."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, terms), len(self.keys) - 1)
        at = at[self.keys[at] == terms]
        return self.order[runs(self.firsts[at], self.firsts[at + 1] - self.firsts[at])]


def filed(ids: np.ndarray, terms: np.ndarray, lengths: np.ndarray) -> Windows:
    inside = np.arange(terms.shape[1]) < lengths[:, None]
    known, counts = np.unique(terms[inside], return_counts=True)
    often = np.full(terms.shape, np.iinfo(np.int64).max)
    often[inside] = counts[np.searchsorted(known, terms[inside])]
    key = np.take_along_axis(terms, often.argmin(axis=1)[:, None], axis=1)[:, 0] if terms.shape[1] else np.zeros(len(terms), np.uint64)
    order = np.argsort(key, kind="stable")
    keys, firsts = np.unique(key[order], return_index=True)
    return Windows(*_numbers(ids), terms, lengths, keys, np.append(firsts, len(order)), order)


FOUND = "segment bigint, doc bigint, doc_id bigint, n_words bigint, spans array<struct<begin:int,end:int>>, items array<bigint>"


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans of each document."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    base = doc * (int(end.max()) + 1)
    reach = np.maximum.accumulate(base + end)
    head = np.concatenate([[True], (base[1:] + begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(doc) - 1)
    return doc[head], begin[head], reach[last] - base[last]


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index: DataFrame | None = None
) -> DataFrame:
    """One row per document: doc_id, n_words, the merged spans of words that a window of a benchmark item covers,
    and the ids of the items with such windows.

    Windows go through the index in blocks of WINDOWS_A_PASS. With more than one, each block's findings are written and its
    broadcast is given up before the next, so the driver and the workers hold two blocks at most; a document's findings are
    merged by segment (a random 62-bit name) and number, and documents without any come from the last pass.
    """
    index = build_index(docs, id_col, text_col) if index is None else index
    context = docs.sparkSession.sparkContext
    passes: list[DataFrame] = []
    last = filed(np.zeros(0, object), np.zeros((0, size), np.uint64), np.zeros(0, np.int64))
    for k, block in enumerate(_blocks(windows_of(benchmark, item_col, item_text, size))):
        if k:
            shared = context.broadcast(last)
            passes.append(written(_one_pass(index, shared).filter(F.size("items") > 0), "found"))
            shared.destroy()
        last = filed(*block)
    together = _one_pass(index, context.broadcast(last))
    if not passes:
        return together.drop("segment", "doc")
    for p in passes:
        together = together.unionByName(p)
    sweep = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.expr("cast(array() as array<struct<begin:int,end:int>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, F.lit(-1))["end"] >= x["begin"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, F.lit(-1))["begin"].alias("begin"), F.greatest(F.element_at(done, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    return together.groupBy("segment", "doc").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), sweep.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    ).drop("segment", "doc")


def _one_pass(index: DataFrame, windows) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = windows.value
        item_of, items, lengths = asked.item_of, asked.items, asked.lengths
        for batch in batches:
            for row in range(batch.num_rows):
                columns = {k: batch.column(k)[row] for k in batch.schema.names}
                segment = Segment(columns)
                n = len(segment.word_counts)
                some = asked.of_segment(segment.terms)
                window, at = segment.phrases(asked.terms[some], lengths[some])
                window = some[window]
                doc = np.searchsorted(segment.firsts, at, "right") - 1
                begin = at - segment.firsts[doc]
                of, b, e = _merged(doc, begin, begin + lengths[window])
                pairs = np.unique(np.stack([doc, item_of[window]]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
                spans = pa.StructArray.from_arrays([pa.array(b, pa.int32()), pa.array(e, pa.int32())], ["begin", "end"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, columns["segment"].as_py()), pa.int64()),
                        pa.array(np.arange(n)),
                        columns["doc_ids"].values,
                        pa.array(segment.word_counts),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), spans),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[0], np.arange(n + 1)), pa.int32()), items.take(pa.array(pairs[1]))),
                    ],
                    ["segment", "doc", "doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(look, FOUND)


def _numbers(ids: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each id, and the ids by number; a null id is an id of its own."""
    known: dict = {}
    numbers = np.array([known.setdefault(None if x != x else x, len(known)) for x in ids], np.int64)
    return numbers, pa.array(list(known), pa.int64())


def proximity(index: DataFrame, queries: DataFrame, slop: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Occurrences of the rarest word of a query (in the segment; of equally rare ones the first by hash) that have all its
    other words within `slop` words in the same document: query_id, doc_id, position. Repeated words of a query count once;
    queries without words find nothing."""
    spark = index.sparkSession
    out = None
    for ids, terms, lengths in _blocks(windows_of(queries, id_col, text_col, 1 << 30)):
        shared = spark.sparkContext.broadcast((ids, terms, lengths))

        def look(batches, shared=shared):
            ids, terms, lengths = shared.value
            for batch in batches:
                for row in range(batch.num_rows):
                    columns = {k: batch.column(k)[row] for k in batch.schema.names}
                    segment = Segment(columns)
                    for q in range(len(ids)):
                        words = np.unique(terms[q, : lengths[q]])
                        at = segment.near(words, len(words), slop)
                        doc = np.searchsorted(segment.firsts, at, "right") - 1
                        if len(at):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([None if ids[q] != ids[q] else ids[q]] * len(at), pa.int64()), columns["doc_ids"].values.take(pa.array(doc)), pa.array(at - segment.firsts[doc], pa.int32())],
                                ["query_id", "doc_id", "position"],
                            )

        part = index.mapInArrow(look, "query_id bigint, doc_id bigint, position int")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id bigint, doc_id bigint, position int")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of contamination()."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)
