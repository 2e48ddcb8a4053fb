"""How the sources of a language differ in their terms: sort-based streaming counts, then divergences of sources and terms.

1. Each slice of documents sorts its occurrences by (lang, term, source, document) and takes runs: a row for each term and
   source, with documents and occurrences, so that what is shuffled grows with a slice's different terms.
2. Rows are repartitioned by (lang, term), ordered by (lang, term, source, first document), and a scan adds up runs. Terms that
   are in many documents of a slice are dealt over several tasks for it and meet again, a row for each source and task, in
   a second scan, which knows a term's documents and keeps or drops it. A scan holds one term's sums, a row for each source.
3. With the totals of each source known, a third scan over the kept terms emits, for each run of a term, partial values of
   pairs of the sources that have it, added up in the task for some thousand terms at a time. What a pair gets from terms
   that one or none of the two has follows from how often each number of occurrences stands in a source.

A group gives a term with count occurrences p = 1 + floor(10^9 (count + 1) / (N + V)), N its occurrences of kept terms, V the
language's kept terms; f(p, q) = floor((p - q)^2 / q). All sums are exact integers.

Each row of docs is a document of its own, whatever its id. Nulls: a null text, lang or source is ''. Groups without
terms get values too; a language without kept terms has pairs of value 0. An empty table gives an empty result; other columns
are ignored. Pairs are all sources of a language with one another, as the result has a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import LOWER, runs, slices, text_bytes, word_edges, word_strings, written

SLICE = 24 << 20
#: A term that so many documents of a slice have is dealt over SALTS tasks.
OFTEN, SALTS = 64, 16
#: Pairs of sources of a term that are looked at together.
PAIRS = 1 << 20
#: Bytes of terms once A-Z are lower-cased: a-z and every byte of a character outside ASCII.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True

_ROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes in the order of the values' bytes, and the values."""
    if not isinstance(values, pa.Array):
        values = values.combine_chunks()
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary.cast(pa.binary() if coded.dictionary.type == pa.string() else pa.large_binary())).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()] if len(order) else np.zeros(0, np.int64), coded.dictionary.take(pa.array(order)).cast(pa.string())


def _of_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each slice's occurrences in the order of lang, term, source and document."""
    context = TaskContext.get()
    seen = (context.partitionId() if context else 0) << 40
    for batch in batches:
        for a, b in slices(batch.column(0), SLICE, 10_000):
            raw, offsets = text_bytes(batch.column(0)[a:b])
            raw = LOWER[raw]
            inside = LETTER[raw]
            starts, ends, owner = word_edges(inside, offsets)
            lang, langs = _codes(batch.column(1)[a:b])
            source, sources = _codes(batch.column(2)[a:b])
            term, terms = _codes(word_strings(raw, inside, starts, ends))
            n = b - a
            seen += n
            if not len(term):
                continue
            if len(langs) * len(terms) * len(sources) * n >= 1 << 62:
                raise ValueError("too many different values in a slice")
            key = np.sort(((lang[owner] * len(terms) + term) * len(sources) + source[owner]) * n + owner)
            document = _heads(key)  # a run for each document that has the term
            key, times = key[document], np.diff(np.append(document, len(key)))
            run = key // n
            head = _heads(run)
            first, run = key[head] % n, run[head]
            docs, counts = np.diff(np.append(head, len(key))), np.add.reduceat(times, head)
            at = [run // len(sources) // len(terms), run // len(sources) % len(terms), run % len(sources)]
            columns = [values.take(pa.array(k)) for values, k in zip((langs, terms, sources), at)]
            yield from pa.Table.from_arrays([*columns, pa.array(first + seen - n), pa.array(docs), pa.array(counts)], schema=_ROW).to_batches(max_chunksize=50_000)


def _changes(rows: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before in a column; the first one does."""
    out = np.zeros(rows.num_rows, bool)
    out[0] = True
    for name in names:
        column = rows.column(name).combine_chunks()
        out[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def _whole(batches: Iterator[pa.RecordBatch], names: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of at least so many rows, but the last, that end where one of the named columns changes."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= least:
            rows = pa.concat_tables(held).combine_chunks()
            cut = int(np.flatnonzero(_changes(rows, names))[-1])
            if cut:
                yield rows.slice(0, cut)
            held, least = [rows.slice(cut)], max(20_000, 2 * (rows.num_rows - cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows of one lang, term and source as one row. Only the sums of the run that goes on are held."""
    last: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([last, rows]) if last is not None else rows
        head = np.flatnonzero(_changes(rows, ["lang", "term", "source"]))
        sums = [pa.array(np.add.reduceat(rows.column(c).to_numpy(), head)) for c in ("docs", "n")]
        first = rows.take(pa.array(head))
        added = pa.Table.from_arrays([*(first.column(c).combine_chunks() for c in ("lang", "term", "source", "document")), *sums], schema=_ROW)
        yield from added.slice(0, added.num_rows - 1).to_batches()
        last = added.slice(added.num_rows - 1)
    if last is not None:
        yield from last.to_batches()


def counted(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, source, n of the terms that at least so many of a lang's documents have, n_lang (its occurrences in the lang) and
    first (1 for one row of each lang and term)."""
    row = "lang string, term string, source string, document bigint, docs bigint, n bigint"
    spread = F.when(F.col("docs") >= OFTEN, F.pmod(F.col("document"), F.lit(SALTS))).otherwise(F.lit(0))
    parts = docs.select("text", "lang", "source").mapInArrow(_of_slices, row)
    dealt = parts.repartition("lang", "term", spread).sortWithinPartitions("lang", "term", "source", "document")
    dealt = dealt.mapInArrow(_added, row).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    out = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("n_lang", pa.int64()), ("first", pa.int64())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(_added(batches), ["lang", "term"]):
            new = _changes(rows, ["lang", "term"])
            head, run = np.flatnonzero(new), np.cumsum(new) - 1
            docs, n = rows.column("docs").to_numpy(), rows.column("n").to_numpy()
            use = pa.array(np.flatnonzero(np.add.reduceat(docs, head)[run] >= least_docs))
            columns = [rows.column(c).combine_chunks() for c in ("lang", "term", "source", "n")]
            all_of = [pa.array(np.add.reduceat(n, head)[run]), pa.array(new.astype(np.int64))]
            yield from pa.Table.from_arrays([*columns, *all_of], schema=out).take(use).to_batches(max_chunksize=50_000)

    return dealt.mapInArrow(keep, "lang string, term string, source string, n bigint, n_lang bigint, first bigint")


def billionths(n: str, total: str, terms: str) -> Column:
    """p of a count; decimal, as a thousand million times a count may pass 64 bits."""
    return F.expr(f"1 + (CAST({n} + 1 AS DECIMAL(20, 0)) * 1000000000) DIV CAST({total} + {terms} AS DECIMAL(20, 0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV {q}")


def _of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of a lang and term: what each two of its sources have more than if at most one of them had the term."""
    f = lambda p, q: (p - q) * (p - q) // q
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    for rows in _whole(batches, ["lang", "term"], 5000):
        new = _changes(rows, ["lang", "term"])
        head, run = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(np.append(head, len(new)))[run]
        lang, langs = _codes(rows.column("lang"))
        source, sources = _codes(rows.column("source"))
        p, z = rows.column("p").to_numpy(), rows.column("z").to_numpy()
        done = np.cumsum(size) // PAIRS
        for lo, hi in zip(_heads(done), np.append(_heads(done)[1:], len(done))):
            one = np.repeat(np.arange(lo, hi), size[lo:hi])
            other = runs(head[run[lo:hi]], size[lo:hi])
            one, other = one[one != other], other[one != other]
            if not len(one):
                continue
            value = f(p[one], p[other]) - f(p[one], z[other]) - f(z[one], p[other]) + f(z[one], z[other])
            key = (lang[one] * len(sources) + source[one]) * len(sources) + source[other]
            order = np.argsort(key, kind="stable")
            at = _heads(key[order])
            key, value = key[order][at], np.add.reduceat(value[order], at)
            names = [langs.take(pa.array(key // len(sources) // len(sources))), sources.take(pa.array(key // len(sources) % len(sources))), sources.take(pa.array(key % len(sources)))]
            yield from pa.Table.from_arrays([*names, pa.array(value)], schema=schema).to_batches(max_chunksize=50_000)


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: in part pair, by value, the other sources of the lang and how far they are; in part
    term the terms that the source has more often than the lang, most_terms at most."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(empty("text"), empty("lang"), empty("source"))
    kept = written(counted(rows, least_docs), "terms")
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("all_of"))
    groups = rows.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = written(groups.na.fill(0, ["total", "terms", "all_of"]).withColumn("z", F.when(F.col("terms") > 0, billionths("0", "total", "terms"))), "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", billionths("n", "total", "terms"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    both = groups.select("lang", "source", "terms", "z").join(other, "lang").filter("source <> item")
    pairs = both.select("lang", "source", "item", F.coalesce(F.col("terms") * divergence("z", "y"), F.lit(0)).alias("value"))
    often = shares.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("times")).join(other, "lang").filter("source <> item")
    one = often.select("lang", "source", "item", (F.col("times") * (divergence("p", "y") - divergence("z", "y"))).alias("value"))
    two = often.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * (divergence("y", "p") - divergence("y", "z"))).alias("value"))
    ordered = shares.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    more = ordered.mapInArrow(_of_runs, "lang string, source string, item string, value bigint")
    pairs = pairs.unionByName(one).unionByName(two).unionByName(more).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    above = shares.withColumn("q", billionths("n_lang", "all_of", "terms")).filter("p > q")
    above = above.select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)
    return pairs.unionByName(above.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
