"""Removal of passages that also stand in a document with a smaller id, by external induced sorting of suffixes.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Whole-text suffix
arrays would need several times the text on disk, so only suffixes that can matter are sorted:

1. Sampled suffixes. Of the grams in each window of `length` bytes, the one with the least hash (the leftmost of equal
   ones) is the window's anchor. It depends on the window's bytes alone, so equal windows have equal anchors, and every
   window has one. (Suffixes at local minima of letters, the usual choice, may be missing in a window.)
2. Grams in one document only go: blocks of texts send their different grams, packed, to buckets of grams, which answer
   each block with those that another document has too.
3. Base order. Suffixes at the other anchors, once for each different context in a block, are dealt by gram and put in
   order by Spark's sort, which spills to disk. Each tuple carries the suffix, the bytes to its left, and the least and
   largest document of its context. A scan takes the common prefix with the suffix before.
4. Induction. The suffixes one byte to the left are ordered by (that byte, rank), their common prefixes by the least one in
   between, plus one; from them those two bytes to the left, and so on, until every window's start is reached. A run with
   a common prefix of `length` or more is one window, and its least document decides. A task holds the tuples of a gram, or
   of some that are `most_held` together. The blocks of a gram that has more (the buckets add up how many) send its windows
   instead, by 128-bit digests, which are dealt and put in order with the rest: the first of a run has the least document, so
   nothing is held.
5. The answers go back to the blocks, which cut their texts.

Texts are shuffled once, in packed blocks, for the two passes that meet answers. A block is some hundred rows of 4 MB
together, or one longer text; passes take 2 MB of texts at a time, and long texts in pieces, so memory follows the longest
single text, which is held a few times. Tuples travel packed too, a blob for each block and shard of grams.

Contexts are told apart within a block by 64-bit hashes (see word_hashes), windows of very frequent grams by 128 bits.

Nulls: a null text is empty; a row without id comes after all ids, and such rows don't take from each other. Rows that share an
id are one document here: they take nothing from each other, and every row is reported. An empty table gives an
empty result; other columns are ignored. docs should be a table that was read, as blocks are made of consecutive rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import mix64, runs, slices, text_bytes, word_hashes

LAST = np.iinfo(np.int64).max
#: Bytes of text behind a bucket of grams or a shard of tuples.
SHARD_BYTES = 32 << 20
#: Bytes and rows of a block.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 2000
PIECE = 2 << 20
#: Bits of a gram's hash that aren't sent.
GRAM = np.uint64(13)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def gram_size(length: int) -> int:
    return min(16, max(8, length // 3))


def anchors(raw: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another in raw, from firsts[k] to firsts[k + 1]: places of anchors, the hashes of their grams,
    and the first and last start of the windows whose anchor each is. A place may come twice, for other windows."""
    size = gram_size(length)
    width, n = length - size + 1, len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none
    eights = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    grams = n - size + 1
    hashes = mix64(mix64(eights[:grams] + _GOLDEN) + eights[size - 8 : size - 8 + grams])
    # The upper half of the hash, then the place: the least is the leftmost of the least hashes.
    least, span = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64), 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        least = np.minimum(least[: grams - width + 1], least[width - span : width - span + grams - width + 1])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.ones(len(place), bool)
    for edge in firsts[1:-1]:  # windows over the edge of two texts
        whole[max(0, edge - length + 1) : edge] = False
    starts = np.flatnonzero(whole)
    place = place[starts]
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(place) else none
    last = np.append(head[1:], len(place))[: len(head)] - 1
    return place[head], mix64(hashes[place[head]]), starts[head], starts[last]  # mixed anew, as least hashes are small


def _pieces(texts: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """First and last text, bytes, where texts begin in them, and how far into the (single) text the bytes begin."""
    for a, b in slices(texts, PIECE):
        raw, firsts = text_bytes(texts[a:b])
        if b - a == 1 and len(raw) > 2 * PIECE:
            for at in range(0, len(raw) - length + 1, PIECE):
                part = raw[at : at + PIECE + length - 1]
                yield a, b, part, np.array([0, len(part)]), at
        else:
            yield a, b, raw, firsts, 0


def _packed(numbers: np.ndarray) -> bytes:
    """56 bits of each."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpacked(data: list[bytes]) -> np.ndarray:
    seven = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 7)
    out = np.zeros((len(seven), 8), np.uint8)
    out[:, :7] = seven
    return out.view("<u8").ravel().astype(np.uint64)


def _zipped(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unzipped(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _blocks(docs: DataFrame) -> DataFrame:
    """block (a number) and rows: packed doc_id and text of some rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), BLOCK_BYTES, BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([_zipped(batch.slice(a, b - a))], pa.binary())], ["rows"])

    return docs.mapInArrow(pack, "rows binary").select(F.monotonically_increasing_id().alias("block"), "rows")


def _texts(data: bytes) -> tuple[pa.Array, np.ndarray]:
    rows = _unzipped(data)
    return rows.column("text").combine_chunks(), _ids(rows.column("doc_id"))


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)


def _shards(gram: np.ndarray, shards: int) -> np.ndarray:
    """From 0 to shards - 1, ascending with the gram (51 bits)."""
    return ((gram >> np.uint64(19)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _asked(blocks: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, block, and the different grams of the block in that bucket: 51 bits of the hash, the logarithm of its number there,
    and whether two documents of the block have it."""

    def ask(block: int, texts: pa.Array, ids: np.ndarray) -> pa.RecordBatch | None:
        found, owner = [], []
        for a, _, raw, firsts, _ in _pieces(texts, length):
            place, hashes, _, _ = anchors(raw, firsts, length)
            found.append(hashes >> GRAM)
            owner.append(ids[a + np.searchsorted(firsts, place, "right") - 1])
        if not sum(map(len, found)):
            return None
        gram, ids = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(gram, kind="stable")
        gram, ids = gram[order], ids[order]
        head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        several = np.minimum.reduceat(ids, head) < np.maximum.reduceat(ids, head)
        number = np.minimum(np.frexp(np.diff(np.append(head, len(gram))).astype(float))[1] - 1, 15)
        gram = gram[head]
        bucket = _shards(gram, buckets)
        flagged = gram << np.uint64(5) | number.astype(np.uint64) << np.uint64(1) | several.astype(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        grams = [_packed(flagged[lo:hi]) for lo, hi in zip(cuts, np.append(cuts[1:], len(gram)))]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([block] * len(cuts), pa.int64()), pa.array(grams, pa.binary())], ["bucket", "block", "grams"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = ask(block, *_texts(data.as_py()))
                if out is not None:
                    yield out

    return blocks.mapInArrow(each, "bucket int, block bigint, grams binary")


def _answered(asked: DataFrame, most_held: int) -> DataFrame:
    """block and the grams of its that more than one document has, each with whether there are more than a task may hold."""

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        data = rows.column("grams").to_pylist()
        flagged = _unpacked(data)
        sender = np.repeat(np.arange(len(data)), [len(x) // 7 for x in data])
        gram = flagged >> np.uint64(5)
        order = np.argsort(gram, kind="stable")
        ordered = gram[order]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
        starts, one = np.flatnonzero(head), np.cumsum(head) - 1
        number = np.add.reduceat(2 ** (flagged[order] >> np.uint64(1) & np.uint64(15)).astype(np.int64), starts)
        often = (np.diff(np.append(starts, len(ordered))) > 1) | np.logical_or.reduceat((flagged[order] & np.uint64(1)).astype(bool), starts)
        keep, hot = np.zeros(len(gram), bool), np.zeros(len(gram), np.uint64)
        keep[order], hot[order] = often[one], (number > most_held)[one]
        out, sender = (gram << np.uint64(1) | hot)[keep], sender[keep]
        who = np.unique(sender)
        cuts = np.searchsorted(sender, who)
        packed = [_packed(out[lo:hi]) for lo, hi in zip(cuts, np.append(cuts[1:], len(out)))]
        return pa.table({"block": rows.column("block").take(pa.array(who)), "grams": pa.array(packed, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(answer, "block bigint, grams binary")


def _contexts(raw: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Names of contexts: the bytes of an anchor's windows, and where in them the anchor is."""
    name = word_hashes(raw, first, last + length)
    return mix64(name + (place - first).astype(np.uint64) * _GOLDEN).view(np.int64)


def _cut_out(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, back: bool = False) -> pa.Array:
    """The byte ranges as binaries, or, with back, their bytes from the last to the first."""
    sizes = ends - starts
    at = runs(starts, sizes)
    if back:
        at = np.repeat(starts + ends - 1, sizes) - at
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[at].tobytes())])


_TUPLE = pa.schema([("suffix", pa.binary()), ("left", pa.binary()), ("step", pa.int32()), ("least", pa.int64()), ("most", pa.int64()), ("block", pa.int64()), ("name", pa.int64())])
_TUPLE_SQL = "suffix binary, left binary, step int, least bigint, most bigint, block bigint, name bigint"


def _packets(shard: np.ndarray, rows: pa.Table, block: int) -> pa.Table:
    """A packed row for each shard."""
    rows = rows.append_column("shard", pa.array(shard, pa.int32())).sort_by([("shard", "ascending"), ("suffix", "ascending")]).combine_chunks()
    shard = rows.column("shard").to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else shard
    rows = rows.drop_columns(["shard", "block"])
    parts = [rows.slice(lo, hi - lo).combine_chunks() for lo, hi in zip(cuts, np.append(cuts[1:], len(shard)))]
    packed = [_zipped(pa.RecordBatch.from_arrays([_alone(c) for c in part.columns], schema=part.schema)) for part in parts]
    return pa.table({"shard": pa.array(shard[cuts], pa.int32()), "block": pa.array([block] * len(cuts), pa.int64()), "tuples": pa.array(packed, pa.binary())})


def _alone(column: pa.ChunkedArray) -> pa.Array:
    """The values in an array that holds no others."""
    return pa.concat_arrays(column.chunks) if column.num_chunks > 1 else column.chunk(0).take(pa.array(np.arange(len(column))))


def _tuples(blocks: DataFrame, answers: DataFrame, length: int, shards: int) -> DataFrame:
    """Packed tuples for each block and shard of grams.

    There is a tuple for each different context of a block and each of its anchors that was answered: the suffix from the
    anchor, the bytes to its left from right to left, and the least and largest document. Of grams with too many, one for
    each window: its digest as suffix, null as the bytes to the left, and as step the number of bytes left of the anchor.
    """

    def send(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        wanted = np.sort(_unpacked(replies.column("grams").to_pylist())) if replies.num_rows and rows.num_rows else np.zeros(0, np.uint64)
        if not len(wanted):
            return _packets(np.zeros(0, np.int32), _TUPLE.empty_table(), 0)
        wanted, hot = wanted >> np.uint64(1), (wanted & np.uint64(1)).astype(bool)
        block = key[0].as_py()
        texts, ids = _texts(rows.column("rows")[0].as_py())
        out, shard = [_TUPLE.empty_table()], [np.zeros(0, np.int32)]
        for a, _, raw, firsts, _ in _pieces(texts, length):
            place, hashes, first, last = anchors(raw, firsts, length)
            at = np.minimum(np.searchsorted(wanted, hashes >> GRAM), len(wanted) - 1)
            has = np.flatnonzero(wanted[at] == hashes >> GRAM)
            if not len(has):
                continue
            place, first, last, wide = place[has], first[has], last[has], hot[at[has]]
            owner = ids[a + np.searchsorted(firsts, place, "right") - 1]
            name = _contexts(raw, place, first, last, length)
            order = np.argsort(name, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
            least, most = np.minimum.reduceat(owner[order], head), np.maximum.reduceat(owner[order], head)
            one = order[head]
            held = np.flatnonzero(~wide[one])
            some = one[held]
            suffix, left = _cut_out(raw, place[some], last[some] + length), _cut_out(raw, first[some], place[some], back=True)
            facts = [least[held], most[held], np.full(len(some), block), name[some]]
            shard.append(_shards(hashes[has][some] >> GRAM, shards))
            out.append(pa.Table.from_arrays([suffix, left, pa.nulls(len(some), pa.int32()), *map(pa.array, facts)], schema=_TUPLE))
            held = np.flatnonzero(wide[one])
            if len(held):
                number = (last - first)[one[held]] + 1
                start, row = runs(first[one[held]], number), np.repeat(held, number)
                digests = [hashlib.md5(raw[s : s + length].tobytes()).digest() for s in start]
                facts = [(place[one[row]] - start).astype(np.int32), least[row], most[row], np.full(len(row), block), name[one[row]]]
                shard.append(_shards(np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64) >> GRAM, shards))
                out.append(pa.Table.from_arrays([pa.array(digests, pa.binary()), pa.nulls(len(row), pa.binary()), *map(pa.array, facts)], schema=_TUPLE))
        return _packets(np.concatenate(shard), pa.concat_tables(out), block)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, "shard int, block bigint, tuples binary")


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, each row padded to the width, and sizes."""
    raw, offsets = text_bytes(column, pa.large_binary())
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.uint8)
    out.ravel()[runs(np.arange(len(sizes)) * width, sizes)] = raw
    return out, sizes


def induced(suffixes: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray], least: np.ndarray, length: int) -> np.ndarray:
    """Rows x bytes to the left: the least document of the window that begins so far left of a suffix; LAST where none does.

    suffixes (padded bytes and sizes) are in order. An induction step takes the suffixes one byte further left: those that have
    that byte come out of a stable sort by it in the order of (byte, rank), and the common prefix of two neighbours is one
    more than the least between their former ranks, or zero where the bytes differ.
    """
    text, sizes = suffixes
    before, reach = left
    n = len(sizes)
    out = np.full((n, before.shape[1] + 1), LAST)
    common = np.zeros(n, np.int64)
    if n > 1:
        unequal = np.hstack([text[1:] != text[:-1], np.ones((n - 1, 1), bool)])
        common[1:] = np.minimum(unequal.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    order = np.arange(n)
    for step in range(before.shape[1] + 1):
        if step:
            levels = [common]
            while 2 << (len(levels) - 1) <= len(common):
                half = 1 << (len(levels) - 1)
                levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
            rank = np.flatnonzero(reach[order] >= step)
            byte = before[order[rank], step - 1]
            rank = rank[np.argsort(byte, kind="stable")]
            order = order[rank]
            if not len(order):
                break
            byte = before[order, step - 1]
            same = np.flatnonzero(byte[1:] == byte[:-1]) + 1
            lo, hi = rank[same - 1] + 1, rank[same] + 1
            level = np.frexp((hi - lo).astype(float))[1] - 1
            common = np.zeros(len(order), np.int64)
            for k in np.unique(level):
                of = np.flatnonzero(level == k)
                common[same[of]] = 1 + np.minimum(levels[k][lo[of]], levels[k][hi[of] - (1 << k)])
        whole = sizes[order] + step >= length
        head = np.flatnonzero(common < length)
        lowest = np.minimum.reduceat(least[order], head)[np.cumsum(common < length) - 1]
        out[order[whole], step] = lowest[whole]
    return out


_FACT = pa.schema([("block", pa.int64()), ("name", pa.int64()), ("near", pa.int32()), ("far", pa.int32()), ("least", pa.int64())])
_FACT_SQL = "block bigint, name bigint, near int, far int, least bigint"


def _facts(rows: pa.Table, length: int) -> pa.Table:
    """Of complete grams in order: the context, from how many bytes to how many left of the anchor windows begin, and the least
    document that has them, if it is less than the context's largest."""
    size = gram_size(length)
    table = induced(_matrix(rows.column("suffix"), length), _matrix(rows.column("left"), length - size), rows.column("least").to_numpy(), length)
    taken = table < rows.column("most").to_numpy()[:, None]
    flat, value = taken.ravel(), table.ravel()
    width = table.shape[1]
    at = np.flatnonzero(flat)
    if not len(at):
        return _FACT.empty_table()
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (at[1:] % width == 0) | (value[at[1:]] != value[at[:-1]])]))
    last = np.append(head[1:], len(at)) - 1
    row = pa.array(at[head] // width)
    near, far = at[head] % width, at[last] % width
    return pa.Table.from_arrays([rows.column("block").take(row), rows.column("name").take(row), pa.array(near, pa.int32()), pa.array(far, pa.int32()), pa.array(value[at[head]])], schema=_FACT)


def _run_facts(rows: pa.Table, before: dict) -> pa.Table:
    """Of windows by digest, in the order of digest and least document; before: the run that the last table ended in."""
    digest = np.array([x.as_py() for x in rows.column("suffix")], "V16")
    least, most = rows.column("least").to_numpy(), rows.column("most").to_numpy()
    head = np.concatenate([[True], digest[1:] != digest[:-1]])
    lowest = least[np.flatnonzero(head)]
    if before.get("digest") == digest[0].tobytes():
        lowest[0] = before["lowest"]
    before.update(digest=digest[-1].tobytes(), lowest=lowest[-1])
    lowest = lowest[np.cumsum(head) - 1]
    use = pa.array(np.flatnonzero(lowest < most))
    columns = [rows.column(c).take(use) for c in ("block", "name", "step", "step")]
    return pa.Table.from_arrays([*columns, pa.array(lowest).take(use)], schema=_FACT)


def _decided(tuples: DataFrame, length: int, most_held: int) -> DataFrame:
    """The facts of all contexts."""
    size = gram_size(length)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _unzipped(data.as_py())
                yield from rows.add_column(5, "block", pa.array([block] * rows.num_rows, pa.int64())).to_batches(max_chunksize=20_000)

    ordered = tuples.repartition("shard").select("block", "tuples").mapInArrow(unpack, _TUPLE_SQL).sortWithinPartitions("suffix", "least")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count, before = 0, {}
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            wide = batch.column("left").is_null()
            windows = batch.filter(wide)
            if windows.num_rows:
                yield from _run_facts(windows, before).to_batches()
            rows = batch.filter(pa.compute.invert(wide))
            held.append(rows)
            count += rows.num_rows
            if count >= most_held:
                table = pa.concat_tables(held).combine_chunks()
                cut = count - _of_last_gram(table, size)  # the last gram may go on
                if cut:
                    yield from _facts(table.slice(0, cut), length).to_batches(max_chunksize=5000)
                held, count = [table.slice(cut)], count - cut
        if count:
            yield from _facts(pa.concat_tables(held).combine_chunks(), length).to_batches(max_chunksize=5000)

    return ordered.mapInArrow(scan, _FACT_SQL)


def _of_last_gram(table: pa.Table, size: int) -> int:
    """How many rows at the end have the last row's gram."""
    suffix = table.column("suffix")
    gram, lo, hi = suffix[-1].as_py()[:size], 0, table.num_rows
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if suffix[table.num_rows - 1 - mid].as_py()[:size] == gram else (lo, mid)
    return lo


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", most_held: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, spans (begin and end of the bytes that go, ascending, apart from each other) and kept (the other
    bytes). most_held: tuples that a task takes at a time (twice as many of one gram at most); a gram with more is taken by windows."""
    if length < 16:
        raise ValueError("length must be 16 bytes or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = total // SHARD_BYTES + 64
    # Two passes group by block, so that Spark makes one exchange of the texts and reads it again.
    blocks = _blocks(rows)
    facts = _decided(_tuples(blocks, _answered(_asked(blocks, length, shards), most_held), length, shards), length, most_held)

    def cut(key: tuple, rows: pa.Table, facts: pa.Table) -> pa.Table:
        texts, ids = _texts(rows.column("rows")[0].as_py())
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        if facts.num_rows:
            facts = facts.sort_by("name")
            name, near, far, least = (facts.column(c).to_numpy() for c in ("name", "near", "far", "least"))
            for a, _, raw, firsts, begun in _pieces(texts, length):
                place, _, first, last = anchors(raw, firsts, length)
                mine = _contexts(raw, place, first, last, length)
                lo = np.searchsorted(name, mine)
                number = np.searchsorted(name, mine, "right") - lo
                fact, at = runs(lo, number), np.repeat(np.arange(len(mine)), number)
                text = np.searchsorted(firsts, place[at], "right") - 1
                use = least[fact] < ids[a + text]
                fact, at, text = fact[use], at[use], text[use]
                begin, end = place[at] - far[fact], place[at] - near[fact] + length
                order = np.argsort(begin, kind="stable")
                begin, end, text = begin[order], np.maximum.accumulate(end[order]) if len(order) else end, text[order]
                head = np.flatnonzero(np.concatenate([[True], (begin[1:] > end[:-1]) | (text[1:] != text[:-1])])) if len(begin) else order
                for k, b, e in zip(text[head], begin[head], end[np.append(head[1:], len(end))[: len(head)] - 1]):
                    k, b, e = int(k), int(b - firsts[k]) + begun, int(e - firsts[k]) + begun
                    if spans[a + k] and spans[a + k][-1][1] >= b:
                        spans[a + k][-1] = (spans[a + k][-1][0], max(e, spans[a + k][-1][1]))
                    else:
                        spans[a + k].append((b, e))
        kept, sizes = [], []
        for k, gone in enumerate(spans):
            data, at, parts = texts[k].as_buffer() if texts[k].is_valid else pa.py_buffer(b""), 0, []
            for b, e in gone:
                parts.append(data[at:b])
                at = e
            kept.append(b"".join([*parts, data[at:]]))
            sizes.append(data.size)
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        listed = pa.array([[{"begin": b, "end": e} for b, e in gone] for gone in spans], span)
        return pa.table({"doc_id": pa.array(ids, mask=ids == LAST), "n_bytes": pa.array(sizes, pa.int64()), "spans": listed, "kept": pa.array(kept, pa.binary())})

    return blocks.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(cut, "doc_id bigint, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary")


def report(cut: DataFrame) -> DataFrame:
    """Numbers of bytes and spans, and a digest of the bytes that stay."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
