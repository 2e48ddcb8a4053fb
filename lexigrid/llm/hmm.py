"""A hidden Markov language model, trained by Baum-Welch over the whole training part of a corpus.

Documents are encoded once into blocks: the word hashes of about three quarters of a million words, their codes in the
block, and the block's sorted types. Word counts come from one row per block and type, so a frequent word costs a
row for each block and not one for each occurrence. Hidden states emit symbols: the `n_symbols` most frequent words,
a class for every other word (by its last three bytes), and the end of a document. A word of a class has the
add-one share of its count in its class, with one unknown type for each class. So each state's emissions sum to
one over all known words and the classes' unknown types.

Expected counts (emissions, transitions, first states) are made per task, added up by Spark's own sums, and only the sums, whose size the numbers of symbols and states fix, reach the driver. Training is over
whole documents: pieces of PIECE tokens are worked on side by side, and the products of the pieces' step matrices carry
the forward and backward vectors exactly from piece to piece. Scoring runs the scaled forward recursion over whole
documents, so the likelihood is exact; it and the shares of the symbols' words are made where the block is read, and only the words
of classes are shuffled, to meet their counts.

Nulls: a null text is empty and has the end alone; a null doc_id hashes as an empty text. Without training words
each symbol is as likely as any other. Repeated documents count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import NONSPACE, find_words, id_remainder, slices, written

#: A block is one row, which Spark holds several times over on its way through a task.
BLOCK_WORDS = 750_000
PIECE = 128
#: Pieces that are worked on side by side.
LANES = 1024
N_CLASSES = 1024


class Model(NamedTuple):
    first: np.ndarray
    steps: np.ndarray
    emit: np.ndarray
    top: np.ndarray
    class_base: np.ndarray
    tokens: int
    types: int
    documents: int
    top_counts: np.ndarray = np.zeros(0, np.int64)

    def symbols(self, types: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each type, and whether it is one of a class."""
        if not len(self.top):
            return classes, np.ones(len(types), bool)
        at = np.minimum(np.searchsorted(self.top, types), len(self.top) - 1)
        rare = self.top[at] != types
        return np.where(rare, len(self.top) + classes, at), rare


BLOCK = "block bigint, doc_ids array<bigint>, held array<boolean>, counts array<int>, types array<bigint>, train_tf array<int>, classes array<int>, codes binary"


def _classes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    value = np.zeros(len(starts), np.int64)
    for back in (1, 2, 3):
        at = ends - back
        value = value * 257 + np.where(at >= starts, raw[np.maximum(at, 0)].astype(np.int64) + 1, 0)
    return (value * 2654435761 >> 7) % N_CLASSES


def encode_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and text as written blocks. A row group holds one block: Spark's writer and reader have a whole row group
    in memory, and by its bytes alone Parquet would end one after a hundred rows at the earliest."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for a, b in slices(batch.column(2)):
                words = find_words(batch.column(2)[a:b], NONSPACE)
                kept.append((batch.column(0)[a:b], batch.column(1)[a:b], words.counts, words.hashes, _classes(words.raw, words.starts, words.ends).astype(np.int32)))
                size += len(words.hashes)
                if size >= BLOCK_WORDS:
                    yield _block(kept)
                    kept, size = [], 0
        if kept:
            yield _block(kept)

    return written(docs.select("doc_id", "held_out", "text").mapInArrow(encode, BLOCK), "hmm-blocks", **{"parquet.enable.dictionary": "false", "parquet.block.row.count.limit": "1"})


def _block(kept: list) -> pa.RecordBatch:
    ids, held = pa.concat_arrays([k[0] for k in kept]), pa.concat_arrays([k[1] for k in kept])
    counts, hashes, classes = (np.concatenate([k[i] for k in kept]) for i in (2, 3, 4))
    types, one, codes = np.unique(hashes, return_index=True, return_inverse=True)
    learns = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), counts)
    tf = np.bincount(codes[learns], minlength=len(types)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array([secrets.randbits(62)]), *map(_whole, (ids, held, counts.astype(np.int32), types.view(np.int64), tf, classes[one])), pa.array([codes.astype("<i4").tobytes()], pa.binary())],
        ["block", "doc_ids", "held", "counts", "types", "train_tf", "classes", "codes"],
    )


def _whole(x: np.ndarray | pa.Array) -> pa.ListArray:
    """All of x as the list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))


def _values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def vocabulary(blocks: DataFrame) -> DataFrame:
    """Training counts of all types that occur in training: type, class, c."""

    def flat(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                tf = _values(batch, "train_tf", row)
                keep = np.flatnonzero(tf)
                for part in np.array_split(keep, len(keep) // 100_000 + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(_values(batch, k, row)[part]) for k in ("types", "classes", "train_tf")], ["type", "class", "tf"])

    rows = blocks.select("types", "classes", "train_tf").mapInArrow(flat, "type bigint, class int, tf int")
    return written(rows.groupBy("type").agg(F.max("class").alias("class"), F.sum("tf").alias("c")), "hmm-words")


def _sequences(model: Model, batch: pa.RecordBatch, row: int, only: np.ndarray | None = None):
    """Symbols of a block's documents, one after another with their ends, and the documents' lengths."""
    types, classes = _values(batch, "types", row).view(np.uint64), _values(batch, "classes", row)
    counts = _values(batch, "counts", row).astype(np.int64)
    codes = np.frombuffer(batch.column("codes")[row].as_buffer(), "<i4")
    symbol = model.symbols(types, classes)[0][codes]
    end = len(model.emit) - 1
    symbols = np.insert(symbol, np.cumsum(counts), end)
    lengths = counts + 1
    if only is not None:
        symbols = symbols[np.repeat(only, lengths)]
        lengths = lengths[only]
    return symbols, lengths


def _products(model: Model, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """pieces x states x states: the product of the steps' matrices over each piece, up to a factor. The first step of an
    opening piece has no transition."""
    states = len(model.first)
    out = np.empty((len(starts), states, states))
    order = np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), LANES):
        at = order[lo : lo + LANES]
        s, below = starts[at], -sizes[at]
        a = np.where(opening[at][:, None, None], np.eye(states), model.steps) * model.emit[symbols[s]][:, None, :]
        for t in range(1, int(-below[0])):
            m = int(np.searchsorted(below, -t, "left"))
            a[:m] = (a[:m].reshape(-1, states) @ model.steps).reshape(m, states, states) * model.emit[symbols[s[:m] + t]][:, None, :]
            if t % 16 == 0:
                a[:m] /= a[:m].max(axis=(1, 2), keepdims=True)
        out[at] = a / a.max(axis=(1, 2), keepdims=True)
    return out


def _carried(model: Model, products: np.ndarray, heads: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece: the forward vector at the end of the piece before it, and the backward vector at its own end, both
    up to a factor. heads: the first piece of each document, parts: its number of pieces."""
    entry, leave = np.ones(products.shape[:2]), np.ones(products.shape[:2])
    order = np.argsort(-parts, kind="stable")
    heads, parts = heads[order], parts[order]
    ahead, back = np.tile(model.first, (len(heads), 1)), np.ones((len(heads), len(model.first)))
    for j in range(int(parts[0]) - 1 if len(parts) else 0):
        m = int(np.searchsorted(-parts, -(j + 1), "left"))  # documents with a piece after the j-th
        ahead = np.einsum("ds,dst->dt", ahead[:m], products[heads[:m] + j])
        ahead /= ahead.sum(axis=1, keepdims=True)
        entry[heads[:m] + j + 1] = ahead
        back = np.einsum("dst,dt->ds", products[heads[:m] + parts[:m] - 1 - j], back[:m])
        back /= back.sum(axis=1, keepdims=True)
        leave[heads[:m] + parts[:m] - 2 - j] = back
    return entry, leave


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One E-step over whole documents: emissions, transitions, first states, and (log likelihood, tokens)."""
    states = len(model.first)
    emissions, transitions, first, total = np.zeros_like(model.emit), np.zeros((states, states)), np.zeros(states), np.zeros(2)
    parts = -(-lengths // PIECE)
    heads = np.cumsum(parts) - parts
    k = np.arange(int(parts.sum())) - np.repeat(heads, parts)
    starts = np.repeat(np.cumsum(lengths) - lengths, parts) + k * PIECE
    sizes = np.minimum(np.repeat(lengths, parts) - k * PIECE, PIECE)
    opening = k == 0
    entry, leave = np.ones((len(k), states)), np.ones((len(k), states))
    cut = np.flatnonzero(np.repeat(parts > 1, parts))
    if len(cut):
        many = parts[parts > 1]
        products = _products(model, symbols, starts[cut], sizes[cut], opening[cut])
        entry[cut], leave[cut] = _carried(model, products, np.cumsum(many) - many, many)
    order = np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), LANES):
        at = order[lo : lo + LANES]
        s, n, o, came, goes = starts[at], sizes[at], opening[at], entry[at], leave[at]
        depth = int(n[0])
        active = [int(np.searchsorted(-n, -t, "left")) for t in range(depth + 1)]
        seen, emitted, alpha, scale = [], [], [], []
        for t in range(depth):
            m = active[t]
            seen.append(symbols[s[:m] + t])
            emitted.append(model.emit[seen[-1]])
            a = (np.where(o[:, None], model.first, came @ model.steps) if t == 0 else alpha[-1][:m] @ model.steps) * emitted[-1]
            c = a.sum(axis=1, keepdims=True)
            alpha.append(a / c)
            scale.append(c)
        gamma = [None] * depth
        beta = None
        for t in range(depth - 1, -1, -1):
            m, on = active[t], active[t + 1]
            new = np.empty((m, states))
            new[on:] = goes[on:m] / (alpha[t][on:] * goes[on:m]).sum(axis=1, keepdims=True)
            if on:
                w = emitted[t + 1] * beta / scale[t + 1]
                transitions += alpha[t][:on].T @ w
                new[:on] = w @ model.steps.T
            beta = new
            gamma[t] = alpha[t] * beta
        transitions += came[~o].T @ (emitted[0] * beta / scale[0])[~o]
        first += gamma[0][o].sum(axis=0)
        flat, weights = np.concatenate(seen), np.concatenate(gamma)
        for i in range(states):
            emissions[:, i] += np.bincount(flat, weights=weights[:, i], minlength=len(emissions))
        total += [sum(float(np.log(c).sum()) for c in scale), len(flat)]
    return emissions, transitions * model.steps, first, total


def _task_sums(blocks: DataFrame, model: Model) -> DataFrame:
    """The expected counts of each task's blocks: row (a symbol's emissions, then a state's transitions, the first states, the
    log likelihood, and the tokens) and a column for each state; rows of zeros are left out. blocks: a written table, so
    a task that runs again, after a lost executor, gives the same rows."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    states = len(model.first)
    columns = [f"s{k}" for k in range(states)]

    def count(batches):
        model = shared.value
        sums = None
        for batch in batches:
            for row in range(batch.num_rows):
                learns = ~_values(batch, "held", row).astype(bool)
                if learns.any():
                    emissions, transitions, first, total = expected_counts(model, *_sequences(model, batch, row, learns))
                    new = np.concatenate([emissions, transitions, first[None], np.repeat(total[:, None], states, axis=1)])
                    sums = new if sums is None else sums + new
        if sums is not None:
            some = np.flatnonzero(sums.any(axis=1))
            for rows in np.array_split(some, len(some) // 10_000 + 1):
                yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(sums[rows, k]) for k in range(states))], ["row", *columns])

    return blocks.select("held", "counts", "types", "classes", "codes").mapInArrow(count, "row bigint, " + ", ".join(f"{c} double" for c in columns))


def _e_step(blocks: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    symbols, states = model.emit.shape
    sums = _task_sums(blocks, model).groupBy("row").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states))).toArrow()
    flat = np.zeros((symbols + states + 3, states))
    flat[sums.column("row").to_numpy()] = np.stack([sums.column(f"s{k}").to_numpy() for k in range(states)], axis=1)
    return flat[:symbols], flat[symbols:-3], flat[-3], flat[-2:, 0]


def train(blocks: DataFrame, words: DataFrame, n_states: int = 6, n_symbols: int = 16384, rounds: int = 4, seed: int = 7) -> tuple[Model, list[float]]:
    """The model, and the mean log likelihood of a token before each round (over symbols)."""
    top = words.orderBy(F.desc("c"), "type").limit(n_symbols).select("type", "class", "c").toPandas()
    top_types, top_counts = top["type"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(top_types)
    top_types, top_counts = top_types[order], top_counts[order]
    sums = words.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    class_n, class_v = np.zeros(N_CLASSES, np.int64), np.zeros(N_CLASSES, np.int64)
    class_n[sums["class"]], class_v[sums["class"]] = sums["n"], sums["v"]
    tokens, types = int(class_n.sum()), int(class_v.sum())
    np.subtract.at(class_n, top["class"], top["c"])
    np.subtract.at(class_v, top["class"], 1)
    documents = blocks.select(F.explode("held").alias("held")).filter("not held").count()
    random = np.random.RandomState(seed)
    share = np.concatenate([top_counts, class_n, [documents]]) + 0.1
    emit = share[:, None] * np.exp(random.normal(0, 0.5, (len(share), n_states)))
    steps = np.full((n_states, n_states), 0.05 / max(1, n_states - 1))
    np.fill_diagonal(steps, 0.95 if n_states > 1 else 1.0)
    even = np.full(n_states, 1 / n_states)
    model = Model(even, steps, emit / emit.sum(axis=0), top_types, class_n + class_v + 1, tokens + documents, types + (documents > 0), documents, top_counts)
    history = []
    for _ in range(rounds):
        emissions, transitions, first, total = _e_step(blocks, model)
        if not total[1]:
            break
        history.append(float(total[0] / total[1]))
        norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
        model = model._replace(first=norm(first + 0.1, 0), steps=norm(transitions + 0.1, 1), emit=norm(emissions + 0.01, 0))
    return model, history


def forward(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each whole document's symbols by the scaled forward recursion."""
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    out = np.zeros(len(lengths))
    below = -sizes
    for t in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(below, -t, "left"))
        a = (model.first if t == 0 else a[:m] @ model.steps) * model.emit[symbols[starts[:m] + t]]
        c = a.sum(axis=1)
        a /= c[:, None]
        out[:m] += np.log(c)
    back = np.empty_like(out)
    back[order] = out
    return back


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


PART = "block bigint, doc_ids array<bigint>, held array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, score array<double>, types array<bigint>, rare array<int>, codes binary"


def part_scores(blocks: DataFrame, model: Model) -> DataFrame:
    """A row for each block: its documents' counts and scores without log10(c + 1) of their words of classes; the types of these words,
    sorted, and for each document the number of such words and their codes among these types."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def parts(batches):
        model = shared.value
        below = model.tokens + model.types + 1
        for batch in batches:
            for row in range(batch.num_rows):
                types, classes = _values(batch, "types", row).view(np.uint64), _values(batch, "classes", row)
                lengths = _values(batch, "counts", row).astype(np.int64)
                codes = np.frombuffer(batch.column("codes")[row].as_buffer(), "<i4")
                symbols, rare = model.symbols(types, classes)
                unit, within = np.full(len(types), -np.log10(below)), np.zeros(len(types))
                unit[~rare] += np.log10(model.top_counts[symbols[~rare]] + 1)
                within[rare] = -np.log10(model.class_base[classes[rare]])
                doc = np.repeat(np.arange(len(lengths)), lengths)
                add = lambda x, doc=doc, n=len(lengths), codes=codes: np.bincount(doc, weights=x[codes], minlength=n)
                met = np.flatnonzero(rare[codes])
                numbers = (np.cumsum(rare) - 1).astype("<i4")[codes[met]]
                ended = np.log10((model.documents + 1) / below)
                out = {
                    "doc_ids": batch.column("doc_ids")[row].values,
                    "held": batch.column("held")[row].values,
                    "n_tokens": lengths + 1,
                    "n_known": add(~rare).astype(np.int64) + (model.documents > 0),
                    "base": add(unit) + ended,
                    "score": forward(model, *_sequences(model, batch, row)) / np.log(10) + add(within),
                    "types": types[rare].view(np.int64),
                    "rare": np.bincount(doc[met], minlength=len(lengths)).astype(np.int32),
                }
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(row, 1), *map(_whole, out.values()), pa.array([numbers.tobytes()], pa.binary())], ["block", *out, "codes"])

    return blocks.select("block", "doc_ids", "held", "counts", "types", "classes", "codes").mapInArrow(parts, PART)


def score(blocks: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """Every document of the blocks with its counts, its unigram base and the model's log10 probability."""
    top, tokens = model.top, model.tokens

    def flat(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                types = _values(batch, "types", row)
                types = types[~np.isin(types.view(np.uint64), top)]
                for part in np.array_split(types, len(types) // 100_000 + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column("block")[row].as_py())), pa.array(part)], ["block", "type"])

    known = blocks.select("block", "types").mapInArrow(flat, "block bigint, type bigint").join(words.select("type", "c"), "type").select("block", "type", "c")

    def score_block(mine: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        for batch in mine.to_batches():
            for row in range(batch.num_rows):
                types, rare = _values(batch, "types", row).view(np.uint64), _values(batch, "rare", row)
                codes = np.frombuffer(batch.column("codes")[row].as_buffer(), "<i4")
                c = np.zeros(len(types), np.int64)
                at = np.searchsorted(types, counts.column("type").to_numpy().view(np.uint64))
                c[at] = counts.column("c").to_numpy()
                doc = np.repeat(np.arange(len(rare)), rare)
                add = lambda x, doc=doc, n=len(rare), codes=codes: np.bincount(doc, weights=x[codes], minlength=n)
                more = add(np.log10(c + 1))
                out.append(
                    pa.table(
                        {
                            "doc_id": batch.column("doc_ids")[row].values,
                            "held_out": batch.column("held")[row].values,
                            "n_tokens": _values(batch, "n_tokens", row),
                            "n_known": _values(batch, "n_known", row) + add(c > 0).astype(np.int64),
                            "train_tokens": np.full(len(rare), tokens),
                            "base_score": _values(batch, "base", row) + more,
                            "score": _values(batch, "score", row) + more,
                        }
                    )
                )
        if not out:
            return pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
        return pa.concat_tables(out)

    # About a block a task, as a task sorts what it reads of both sides before the first block.
    parts = max(1, min(blocks.count(), 100_000))
    mine = part_scores(blocks, model).repartition(parts, "block")
    return mine.groupBy("block").cogroup(known.repartition(parts, "block").groupBy("block")).applyInArrow(score_block, SCORED)


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, **options) -> DataFrame:
    """Trains on the documents outside the held-out fold and scores all."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_remainder(id_col, folds) == held_fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    blocks = encode_blocks(rows)
    words = vocabulary(blocks)
    model, _ = train(blocks, words, **options)
    return score(blocks, words, model)
