"""Toxicity by multiple-instance learning: sentences' scores, combined by noisy-or, learned from document labels.

A sentence's probability is a logistic function of the sum of its words' weights; a document is toxic unless every
sentence is clean: 1 - prod(1 - p). Words have three hashed features: the word, its first four and its first five
bytes, so that inflected forms share evidence. The weights are fitted on the driver by Adam over a bounded sample
of labelled documents (at most `most_toxic` and `most_clean` rows, by a hash of the id and with one text of each id, none
of over `longest` bytes, reweighted to the rates among all labelled documents); every whole text is scored. Features are
counted by Spark over the sample, and only those that tell the labels apart come to the driver, with their places.

Nulls: a null text has no sentences, as an empty one; no sentences give score 0. Labels that are null are left out;
a document with several labels is toxic if one says so. Without labels of both kinds every score is the rate of toxic
labels (0 without labels) for texts with sentences. Repeated documents are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrid.llm.common import Words, find_words, id_remainder, lists, scratch, slices, text_bytes, written

DIMS = 1 << 22
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?\n\r"]] = True
#: Stops outside ASCII, each of three bytes.
WIDE_STOPS = ("。", "！", "？", "｡")


def _features(words: Words) -> np.ndarray:
    """words x 3 feature numbers."""
    prefix = np.zeros(len(words.starts), np.uint64)
    out = [words.hashes]
    for k in range(5):
        at = words.starts + k
        prefix = prefix * np.uint64(257) + np.where(at < words.ends, words.raw[np.minimum(at, len(words.raw) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0)) if len(at) else prefix
        if k >= 3:
            out.append((prefix + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([(x >> np.uint64(40)).astype(np.int64) % DIMS for x in out], axis=1)


def _sentences(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words, and the first word of each sentence; a sentence ends at a full stop or mark (ASCII, ideographic or full-width)
    or line end, and with its text."""
    for mark in WIDE_STOPS:
        texts = pc.replace_substring(texts, mark, ".  ")  # three bytes, as the mark, so places stay
    words = find_words(texts)
    stops = np.flatnonzero(STOPS[words.raw])
    number = np.searchsorted(stops, words.starts)
    owner = words.texts
    head = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])])) if len(number) else number
    return words, head


class Weights(NamedTuple):
    """Weights by feature, and the bias of every sentence."""

    values: np.ndarray
    bias: float


def sentence_logits(texts: pa.Array, weights: Weights) -> tuple[Words, np.ndarray, np.ndarray]:
    words, head = _sentences(texts)
    if not len(head):
        return words, head, np.zeros(0)
    each = weights.values[_features(words)].sum(axis=1, dtype=float)
    return words, head, np.add.reduceat(each, head) + weights.bias


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int, longest: int = 1 << 20) -> DataFrame:
    """doc_id, toxic and text of the sampled labelled documents: at most most_toxic and most_clean rows, as an id that
    occurs in several rows of docs gives one of its texts (that with the least hash). The chosen ids are as few, so
    they may be broadcast. Texts of over `longest` bytes aren't learned from."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    first = lambda kind, most: known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = first(1, most_toxic).unionByName(first(0, most_clean))
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return one.select("doc_id", "toxic", "one.text")


def _occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence its text; of each feature of each word its number, its sentence and its text."""
    words, head = _sentences(texts)
    found = _features(words).ravel()
    sizes = np.diff(np.append(head, len(words.starts)))
    return words.texts[head] if len(head) else head, found, np.repeat(np.arange(len(head)), 3 * sizes), np.repeat(words.texts, 3)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, texts and toxic: the texts of a slice that have it; all texts under -2, those with sentences under -1."""
    for batch in batches:
        for a, b in slices(batch.column(1)):
            toxic = batch.column(0)[a:b].to_numpy(zero_copy_only=False).astype(np.int64)
            of, found, _, owner = _occurrences(batch.column(1)[a:b])
            pairs = np.unique(owner * DIMS + found)
            feature, at = np.unique(pairs % DIMS, return_inverse=True)
            some = np.unique(of)
            texts = np.concatenate([[b - a, len(some)], np.bincount(at, minlength=len(feature))])
            bad = np.concatenate([[toxic.sum(), toxic[some].sum()], np.bincount(at, toxic[pairs // DIMS], len(feature)).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], feature])), pa.array(texts), pa.array(bad)], ["feature", "texts", "toxic"])


def fit(
    docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_clean: int = 4000, rounds: int = 250, rate: float = 0.2, penalty: float = 5e-6, least_texts: int = 5, least_z: float = 3.5, longest: int = 1 << 20
) -> Weights:
    """labels: doc_id and toxic (0 or 1), the training rows alone."""
    rates = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").agg(F.sum(F.expr("int(toxic > 0)")), F.count("*")).first()
    toxic, total = rates[0] or 0, rates[1]
    share = toxic / total if total else 0.0
    with scratch(docs.sparkSession):
        rows = written(sample(docs, labels, most_toxic, most_clean, longest).select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")), "labelled")
        tally = written(rows.select("toxic", "text").mapInArrow(_tally, "feature bigint, texts bigint, toxic bigint").groupBy("feature").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic")), "features")
        of = {r.feature: r for r in tally.filter("feature < 0").collect()}
        if not of or of[-2].toxic in (0, of[-2].texts):
            share = min(max(share, 1e-6), 1 - 1e-6)
            return Weights(np.zeros(DIMS, np.float32), float(np.log(share / (1 - share))))
        # Kept are features of enough texts whose share of toxic texts differs from the mean by `least_z` deviations.
        mean = of[-1].toxic / max(of[-1].texts, 1)
        expected = F.col("texts") * mean
        apart = F.abs(F.col("toxic") - expected) >= least_z * F.sqrt(expected * (1 - mean))
        kept = np.array(sorted(r.feature for r in tally.filter("feature >= 0").filter((F.col("texts") >= least_texts) & apart).select("feature").collect()), np.int64)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(2)):
                    of, found, sentence, owner = _occurrences(batch.column(2)[a:b])
                    at = np.minimum(np.searchsorted(kept, found), max(len(kept) - 1, 0))
                    use = np.flatnonzero(kept[at] == found) if len(kept) else at[:0]
                    first = np.searchsorted(of, np.arange(b - a + 1))
                    cuts = np.searchsorted(owner[use], np.arange(b - a + 1))
                    parts = [lists((sentence[use] - first[owner[use]]).astype(np.int32), cuts), lists(at[use].astype(np.int32), cuts)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.diff(first)), *parts], ["doc_id", "toxic", "sentences", "sentence", "feature"])

        table = rows.mapInArrow(places, "doc_id bigint, toxic int, sentences bigint, sentence array<int>, feature array<int>").filter("sentences > 0").orderBy("doc_id", "feature", "sentence").toArrow()
    counts = table.column("sentences").to_numpy()
    first = np.repeat(np.cumsum(counts) - counts, pc.list_value_length(table.column("sentence").combine_chunks()).to_numpy())
    flat = lambda name: pc.list_flatten(table.column(name).combine_chunks()).to_numpy()
    label = table.column("toxic").to_numpy().astype(bool)
    return _adam(flat("feature"), first + flat("sentence"), counts, label, kept, share, rounds, rate, penalty)


def likelihood(weight: np.ndarray, bias: float, columns: np.ndarray, rows: np.ndarray, counts: np.ndarray, label: np.ndarray, importance: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The mean weighted log-likelihood of the labels by noisy-or, and its slopes by weight and bias. columns and rows: the feature
    and the sentence of each occurrence; counts: sentences of each text."""
    heads, text = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    logit = np.bincount(rows, weights=weight[columns], minlength=len(text)) + bias
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    log_clean = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), heads)
    clean = np.exp(log_clean)
    value = np.where(label, np.log(np.maximum(1 - clean, 1e-300)), log_clean) @ importance / len(counts)
    pull = np.where(label, clean / np.maximum(1 - clean, 1e-9), -1.0) * importance
    step = p * pull[text] / len(counts)
    return float(value), np.bincount(columns, weights=step[rows], minlength=len(weight)).astype(float), float(step.sum())


def _adam(columns: np.ndarray, rows: np.ndarray, counts: np.ndarray, label: np.ndarray, kept: np.ndarray, share: float, rounds: int, rate: float, penalty: float) -> Weights:
    values = np.zeros(DIMS, np.float32)
    if not label.any() or label.all():  # only one kind of text has sentences
        return Weights(values, float(np.log(max(share, 1e-6) / (1 - min(share, 1 - 1e-6)))))
    importance = np.where(label, share / label.mean(), (1 - share) / (1 - label.mean()))
    weight, bias = np.zeros(len(kept)), -4.0
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, gradient, slope = likelihood(weight, bias, columns, rows, counts, label, importance)
        gradient -= penalty * weight
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * slope, 0.99 * vb + 0.01 * slope**2
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        weight += rate * (m / fix) / (np.sqrt(v / fix2) + 1e-6)
        bias += rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-6)
    values[kept] = weight
    return Weights(values, float(bias))


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5, carry: bool = False) -> DataFrame:
    """doc_id, score, and the offending sentences: byte ranges in the text's UTF-8 (first to last word) with their
    probability, for those of at least `offending`. carry: row, all columns of docs (text_col must be a string)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).field(text_col) if carry else batch.column(1)
            for a, b in slices(column):
                texts = column[a:b]
                words, head, logit = sentence_logits(texts, shared.value)
                p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                of = words.texts[head] if len(head) else head
                clean = np.exp(np.bincount(of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=b - a))
                bad = np.flatnonzero(p >= offending)
                last = np.append(head[1:], len(words.starts)) - 1
                offsets = text_bytes(texts)[1]
                begin, end = words.starts[head[bad]] - offsets[of[bad]], words.ends[last[bad]] - offsets[of[bad]]
                spans = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(p[bad])], ["begin", "end", "p"])
                cuts = pa.array(np.searchsorted(of[bad], np.arange(b - a + 1)), pa.int32())
                out = [batch.column(0)[a:b], pa.array(1 - clean), pa.ListArray.from_arrays(cuts, spans), *([batch.column(1)[a:b]] if carry else [])]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = StructType.fromDDL("doc_id bigint, score double, sentences array<struct<begin:int,end:int,p:double>>")
    schema = schema.add("row", docs.schema) if carry else schema
    names = schema.names
    given = F.struct(*docs.columns).alias("row") if carry else F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), given).mapInArrow(rate, schema)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, threshold: float = 0.7, carry: bool = False, **options) -> DataFrame:
    """Learns from labels outside the held-out fold and scores all documents. carry: row, all columns of docs."""
    training = labels.select("doc_id", "toxic").filter(id_remainder("doc_id", folds) != held_fold)
    out = score(docs, fit(docs, training, **options), carry=carry)
    return out.select("doc_id", (id_remainder("doc_id", folds) == held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences", *(["row"] if carry else []))
