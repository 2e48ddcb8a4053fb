"""Spelling variants: words that differ by one letter, found by a rare-first prefix filter of positional bigrams.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. To have slips of the pen in any
table, one in SLIP (document, word) pairs by a hash loses a letter, as the hash says.

1. A word's bigrams are ordered by how many words have them, rarest first. One edit changes two bigrams at most, so of the
   three rarest of a word and the three rarest of its near word one is the same, at the same place, or one place off beside
   the letter put in.
2. Each word files its three rarest bigrams under (bigram, place, length), and looks for its own, and, as the longer
   word, for words of one letter less: six more keys. So each pair is found from one side. Spark joins by the
   key, splits keys with very many words, and tests the pairs in the join, so candidates aren't written: first by the kinds of
   their letters, of which one edit changes two at most, then by levenshtein.
3. A word's form is its near word with most occurrences, if it has `times` as many. Roots follow forms by doubling: a chain
   at least doubles its occurrences at each step, so there are few rounds; words are written each round.

There are 90 letters, so the order of bigrams is a table of 8,100 numbers at most; it goes through the driver.

Nulls: a null text has no words; a null id hashes as an empty text. Repeated rows are counted each. An empty table gives an empty
result; other columns are ignored. Words may be as long as a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import LOWER, mix64, runs, slices, text_bytes, word_edges, word_strings, written

SLICE = 8 << 20
SLIP = 97
#: Letters of a run whose hashes are taken together.
SHORT = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def pair_hashes(prefixes: list[bytes], words: list[bytes], prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """crc32 of prefixes[i] + words[k] for each i in prefix and k in word. A checksum is linear: that of the prefix, moved
    on by the word's length, and that of the word are added."""
    sizes = np.array([len(w) for w in words], np.int64)
    state = np.array([zlib.crc32(p) for p in prefixes], np.uint32)
    moved = [state]
    for _ in range(min(SHORT, int(sizes.max(initial=0)))):
        state = _CRC[state & np.uint32(255)] ^ state >> np.uint32(8)
        moved.append(state)
    size = sizes[word]
    short = size < len(moved)
    out = np.array([zlib.crc32(w) for w in words], np.uint32)[word]
    out[short] ^= np.stack(moved)[size[short], prefix[short]]
    for k in np.flatnonzero(~short):
        out[k] = zlib.crc32(words[word[k]], zlib.crc32(prefixes[prefix[k]]))
    return out


def word_counts(docs: DataFrame, least_letters: int, slip: int = SLIP) -> DataFrame:
    """word and n, partial counts for each slice of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                raw, offsets = text_bytes(batch.column(1)[a:b])
                raw = LOWER[raw]
                inside = (raw >= 97) & (raw <= 122) | (raw == 0xC3)
                inside[1:] |= raw[:-1] == 0xC3
                starts, ends, owner = word_edges(inside, offsets)
                if not len(starts):
                    continue
                coded = word_strings(raw, inside, starts, ends).dictionary_encode()
                words = coded.dictionary
                key, times = np.unique(owner * len(words) + coded.indices.to_numpy(), return_counts=True)
                doc, word = key // len(words), key % len(words)
                names = [f"{'' if i is None else i}:".encode() for i in batch.column(0)[a:b].to_pylist()]
                hashes = pair_hashes(names, words.cast(pa.large_binary()).to_pylist(), doc, word)
                hit = np.flatnonzero(hashes % np.uint32(slip) == 0)
                slips: dict[str, int] = {}
                for k in hit:
                    text = words[int(word[k])].as_py()
                    at = int(hashes[k]) % len(text)
                    text = text[:at] + text[at + 1 :]
                    if len(text) >= least_letters:
                        slips[text] = slips.get(text, 0) + int(times[k])
                n = np.bincount(word, times, len(words)) - np.bincount(word[hit], times[hit], len(words))
                use = np.flatnonzero((n > 0) & (pc.utf8_length(words).to_numpy() >= least_letters))
                texts = pa.concat_arrays([words.take(pa.array(use)).cast(pa.string()), pa.array(list(slips), pa.string())])
                found = pa.concat_arrays([pa.array(n[use].astype(np.int64)), pa.array(list(slips.values()), pa.int64())])
                yield from pa.Table.from_arrays([texts, found], ["word", "n"]).to_batches(max_chunksize=50_000)

    return docs.mapInArrow(count, "word string, n bigint")


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters from 0 to 89, one word after another, and n + 1 offsets."""
    raw, offsets = text_bytes(words)
    first = raw != 0xC3
    code = raw.astype(np.int64) - 97
    code[1:][raw[:-1] == 0xC3] += 97 - 0x80 + 26
    place = np.concatenate([[0], np.cumsum(first)])
    return code[first], place[offsets]


def _bigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of words of two letters or more, the places of those, and the words' first bigrams (n + 1)."""
    code, offsets = _letters(words)
    sizes = np.maximum(np.diff(offsets) - 1, 0)
    at = runs(offsets[:-1], sizes)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    return code[at] * 90 + code[at + 1], at - np.repeat(offsets[:-1], sizes), firsts


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """The rank of each of the 8,100 possible bigrams by the number of its places in words, rarest first."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(8100, np.int64)
        for batch in batches:
            total += np.bincount(_bigrams(batch.column(0))[0], minlength=8100)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bigram", "n"])

    rows = words.select("word").mapInArrow(tally, "bigram bigint, n bigint").groupBy("bigram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(8100, np.int64)
    for r in rows:
        n[r.bigram] = r.n
    rank = np.empty(8100, np.int64)
    rank[np.lexsort((np.arange(8100), n))] = np.arange(8100)
    return rank


def _keys(words: DataFrame, rank: np.ndarray, rarest: int, looking: bool) -> DataFrame:
    """key and the word with its n and kinds (a bit for each letter in it, modulo 64): a 64-bit hash of (bigram, place, length)
    for each rarest bigram, as filed or as looked for."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, edges = _letters(batch.column(0))
            if not len(code):
                continue
            kinds = np.bitwise_or.reduceat(np.uint64(1) << (code % 64).astype(np.uint64), edges[:-1]).view(np.int64)
            bigram, place, firsts = _bigrams(batch.column(0))
            number = np.diff(firsts)
            owner = np.repeat(np.arange(len(number)), number)
            order = np.lexsort((place, rank[bigram], owner))
            order = order[(np.arange(len(owner)) - np.repeat(firsts[:-1], number)) < rarest]
            bigram, place, owner = bigram[order], place[order], owner[order]
            size = number[owner]
            name = lambda g, p, n: mix64(mix64(g.astype(np.uint64) << np.uint64(40) | p.astype(np.uint64)) + n.astype(np.uint64)).view(np.int64)
            keys = [name(bigram, place, size)]
            if looking:
                keys.append(name(bigram, place, size - 1))
                back = place > 0
                keys.append(name(bigram[back], place[back] - 1, size[back] - 1))
                owner = np.concatenate([owner, owner, owner[back]])
            owner = pa.array(owner)
            yield from pa.Table.from_arrays([pa.array(np.concatenate(keys)), *(batch.column(k).take(owner) for k in (0, 1)), pa.array(kinds).take(owner)], ["key", "word", "n", "kinds"]).to_batches(max_chunksize=50_000)

    return words.mapInArrow(make, "key bigint, word string, n bigint, kinds bigint")


def near_words(words: DataFrame) -> DataFrame:
    """Pairs a, b of words (word, n) that differ by exactly one letter put in, left out or replaced, with n_a and n_b. Each pair
    once; a is the longer word, or the larger of equally long ones."""
    rank = bigram_ranks(words)
    filed = _keys(words, rank, 3, looking=False).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("kinds").alias("kinds_b"))
    looked = _keys(words, rank, 3, looking=True).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("kinds").alias("kinds_a"))
    length = lambda c: F.char_length(c)
    one_side = (length("a") > length("b")) | (F.col("a") > F.col("b"))
    alike = F.bit_count(F.col("kinds_a").bitwiseXOR(F.col("kinds_b"))) <= 2
    found = looked.join(filed, "key").filter(alike & one_side & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "b", "n_a", "n_b").distinct()


def variants(docs: DataFrame, least_letters: int = 5, least_n: int = 3, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n. Words have four letters or more, so that an edit leaves one of three bigrams."""
    if least_letters < 4:
        raise ValueError("least_letters must be 4 or more")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = word_counts(rows, least_letters).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)
    words = written(words, "words")
    near = near_words(words)
    sides = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n"))
    sides = sides.unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    found = words.join(best, "word", "left")
    fits = -F.col("best.minus") >= times * F.col("n")
    formed = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"))
    formed = written(formed, "forms")
    roots = written(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("on")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("on").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
