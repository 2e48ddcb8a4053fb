"""Names matched with terms in batches: equal, prefix, contained, similar and alike in sound (survey group ADV).

Both sides may have any number of rows; nothing is crossed. Containment goes by an inverted index: a name that holds a term holds
the term's rarest bigram. Similarity is the indel ratio, 2 * longest common subsequence / (length + length). Texts are dealt into
blocks of like lengths, and each two blocks whose lengths may match meet in one tile of bounded size. There the number of common
characters, repeats counted, which no common subsequence exceeds, comes from products of matrices, and the pairs that it leaves are
compared by bits. So no pair is shuffled before it is found; the comparisons are all pairs of like lengths.

Nulls and empty texts match nothing. Repeated names and terms count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.sources.tables import Rounds

#: Texts and characters of a block, about.
TEXTS, CHARS = 2048, 1 << 15
#: Rows of the terms' side that are sent to all tasks; of more, both sides are dealt out. What comes of the names is never sent.
SMALL = 200_000
#: Characters with a sound that are written into the plan as a map, which is searched from its start for each character.
SIGNS = 64


def _met(big: DataFrame, small: DataFrame, few: bool, on: str, how: str = "inner") -> DataFrame:
    """A join whose sides Spark doesn't choose by its estimates, which leave out how many rows an explode gives."""
    return big.join(F.broadcast(small), on, how) if few else big.hint("merge").join(small, on, how)


def _chars(text: str) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _plain(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.select(F.col(column).cast("string").alias(name)).filter(F.col(name) != "").distinct()


def _grams(rows: DataFrame, column: str) -> DataFrame:
    """The column and its different bigrams and characters."""
    size = F.char_length(column)
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substr(column, i, F.lit(2)))
    return rows.select(column, F.explode(F.array_distinct(F.concat(_chars(column), F.when(size > 1, pairs).otherwise(F.array().cast("array<string>"))))).alias("gram"))


def contained(names: DataFrame, terms: DataFrame, few: bool = False) -> DataFrame:
    """name, variant: the names that hold the variant. A variant of one character is looked up by it, others by the bigram that
    fewest names have; variants with a bigram that no name has match none. few: there are at most SMALL variants."""
    index = _grams(names, "name")
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = _grams(terms, "variant").filter((F.char_length("gram") == 2) | (F.char_length("variant") == 1))
    rarest = _met(asked, often, False, "gram", "left").groupBy("variant").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    found = _met(index, rarest.filter("least.n > 0").select("variant", F.col("least.gram").alias("gram")), few, "gram")
    return found.filter(F.contains("name", F.col("variant"))).select("name", "variant")


def _filed(rows: DataFrame, column: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The column with its kind (the power of two of its length) and a part of it, and the kinds with their parts and lengths."""
    size = F.char_length(column)
    rows = rows.filter(size > 0).withColumn(f"{name}_kind", F.floor(F.log2(size)).cast("int"))
    parts = F.ceil(F.greatest(F.count("*") / TEXTS, F.sum(size) / CHARS)).cast("int")
    kinds = rows.groupBy(f"{name}_kind").agg(parts.alias(f"{name}_parts"), F.min(size).alias("shortest"), F.max(size).alias("longest"))
    part = F.pmod(F.xxhash64(column), F.col(f"{name}_parts")).cast("int")
    return rows.join(F.broadcast(kinds.select(f"{name}_kind", f"{name}_parts")), f"{name}_kind").select(column, f"{name}_kind", part.alias(f"{name}_part")), kinds


def similar(names: DataFrame, terms: DataFrame, ratio: float = 0.7) -> DataFrame:
    """name, variant and their indel ratio, where that is at least `ratio` (over 0)."""
    left, kinds = _filed(names, "name", "name")
    right, others = _filed(terms, "variant", "term")
    shortest = F.greatest(F.ceil(F.col("shortest") * F.lit(ratio / (2 - ratio)) - F.lit(1e-9)), F.lit(1))
    longest = F.floor(F.col("longest") * F.lit((2 - ratio) / ratio) + F.lit(1e-9))
    near = F.explode(F.sequence(F.floor(F.log2(shortest)).cast("int"), F.floor(F.log2(longest)).cast("int")))
    met = F.broadcast(kinds.select("name_kind", "name_parts", near.alias("term_kind")).join(F.broadcast(others.select("term_kind", "term_parts")), "term_kind"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}_parts") - 1)).alias(f"{name}_part")
    tile = ["name_kind", "name_part", "term_kind", "term_part"]
    left = left.join(met, "name_kind").select("name", "name_kind", "name_part", "term_kind", every("term"))
    right = right.join(met, "term_kind").select("variant", *(F.col(c).alias(c) for c in ("term_kind", "term_part", "name_kind")), every("name"))

    def compare(first: pa.Table, second: pa.Table) -> pa.Table:
        i, j, score = alike(first["name"].to_pylist(), second["variant"].to_pylist(), ratio)
        return pa.table({"name": first["name"].take(pa.array(i)), "variant": second["variant"].take(pa.array(j)), "ratio": score})

    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(compare, "name string, variant string, ratio double")


def alike(first: list[str], second: list[str], ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the two lists of the pairs of texts with an indel ratio of at least `ratio`, and that ratio."""
    if not first or not second:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    size, other = (np.array([len(x) for x in texts], np.int64) for texts in (first, second))
    codes = [_codes(texts, lengths) for texts, lengths in ((first, size), (second, other))]
    shared = np.intersect1d(*(c[c > 0] for c in codes))  # only these can be in common; others are 0, as is what fills up
    codes = [np.where(np.isin(c, shared), np.searchsorted(shared, c) + 1, 0) for c in codes]
    wide = len(shared) + 1
    often = [np.bincount((np.arange(len(c))[:, None] * wide + c).ravel(), minlength=len(c) * wide).reshape(len(c), wide)[:, 1:] for c in codes]
    bound, times = np.zeros((len(first), len(second)), np.float32), 1
    while True:  # a character that is in both so many times adds one
        has = [o >= times for o in often]
        both = has[0].any(0) & has[1].any(0)
        if not both.any():
            break
        bound += has[0][:, both].astype(np.float32) @ has[1][:, both].astype(np.float32).T
        often, times = [o[:, both] for o in often], times + 1
    i, j = np.nonzero(bound >= np.ceil(ratio / 2 * (size[:, None] + other) - 1e-9))
    common = np.zeros(len(i), np.int64)
    masks = np.zeros((len(first), wide), np.uint64)
    for at in range(min(codes[0].shape[1], 64)):
        masks[np.arange(len(first)), codes[0][:, at]] |= np.uint64(1) << np.uint64(at)
    masks[:, 0] = 0
    short = np.flatnonzero(size[i] <= 64)
    for at in range(0, len(short), 1 << 16):
        some = short[at : at + (1 << 16)]
        rows, texts = i[some], codes[1][j[some]]
        state = np.full(len(some), ~np.uint64(0))
        for k in range(int(other[j[some]].max())):
            mask = masks[rows, texts[:, k]]
            hit = state & mask
            state = (state + hit) | (state & ~mask)
        bits = np.where(size[rows] == 64, ~np.uint64(0), (np.uint64(1) << (size[rows] % 64).astype(np.uint64)) - np.uint64(1))
        common[some] = np.bitwise_count(~state & bits)
    score = 2 * common / (size[i] + other[j])
    long = np.flatnonzero(size[i] > 64)
    if len(long):
        score[long] = indel_ratios([first[k] for k in i[long]], [second[k] for k in j[long]])
    keep = score >= ratio - 1e-12
    return i[keep], j[keep], score[keep]


def _codes(texts: list[str], lengths: np.ndarray) -> np.ndarray:
    """A row of characters, as numbers from 1, for each text, filled up with 0."""
    wide = max(int(lengths.max()), 1)
    points = np.array(texts, f"<U{wide}").view(np.uint32).reshape(len(texts), wide).astype(np.int64)
    return np.where(np.arange(wide) < lengths[:, None], points + 1, 0)


def indel_ratios(first: list[str], second: list[str]) -> np.ndarray:
    """2 * longest common subsequence / (length + length) of each pair; 0 where both are empty. The subsequence is found by
    bit-parallel addition with carry: a zero bit for each character of the first text that is in it."""
    size = np.array([len(x) for x in first], np.int64)
    other = np.array([len(x) for x in second], np.int64)
    common = np.zeros(len(first), np.int64)
    short = np.flatnonzero((size <= 64) & (size > 0) & (other > 0))
    for at in range(0, len(short), 4096):
        some = short[at : at + 4096]
        codes = [np.array([ord(c) for k in some for c in texts[k].ljust(width, "\0")], np.int64).reshape(len(some), width) for texts, width in ((first, int(size[some].max())), (second, int(other[some].max())))]
        power = np.uint64(1) << np.arange(codes[0].shape[1], dtype=np.uint64)
        inside = np.arange(codes[0].shape[1]) < size[some, None]
        state = np.full(len(some), ~np.uint64(0))
        for j in range(codes[1].shape[1]):
            mask = ((codes[0] == codes[1][:, j, None]) & inside & (j < other[some])[:, None]) @ power
            hit = state & mask
            state = (state + hit) | (state & ~mask)
        bits = np.where(size[some] == 64, ~np.uint64(0), (np.uint64(1) << (size[some] % 64).astype(np.uint64)) - np.uint64(1))
        common[some] = np.bitwise_count(~state & bits)
    for k in np.flatnonzero((size > 64) & (other > 0)):
        masks: dict[str, int] = {}
        for i, c in enumerate(first[k]):
            masks[c] = masks.get(c, 0) | 1 << i
        whole = (1 << int(size[k])) - 1
        state = whole
        for c in second[k]:
            hit = state & masks.get(c, 0)
            state = (state + hit | state & ~masks.get(c, 0)) & whole
        common[k] = int(size[k]) - state.bit_count()
    return 2 * common / np.maximum(size + other, 1)


def sound_keys(rows: DataFrame, column: str, sounds: DataFrame, few: bool = False) -> DataFrame:
    """The column and its key: each character's sound from the table (char, sound; of several the least), one after another, others
    in lower case as they are. The table may be as large as a script; few: it has at most SMALL rows."""
    one = sounds.groupBy("char").agg(F.min("sound").alias("sound"))
    if few and len(signs := one.filter("char IS NOT NULL AND sound IS NOT NULL").limit(SIGNS + 1).collect()) <= SIGNS:  # no row for each character
        known = F.create_map(*(F.lit(x) for r in signs for x in r)) if signs else F.lit(None)
        sound = lambda c: F.coalesce(F.element_at(known, c), F.lower(c)) if signs else F.lower(c)
        return rows.select(column, F.array_join(F.transform(_chars(column), sound), "").alias("key"))
    spread = _met(rows.select(column, F.posexplode(_chars(column)).alias("at", "char")), one, few, "char", "left")
    parts = F.array_sort(F.collect_list(F.struct("at", F.coalesce("sound", F.lower("char")).alias("sound"))))
    return spread.groupBy(column).agg(F.array_join(F.transform(parts, lambda p: p["sound"]), "").alias("key"))


def match_batch(names: DataFrame, terms: DataFrame, ratio: float = 0.7, sounds: DataFrame | None = None) -> DataFrame:
    """term, name, tier and ratio: 1 equal to a variant of the term, 2 begins with one, 3 holds one, 4 similar to one (the largest
    ratio; null in the other tiers), 5 alike in sound, by the table of sounds; the least tier of each pair.

    names: name; terms: term, variant (a variant of itself too). The different names are written once and read by each tier."""
    steps = Rounds(names.sparkSession)
    names = steps.written(_plain(names, "name", "name"), "names")
    asked = terms.select(F.col("term").cast("string").alias("term"), F.col("variant").cast("string").alias("variant")).filter("variant <> '' AND term IS NOT NULL").distinct()
    variants = steps.written(asked.select("variant").distinct(), "variants")
    few, brief = asked.count() <= SMALL, sounds is not None and sounds.count() <= SMALL
    tier = F.when(F.col("name") == F.col("variant"), 1).when(F.startswith("name", F.col("variant")), 2).otherwise(3)
    found = contained(names, variants, few).select("name", "variant", tier.alias("tier"), F.lit(None).cast("double").alias("ratio"))
    found = found.unionByName(similar(names, variants, ratio).select("name", "variant", F.lit(4).alias("tier"), "ratio"))
    if sounds is not None:
        keys = _met(sound_keys(names, "name", sounds, brief), sound_keys(variants, "variant", sounds, brief), few, "key").filter("key <> ''")
        found = found.unionByName(keys.select("name", "variant", F.lit(5).alias("tier"), F.lit(None).cast("double").alias("ratio")))
    best = F.min(F.struct("tier", (-F.col("ratio")).alias("less")))
    out = _met(found, asked, few, "variant").groupBy("term", "name").agg(best.alias("best"))
    return out.select("term", "name", F.col("best.tier").alias("tier"), F.round(-F.col("best.less"), 6).alias("ratio"))
