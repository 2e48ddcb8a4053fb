"""Near-duplicate classes by ProbMinHash: signatures of weighted shingles, banding, verification, components.

A text's shingles are its runs of five words (all its words, if it has fewer), weighted by how often they occur. The
similarity is the probability Jaccard index, which is invariant to scale and equals the Jaccard index for equal
weights. Each shingle's occurrences arrive as a Poisson process whose rate is its weight; each arrival falls into a
random register, which keeps the shingle of its first arrival. A shingle stops as soon as its next arrival comes after
every register's first, so most shingles need very few.

1. Texts with equal words (or, without words, equal texts) are one node, with a number of its own.
2. Registers are banded. In each bucket every node is paired with the smallest node: stars, never all pairs. The nodes of
   a bucket with very many are dealt over several tasks for it.
3. Pairs are verified on their whole texts, and verified pairs give components.
4. Where a bucket's nodes are in several components, the nodes outside that of its smallest node are compared with all
   nodes of other components in the bucket, inside tiles of bounded size: first by their registers, so that each such
   node's two nearest are verified as in 3, which joins most components; then whatever is still apart by whole texts inside
   the tile. There an index of the tile's shingles bounds the similarity from above (see shared_share), and pairs within
   the bound are compared exactly. A tile gives only links that join components. So no two similar nodes that share a bucket
   stay apart, and no bucket is written out as pairs.

Nulls: rows without id or without text take no part; their class is null. Texts without words are alike
only if they are equal. Rows that share an id are one document: each of its texts is a node, and these are linked. Empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import find_words, hot_salts, lists, mix64, numbered, runs, salted_join, scratch, slices, written

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
TILE = 1024
#: Bytes of text in a side of a tile, on average.
TILE_BYTES = 4 << 20


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingles of texts (given by their words' hashes and first words), and n + 1 offsets."""
    counts = np.diff(firsts)
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    starts = runs(firsts[:-1], number)
    width = np.repeat(np.minimum(counts, size), number)
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        more = width > k
        out[more] = mix64(out[more] + hashes[starts[more] + k] + GOLDEN)
    return out, np.concatenate([[0], np.cumsum(number)])


def weigh(found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text with their numbers: owners (ascending), shingles, weights."""
    order = np.argsort(mix64(found + owner.astype(np.uint64) * GOLDEN), kind="stable")
    found, owner = found[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])) if len(found) else order
    weight = np.diff(np.append(head, len(found)))
    back = np.argsort(owner[head], kind="stable")
    return owner[head][back], found[head][back], weight[back]


def prob_minhash(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the shingle of the first arrival in each register; zeros where a text has none."""
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    time = np.zeros(len(owner))
    state = mix64(shingle ^ GOLDEN)
    rate = weight.astype(float)
    while len(owner):
        state = state + GOLDEN
        draw = mix64(state)
        time = time - np.log1p(-((draw >> np.uint64(11)) * 2.0**-53)) / rate
        place = owner * registers + (mix64(draw ^ shingle) % np.uint64(registers)).astype(np.int64)
        sooner = np.flatnonzero(time < first[place])
        at, when = place[sooner], time[sooner]
        np.minimum.at(first, at, when)
        mine = when == first[at]
        winner[at[mine]] = shingle[sooner[mine]]
        latest = first.reshape(texts, registers).max(axis=1)
        on = np.flatnonzero(time < latest[owner])
        owner, shingle, time, state, rate = owner[on], shingle[on], time[on], state[on], rate[on]
    return winner.reshape(texts, registers)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, mark (a hash of the text), key (128 bits of the words or of the text), one 64-bit bucket for each band (none without words), and
    the registers' lowest 16 bits."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words = find_words(batch.column(1)[a:b])
                n = b - a
                found, offsets = shingles(words.hashes, words.firsts, size)
                winners = prob_minhash(*weigh(found, np.repeat(np.arange(n), np.diff(offsets))), n, bands * rows)
                bucket = np.broadcast_to(np.arange(bands, dtype=np.uint64) * GOLDEN, (n, bands)).copy()
                for k in range(rows):
                    bucket = mix64(bucket + winners.reshape(n, bands, rows)[:, :, k] + GOLDEN)
                some = words.counts > 0
                keys = []
                for k, (lo, hi) in enumerate(zip(words.firsts[:-1], words.firsts[1:])):
                    line = words.hashes[lo:hi]
                    keys.append(_digest(line.tobytes() if some[k] else (batch.column(1)[a + k].as_py() or "").encode(), some[k]))
                ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
                marks = pa.array([x.tobytes() for x in winners.astype("<u2")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(keys, pa.string()), lists(bucket[some].ravel().view(np.int64), ends), marks], ["doc_id", "mark", "key", "buckets", "registers"])

    return docs.mapInArrow(sign, "doc_id bigint, mark bigint, key string, buckets array<bigint>, registers binary")


def _digest(data: bytes, words: bool) -> str:
    import hashlib

    return hashlib.md5((b"w" if words else b"t") + data).hexdigest()


def probability_jaccard(x: dict | tuple, y: tuple) -> float:
    """Of two weighted sets, each given as sorted shingles and their weights."""
    (a, u), (b, v) = x, y
    union, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = np.zeros(len(union)), np.zeros(len(union))
    p[at[: len(a)]], q[at[len(a) :]] = u, v
    both = (p > 0) & (q > 0)
    if not both.any():
        return 0.0
    if (p[both] == q[both]).all() and p.max() == q.max() == 1:
        return float(both.sum() / len(union))
    with np.errstate(divide="ignore"):
        ratio = np.where(q > 0, p / np.where(q > 0, q, 1), np.inf)
    order = np.argsort(-ratio, kind="stable")
    p, q, both = p[order], q[order], both[order]
    # max(p'/p, q'/q) is p'/p for elements whose ratio is not smaller, q'/q for the others.
    high, low = np.cumsum(p), q.sum() - np.cumsum(q)
    return float((1 / (high[both] / p[both] + low[both] / q[both])).sum())


def verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least the threshold similarity. Both joins are plain sort-merge joins on
    one id each, so that adaptive execution splits the rows of a hot centre."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            for a, b in slices(batch.column(2), 1 << 19):
                sets = [_weighted(batch.column(2)[a:b], size), _centres(batch.column(3)[a:b], ids[1][a:b], size, last)]
                for k in range(b - a):
                    keep[a + k] = probability_jaccard(sets[0][k], sets[1][k]) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a bigint, b bigint")


def _weighted(texts: pa.Array, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    words = find_words(texts)
    found, offsets = shingles(words.hashes, words.firsts, size)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        out.append(np.unique(found[a:b], return_counts=True))
    return out


def _centres(texts: pa.Array, ids: np.ndarray, size: int, last: dict) -> list:
    """As _weighted, but the rows of one centre, which come together, are weighed once."""
    out = []
    for k, i in enumerate(ids):
        if last.get("id") != i:
            last.update(id=i, set=_weighted(texts[k : k + 1], size)[0])
        out.append(last["set"])
    return out


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node that links (a, b) lead to, for all nodes in links.

    Each round a node takes the smallest label around it and then that label's own label; labels are written to the
    shared folder each round, and the rounds grow with the logarithm of a chain's length.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        lower = labels.join(near, "node", "left").select("node", "label", F.least("label", "other").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        moved = written(lower.join(jump, "next", "left").select("node", "label", F.least("next", "further").alias("next")), "labels")
        labels = moved.select("node", F.col("next").alias("label"))
        if moved.filter("next < label").isEmpty():
            return labels


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 8
) -> DataFrame:
    """One row per row of docs: doc_id and class_id (the smallest id of its class).

    With 32 bands of 8 registers, two texts of similarity 0.8 share a bucket with probability 0.997, of 0.85 with
    0.9999.
    """
    rows_of = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    usable = rows_of.filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("mark", F.xxhash64("text"))
    with scratch(docs.sparkSession):  # all but what the result reads goes when the classes are written
        signed = written(signatures(usable, size, bands, rows), "signatures", keep=True)
        # A node's first: the smallest id of its rows, and with mark a row that stands for it.
        firsts = signed.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("f"), F.count("*").alias("n")).select("key", F.col("f.doc_id").alias("first"), F.col("f.mark").alias("first_mark"), "n")
        nodes = numbered(firsts.sortWithinPartitions("first", "key"), "nodes").withColumnRenamed("row_key", "node")
        # Texts with very many copies are dealt over several tasks, wherever all rows meet their nodes.
        copied = written(hot_salts(nodes, "key", "n")[0], "copied", keep=True)
        nodes = nodes.drop("n")
        by_key = lambda left, right: salted_join(left, right, copied, "key", F.col("doc_id"))
        # A document that has several texts is one: all its nodes are linked to the smallest of them.
        copies = by_key(signed.select("doc_id", "key"), nodes.select("key", "node")).select("doc_id", "node")
        several = copies.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b < most").select("doc_id", "b")
        again = written(copies.join(several, "doc_id").filter("node > b").select(F.col("node").alias("a"), "b").distinct(), "again")
        stands = (F.col("doc_id") == F.col("first")) & (F.col("mark") == F.col("first_mark"))
        unique = by_key(signed.select("doc_id", "mark", "key", "buckets"), nodes).filter(stands).select("node", F.explode("buckets").alias("bucket"))
        buckets = written(unique, "buckets")
        shared = buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("other"), F.count("*").alias("n")).filter("centre < other")
        shared = written(shared.select("bucket", "centre", "n"), "shared")
        hot, _ = hot_salts(shared, "bucket", "n")
        hot = written(hot, "hot")
        members = written(salted_join(buckets, shared.select("bucket", "centre"), hot, "bucket", F.col("node")).select("bucket", "node", "centre"), "members")
        involved = nodes.join(members.select("node").distinct(), "node").select("node", "first", "first_mark")
        # Grouped by what the join shuffles by, so that texts aren't shuffled again.
        texts = usable.join(involved, stands).groupBy("doc_id", "mark").agg(F.min("node").alias("node"), F.min("text").alias("text"))
        texts = written(texts.select("node", "text"), "texts")

        pairs = members.filter("node > centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
        met = written(pairs, "pairs")
        every = written(verified(met, texts, size, threshold), "verified")
        # First, by an estimate, each stray's two nearest nodes, which join most components; then all pairs that are still apart.
        least = threshold - 3 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
        mixed = _mixed(members, components(every.unionByName(again)), hot)
        near = _in_tiles(mixed, _marked(mixed, nodes, signed), hot, lambda rows: _tile_nearest(rows, least, 2)).distinct()
        near = written(near.join(met, ["a", "b"], "left_anti"), "pairs")
        every = every.unionByName(written(verified(near, texts, size, threshold), "verified"))
        mixed = _mixed(members, components(every.unionByName(again)), hot)
        marked = _marked(mixed, nodes, signed).join(texts, "node")
        every = every.unionByName(written(_in_tiles(mixed, marked, hot, lambda rows: _tile_links(rows, size, threshold)).distinct(), "verified"))
        labels = components(every.unionByName(again))
        named = written(nodes.join(labels, "node", "left").select("key", "first", F.coalesce("label", "node").alias("label")), "named")
        smallest = written(named.groupBy("label").agg(F.min("first").alias("class_id"), F.count("*").alias("n")), "smallest")
        large = hot_salts(smallest, "label", "n")[0]
        named = written(salted_join(named, smallest.select("label", "class_id"), large, "label", F.col("key")).select("key", "class_id"), "classes", keep=True)
    out = by_key(signed.select("doc_id", "key"), named).select("doc_id", "class_id")
    rest = rows_of.filter("doc_id IS NULL OR text IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(rest)


def _mixed(members: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """bucket, node, label and main (the label of the bucket's smallest node) of buckets with several components."""
    named = members.join(labels, "node", "left").select("bucket", "node", "centre", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.when(F.col("node") == F.col("centre"), F.col("label"))).alias("main"))
    found = salted_join(named, several.filter("low < high").select("bucket", "main"), hot, "bucket", F.col("node"))
    return written(found.select("bucket", "node", "label", "main").distinct(), "mixed")


def _marked(mixed: DataFrame, nodes: DataFrame, signed: DataFrame) -> DataFrame:
    """node and registers of the nodes of mixed buckets."""
    wanted = nodes.join(mixed.select("node").distinct(), "node").select("node", "first", "first_mark")
    found = signed.join(wanted, (F.col("doc_id") == F.col("first")) & (F.col("mark") == F.col("first_mark")))
    return found.dropDuplicates(["node"]).select("node", "registers")


def _in_tiles(mixed: DataFrame, marked: DataFrame, hot: DataFrame, pairs_of: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """Pairs (a > b) of nodes of different components in a bucket, as pairs_of finds them in each tile.

    Strays (nodes outside the main component) meet all nodes of their bucket in tiles of about TILE by TILE nodes, fewer
    where marked has long texts; rows are made for nodes and tiles.
    """
    stray = F.col("label") != F.col("main")
    columns = ["node", "label", *(c for c in marked.columns if c != "node")]
    bytes_of = F.octet_length("text").cast("long") if "text" in columns else F.lit(0).cast("long")
    rows = mixed.join(marked, "node").withColumn("bytes", bytes_of)
    parts = lambda number, size: F.greatest(F.ceil(number / F.lit(TILE)), F.ceil(size / F.lit(TILE_BYTES))).cast("int")
    sizes = rows.groupBy("bucket").agg(parts(F.count("*"), F.sum("bytes")).alias("n_all"), parts(F.sum(stray.cast("int")), F.sum(F.when(stray, F.col("bytes")).otherwise(0))).alias("n_strays"))
    rows = salted_join(rows.drop("bytes"), sizes, hot, "bucket", F.col("node"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = rows.filter(stray).select("bucket", place("n_strays").alias("s"), F.explode(up_to("n_all")).alias("m"), F.lit(True).alias("stray"), *columns)
    right = rows.select("bucket", F.explode(up_to("n_strays")).alias("s"), place("n_all").alias("m"), F.lit(False).alias("stray"), *columns)
    tile = F.xxhash64("bucket", "s", "m").alias("tile")
    dealt = left.unionByName(right).select(tile, "stray", *columns).repartition("tile").sortWithinPartitions("tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            tiles = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and held[-1].column(0)[0].as_py() != tiles[lo]:
                    yield pairs_of(pa.concat_tables(held))
                    held = []
                if hi > lo:
                    held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
        if held:
            yield pairs_of(pa.concat_tables(held))

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _parts_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile: strays, nodes, labels, and nodes x registers."""
    stray, node, label = (rows.column(c).to_numpy() for c in ("stray", "node", "label"))
    return stray, node, label, np.frombuffer(b"".join(x.as_py() for x in rows.column("registers")), "<u2").reshape(len(node), -1)


def _pairs(first: list, second: list) -> pa.RecordBatch:
    a, b = np.array(first, np.int64), np.array(second, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _tile_nearest(rows: pa.Table, least: float, nearest: int) -> pa.RecordBatch:
    """Of each stray the nodes whose registers agree most, among those that agree in a share of `least`."""
    stray, node, label, registers = _parts_of(rows)
    others = np.flatnonzero(~stray)
    first, second = [], []
    for k in np.flatnonzero(stray):
        agree = (registers[others] == registers[k]).mean(axis=1) * (label[others] != label[k])
        close = np.flatnonzero(agree >= least)
        close = close[np.argsort(-agree[close], kind="stable")[:nearest]]
        first += [node[k]] * len(close)
        second += node[others[close]].tolist()
    return _pairs(first, second)


def shared_share(x: tuple[np.ndarray, np.ndarray], index: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Of a weighted set (shingles, weights) with each of n others: the sum over shared shingles of the lesser share of the weights.
    The probability Jaccard index is never more: a shared shingle adds 1 / sum(max(.)), and that sum is at least the greater
    of the two sets' weights over the shingle's. index: the others' shingles in order, with their shares and sets."""
    found, share, owner = index
    lo = np.searchsorted(found, x[0])
    number = np.searchsorted(found, x[0], "right") - lo
    at = runs(lo, number)
    mine = np.repeat(x[1] / x[1].sum(), number)
    return np.bincount(owner[at], np.minimum(mine, share[at]), n)


def _index(sets: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets' shingles in order, each with its share of the set's weight and the set's number."""
    found, owner = np.concatenate([x for x, _ in sets]), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    share = np.concatenate([(n / max(n.sum(), 1)).astype(np.float32) for _, n in sets])
    order = np.argsort(found, kind="stable").astype(np.int32)
    return found[order], share[order], owner[order]


def _tile_links(rows: pa.Table, size: int, threshold: float) -> pa.RecordBatch:
    """Similar pairs by whole texts, until no two components of the tile have a similar pair and are still apart."""
    stray, node, label, _ = _parts_of(rows)
    group = np.unique(label, return_inverse=True)[1]
    others = np.flatnonzero(~stray)
    sets = []
    for part in rows.column("text").chunks:
        for a, b in slices(part, 1 << 19):
            sets += [(x, n.astype(np.int32)) for x, n in _weighted(part[a:b], size)]
    first, second = [], []
    sizes = np.array([len(sets[o][0]) for o in others], np.int64)
    if sizes.sum():
        index = _index([sets[o] for o in others], sizes)
        for k in np.flatnonzero(stray):
            if not len(sets[k][0]):
                continue
            bound = shared_share(sets[k], index, len(others))
            close = np.flatnonzero((bound >= threshold - 1e-4) & (group[others] != group[k]))  # shares are single precision
            for o in others[close[np.argsort(-bound[close], kind="stable")]]:
                if group[o] != group[k] and probability_jaccard(sets[k], sets[o]) >= threshold:
                    first.append(node[k])
                    second.append(node[o])
                    group[group == group[o]] = group[k]
    return _pairs(first, second)
