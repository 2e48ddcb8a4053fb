"""Source divergence, spelling variants and suffix dedup on small tables, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from lexigrid.llm import divergence, spelling, suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block string, name string, least string, word string, term string"


def made(spark, rows):
    """Rows of (doc_id, text, lang, source), with further columns whose names clash."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "v", "w") for r in rows], SCHEMA)


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def mixed_texts():
    random = np.random.RandomState(8)
    pool = [f"{a}{b}" for a in ("alpha", "Beta", "gamma", "GAMM", "gammé", "straße", "øre", "漢字", "x") for b in ("", "s", "tion", "7", "é")]
    rows = []
    for k in range(150):
        text = " ".join(random.choice(pool, random.choice([0, 1, 5, 60])))
        rows.append((int(random.randint(120)) if k % 11 else None, text, ["en", "fr", None][k % 3], ["a", "b", "é", None, ""][random.randint(5)]))
    rows += [(500, None, "en", "lonely"), (501, "", "de", "only"), (502, "one two", "it", "x"), (503, "three", "it", "y"), (504, "word " * 5000, "en", "a")]
    return rows + rows[:4]


def audit_by_hand(rows, least_docs, most_terms):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        of = collections.Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in of if of[t] >= least_docs]
        counts = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if of[t] >= least_docs) for s in {d[1] for d in mine}}
        every = sum(counts.values(), collections.Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in counts.items():
            pairs = [(sum(f(share(c, t), share(counts[x], t)) for t in kept), x) for x in counts if x != s]
            terms = [(f(share(c, t), share(every, t)), t) for t in kept if c[t] and share(c, t) > share(every, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, k + 1) for k, (v, x) in enumerate(found) if part == "pair" or k < most_terms]
    return sorted(out)


@pytest.mark.parametrize(("least_docs", "most_terms"), [(3, 200), (2, 4), (1, 10), (10_000, 5)])
def test_source_divergence(spark, least_docs, most_terms, monkeypatch):
    monkeypatch.setattr(divergence, "OFTEN", 2)  # most terms are dealt over tasks
    rows = mixed_texts()
    got = divergence.audit(made(spark, rows).repartition(5), least_docs, most_terms)
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, least_docs, most_terms)


def test_source_divergence_parts():
    """Runs that go on over batches, pairs in small parts, and counts of more than 64 bits times a thousand million."""
    import pyarrow as pa

    rows = [("en", t, s, k, 1, 2) for k, (t, s) in enumerate([("a", "x")] * 5 + [("a", "y")] + [("b", "x")] * 4)]
    table = pa.Table.from_pylist([dict(zip(divergence._ROW.names, r)) for r in rows], schema=divergence._ROW)
    for size in (1, 2, 3, 100):
        out = pa.Table.from_batches(divergence._added(iter(table.to_batches(max_chunksize=size))))
        assert [(r["term"], r["source"], r["docs"], r["n"]) for r in out.to_pylist()] == [("a", "x", 5, 10), ("a", "y", 1, 2), ("b", "x", 4, 8)]
        parts = list(divergence._whole(iter(out.to_batches(max_chunksize=size)), ["lang", "term"], 1))
        assert sum(p.num_rows for p in parts) == 3 and all(len(set(p.column("term").to_pylist()) & set(q.column("term").to_pylist())) == 0 for p in parts for q in parts if p is not q)


def test_large_counts(spark):
    one = spark.createDataFrame([(40_000_000_000_000, 90_000_000_000_000, 7)], "n bigint, total bigint, v bigint")
    assert one.select(divergence.billionths("n", "total", "v")).first()[0] == 1 + 10**9 * (4 * 10**13 + 1) // (9 * 10**13 + 7)


def variants_by_hand(rows, least_n):
    counts = collections.Counter()
    for doc_id, text, *_ in rows:
        for run, n in collections.Counter(re.findall("[A-Za-z\u00c0-\u00ff]+", low(text))).items():
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += n
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))

    found = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(found[w]), words.get(form[w])))
    return sorted(out, key=repr)


def spelled_texts():
    random = np.random.RandomState(9)
    letters = list("abé")
    pool = ["".join(random.choice(letters, random.randint(4, 8))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "bbbbb", "Straße", "ÿÀ×÷ßa", "ababab", "bababa"]
    weights = 1 / np.arange(1, len(pool) + 1)
    rows = [(int(random.randint(200)) if k % 13 else None, " ".join(random.choice(pool, random.choice([0, 3, 50]), p=weights / weights.sum())) + "漢", "en", "a") for k in range(220)]
    return rows + [(300, None, None, None), (301, "", "en", "a"), (302, "abé" * 30000 + " " + "q" * 60, "en", "a")] + rows[:5]


@pytest.mark.parametrize("least_n", [3, 1])
def test_spelling_variants(spark, least_n):
    rows = spelled_texts()
    got = spelling.variants(made(spark, rows).repartition(4), least_n=least_n)
    assert sorted(map(tuple, got.collect()), key=repr) == variants_by_hand(rows, least_n)


def test_pair_hashes():
    words = [b"", b"a", "é".encode() * 20, b"x" * 200, b"word"]
    prefixes = [b"1:", b":", b"-77:"]
    at = [(i, k) for i in range(3) for k in range(5)]
    got = spelling.pair_hashes(prefixes, words, np.array([i for i, _ in at]), np.array([k for _, k in at]))
    assert got.tolist() == [zlib.crc32(prefixes[i] + words[k]) for i, k in at]


def test_empty_tables(spark):
    assert divergence.audit(made(spark, [])).collect() == []
    assert spelling.variants(made(spark, [])).collect() == []


def cut_by_hand(rows, length):
    least = {}
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            if doc_id is not None:
                least[raw[k : k + length]] = min(doc_id, least.get(raw[k : k + length], doc_id))
    out = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            first = least.get(raw[k : k + length])
            if first is not None and (doc_id is None or first < doc_id):
                gone[k : k + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(raw)]).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeated_texts():
    random = np.random.RandomState(5)
    letters = list("abcde \n") + ["é", "漢"]
    passages = ["".join(random.choice(letters, n)) for n in (30, 49, 50, 51, 80, 400)] + ["-" * 200, "ab" * 90, "x" * 60]
    rows = []
    for k in range(60):
        parts = ["".join(random.choice(letters, random.randint(0, 90))) if random.rand() < 0.5 else passages[random.randint(len(passages))] for _ in range(random.randint(0, 7))]
        rows.append((int(random.randint(40)) if k % 9 else None, "".join(parts), "en", "a"))
    long = "".join(random.choice(letters, 40000))
    rows += [(100, long, "en", "a"), (101, long[:20000] + "!" + long[20000:], "en", "a"), (102, long, "en", "a"), (103, None, "en", "a"), (104, "", "en", "a"), (105, "x" * 50, None, None)]
    return rows + rows[:3]


@pytest.mark.parametrize("most_held", [100_000, 40, 2])
@pytest.mark.parametrize("length", [50, 20])
def test_suffix_dedup(spark, most_held, length):
    rows = repeated_texts()
    got = suffix_dedup.report(suffix_dedup.without_repeats(made(spark, rows).repartition(3).sortWithinPartitions("n_chars"), length, most_held=most_held))
    assert sorted(map(tuple, got.collect()), key=repr) == cut_by_hand(rows, length)


def test_suffix_dedup_in_pieces(spark, monkeypatch):
    """Long texts are taken in pieces; blocks of many texts too."""
    rows = repeated_texts()
    blocks = []
    for k, piece in enumerate((1000, 64, 2 << 20)):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        for a, b, raw, firsts, at in suffix_dedup._pieces(__import__("pyarrow").array([r[1] for r in rows]), 50):
            place, _, first, last = suffix_dedup.anchors(raw, firsts, 50)
            text = a + np.searchsorted(firsts, first, "right") - 1
            found = [(int(t), int(p - firsts[t - a]) + at, int(s - firsts[t - a]) + at) for t, p, f, l in zip(text, place, first, last) for s in range(f, l + 1)]
            blocks += [(k, *x) for x in found]
            assert b > a
    each = [sorted(x[1:] for x in blocks if x[0] == k) for k in range(3)]
    assert each[0] == each[1] == each[2]
    assert len(each[0]) == sum(max(0, len((r[1] or "").encode()) - 49) for r in rows)  # each window has one anchor


def test_suffix_dedup_empty(spark):
    out = suffix_dedup.report(suffix_dedup.without_repeats(made(spark, [])))
    assert out.collect() == [] and out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_encoded_blocks_are_row_groups_of_their_own(spark):
    """Whatever a task writes, reading has one block in memory and not all of a file's."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from lexigrid.llm import hmm

    docs = spark.range(3).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(False).alias("held_out"), F.expr("repeat('a ', 1500000)").alias("text"))
    blocks = hmm.encode_blocks(docs)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    assert sum(m.num_rows for m in files) == sum(m.num_row_groups for m in files) == 3


def test_scoring_deals_out_the_words_of_classes_alone(spark):
    """Rows on their way through the shuffle of the scores stay small: a word with a symbol of its own isn't dealt out again."""
    from pyspark.sql import functions as F

    from lexigrid.llm import hmm

    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda k: F.concat(F.lit("w"), F.when(k % 100 == 0, F.col("id") * 10_000 + k).otherwise(k % 7).cast("string"))))
    docs = spark.range(2400).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(False).alias("held_out"), words.alias("text"))
    blocks = hmm.encode_blocks(docs)
    assert blocks.agg(F.max(F.octet_length("codes")), F.count("*")).first()[0] < 4 * 1_450_000  # 750,000 words and a slice of 2 MB
    counts = hmm.vocabulary(blocks)
    model, _ = hmm.train(blocks, counts, n_states=2, n_symbols=8, rounds=1)
    parts = hmm.part_scores(blocks, model).select("types", "rare", F.octet_length("codes").alias("bytes")).collect()
    dealt = sum(r.bytes for r in parts) // 4
    assert dealt == sum(sum(r.rare) for r in parts) and 2400 * 9 <= dealt <= 2400 * 10
    got = hmm.score(blocks, counts, model).agg(F.count("*"), F.min("n_known"), F.max("n_known"), F.sum("base_score")).first()
    total, kinds = 2400 * 1001, 7 + 2400 * 10 + 1
    frequent = [sum(1 for k in range(1, 1001) if k % 100 and k % 7 == m) * 2400 for m in range(7)]
    want = sum(n * np.log10((n + 1) / (total + kinds)) for n in frequent) + 24_000 * np.log10(2 / (total + kinds)) + 2400 * np.log10(2401 / (total + kinds))
    assert tuple(got)[:3] == (2400, 1001, 1001) and abs(got[3] / want - 1) < 1e-6


def test_segments_are_row_groups_of_their_own(spark):
    """Whatever a task writes, looking up has one segment of the index in memory and not all of a file's."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from lexigrid.llm import decontaminate

    docs = spark.range(4).coalesce(1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', id, ' '), 400000)").alias("text"))
    index = decontaminate.build_index(docs)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert sum(m.num_rows for m in files) == sum(m.num_row_groups for m in files) > 1
