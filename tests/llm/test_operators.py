"""The operators on small tables with nulls, empty texts, ties, repeated rows and extra columns, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from lexigrid.llm import decontaminate, hmm, line_dedup, mixing, near_duplicates, tokens, toxicity, vector_search, warc
from lexigrid.llm.common import find_words, shared_folder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, label string"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return WORD.findall(low(s))


@pytest.fixture(scope="module")
def rows():
    random = np.random.RandomState(3)
    pool = [f"w{i}" for i in range(60)] + ["é", "Straße", "ABC"]
    out = []
    for i in range(40):
        n = int(random.choice([0, 1, 3, 12, 60, 400]))
        out.append((i, " ".join(random.choice(pool, n)) + random.choice(["", ".", "!\n"]), "en", ["a", "b", None][i % 3], 1, "x", "y"))
    base = [f"word{k}" for k in range(100)]
    out += [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "en", "a", 1, "x", "y") for k in (3, 50, 90)]
    out += [(110, " ".join(base), "en", "b", 1, "x", "y"), (111, " ".join(base), "en", "b", 1, "x", "y"), (111, " ".join(base), "en", "b", 1, "x", "y")]
    out += [(200, None, None, None, None, None, None), (None, "lost text", "en", "a", 1, "x", "y"), (201, "", "en", "b", 0, "x", "y"), (202, "<|endoftext|> don't U.S.A. 12,5 x...y", "en", "b", 0, "x", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontamination(spark, docs, rows, empty):
    items = [(1, " ".join(words(rows[36][1])[:25]) or "w1 w2"), (2, "W3"), (3, None), (4, ""), (5, " ".join(f"word{k}" for k in range(8, 30)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, decontaminate.report(decontaminate.contamination(docs, bench)).collect()), key=repr)
    expected = []
    for doc_id, text, *_ in rows:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - 9) if v else 0):
                window = v[k : k + 10]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        names.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        expected.append((doc_id, len(w), len(hit), len(names), digest, bool(hit)))
    assert got == sorted(expected, key=repr)
    assert decontaminate.report(decontaminate.contamination(empty, bench)).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(decontaminate.contamination(docs, bench.limit(0))).collect())


def test_decontamination_in_several_passes(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(8, 60))), (2, "w3"), (3, "w4")], "item_id bigint, text string")
    one = sorted(map(tuple, decontaminate.report(decontaminate.contamination(docs, bench)).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "WINDOWS_A_PASS", 7)
    assert sorted(map(tuple, decontaminate.report(decontaminate.contamination(docs, bench)).collect()), key=repr) == one


def test_proximity(spark, docs, rows, empty):
    """Against brute force: occurrences of a word of the query with all others near it in the same text."""
    queries = [(1, "w1 w2"), (2, "word3 word7 word5"), (3, "w4"), (4, ""), (5, None), (6, "absent w1"), (7, "abc é")]
    frame = spark.createDataFrame(queries, "item_id bigint, text string")
    index = decontaminate.build_index(docs)
    for slop in (0, 2, 9):
        got = {(r.query_id, r.doc_id, r.position) for r in decontaminate.proximity(index, frame, slop).collect()}
        texts = collections.defaultdict(set)
        for doc_id, text, *_ in rows:
            texts[doc_id].add(text)
        for doc_id, (text, *_) in texts.items():
            w = words(text)
            for item in {q for q, _ in queries}:
                of = {p for q, d, p in got if (q, d) == (item, doc_id)}
                wanted = set()  # by centre: the operator takes the rarest word of a segment
                for v in (set(words(t)) for q, t in queries if q == item):
                    wanted |= {frozenset(p for p, x in enumerate(w) if x == c and v <= set(w[max(0, p - slop) : p + slop + 1])) for c in v}
                assert of in wanted or not wanted and not of
    assert decontaminate.proximity(decontaminate.build_index(empty), frame, 3).count() == 0


def test_decontamination_of_odd_tables(spark):
    """Repeated and null item ids, very long texts and items, repeated documents, columns with clashing names."""
    long = [f"x{k}" for k in range(30_000)]
    docs = [(1, " ".join(long), 1, 2), (1, " ".join(long), 1, 2), (None, "a b c d", 0, 0), (2, "d", None, None)]
    items = [(7, " ".join(long[5:5000])), (7, "d"), (None, "b c"), (8, "c"), (8, None)]
    got = decontaminate.report(decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string, segment int, terms int"), spark.createDataFrame(items, "item_id bigint, text string")))
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in got.collect()) == [("1", 30000, 4995, 1), ("1", 30000, 4995, 1), ("2", 1, 1, 1), ("None", 4, 3, 3)]


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r for r in near_duplicates.classes(docs).collect()}
    assert {got[i].class_id for i in (100, 101, 102, 103, 110, 111) if i in got} == {got[103 if 103 in got else 110].class_id}
    assert got[200].class_id is None and got[None].class_id is None
    assert got[201].class_id == min(r for r in got if r is not None and got[r].class_id == got[201].class_id)
    assert near_duplicates.classes(empty).count() == 0


def test_tiles_link_what_is_similar_and_apart():
    import pyarrow as pa

    base = [f"word{k}" for k in range(200)]
    texts = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in (0, 50, 100, 150)] + [" ".join(base[::-1]), ""]
    one = lambda k: near_duplicates._weighted(pa.array([texts[k]]), 5)[0]
    similar = {(a, b) for a in range(6) for b in range(a) if near_duplicates.probability_jaccard(one(a), one(b)) >= 0.8}
    rows = [(stray, k, k, bytes(8), texts[k]) for stray in (True, False) for k in range(6)]
    table = pa.table(dict(zip(("stray", "node", "label", "registers", "text"), map(list, zip(*rows)))))
    links = near_duplicates._tile_links(table, 5, 0.8).to_pydict()
    found = set(zip(links["a"], links["b"]))
    assert found <= similar and len(found) == len(links["a"]) == 3  # four similar texts, three links


def test_probability_jaccard_and_its_estimate():
    random = np.random.RandomState(5)
    x = {k: int(random.randint(1, 5)) for k in range(300)}
    y = {k: int(random.randint(1, 5)) for k in range(60, 360)}
    exact = sum(1 / sum(max(x.get(z, 0) / x[k], y.get(z, 0) / y[k]) for z in {*x, *y}) for k in {*x} & {*y})
    sets = [(np.array(sorted(s)), np.array([s[k] for k in sorted(s)])) for s in (x, y)]
    assert near_duplicates.probability_jaccard(*sets) == pytest.approx(exact)
    names = near_duplicates.mix64(np.concatenate([sets[0][0], sets[1][0]]).astype(np.uint64))
    found = near_duplicates.prob_minhash(np.repeat([0, 1], [300, 300]), names, np.concatenate([sets[0][1], sets[1][1]]), 2, 4096)
    assert (found[0] == found[1]).mean() == pytest.approx(exact, abs=0.035)


def test_token_output_and_flat_files(spark, docs, rows, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tool, at, expected = Tokenizer.from_file(path), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tool.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokens.token_output(docs, path)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected
    assert tokens.token_output(empty, path).count() == 0
    folder = shared_folder(spark, "flat")
    tokens.write_flat(docs, folder, path, 65535, rows_a_file=7)
    flat = tokens.scan_separators(spark, folder, 65535, block_bytes=64).collect()
    assert sorted(r.n_tokens for r in flat) == sorted(e[2] for e in expected)
    assert all(r.ended for r in flat)
    with pytest.raises(Exception, match="vocabulary"):
        tokens.write_flat(docs, shared_folder(spark, "flat"), path, 49407)


def _flat_expected(data: bytes, separator: int):
    ids = np.frombuffer(data[: len(data) // 2 * 2], "<u2").tolist()
    out, begin = [], 0
    for k, i in enumerate(ids):
        if i == separator:
            out.append((begin, k + 1 - begin, True))
            begin = k + 1
    if begin < len(ids):
        out.append((begin, len(ids) - begin, False))
    return [(doc, *x) for doc, x in enumerate(out)]


def test_separator_scan_across_splits_and_blocks(spark, tmp_path):
    """Documents, starts and order of hand-made files read in ranges of a few hundred bytes by several tasks."""
    random = np.random.RandomState(8)
    made = {}
    for k in range(6):
        ids = random.randint(0, 400, random.randint(1, 3000)).astype("<u2")
        ids[random.rand(len(ids)) < [0.02, 0.5, 0, 0.01, 0.2, 1][k]] = 65535
        made[f"f{k}.bin"] = ids.tobytes()
    made["none.bin"] = b""
    made["mark.bin"] = b"\xef\xbb\xbf\x00" + np.array([5, 65535, 10, 2570, 65535, 3], "<u2").tobytes()
    made["odd.bin"] = np.array([255, 65535, 65280, 65535, 7], "<u2").tobytes() + b"\x0a"
    made["long.bin"] = np.repeat([258, 65535, 771], [4000, 1, 2000]).astype("<u2").tobytes()
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    for key, value in {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}.items():
        spark.conf.set(key, value)
    try:
        rows = tokens.scan_separators(spark, f"file://{tmp_path}", 65535, block_bytes=100).collect()
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.file, r.doc)):
        got[r.file].append((r.doc, r.start, r.n_tokens, r.ended))
    assert got == {name: _flat_expected(data, 65535) for name, data in made.items() if data}


def test_words_of_one_pattern_hash_apart():
    """Words that a polynomial hash modulo 2**64 can't tell apart, and pieces that share a hash, get their own ids."""
    import pyarrow as pa

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    swap, word = str.maketrans("ab", "ba"), "a"
    for _ in range(11):
        word += word.translate(swap)
    pair = [word, word.translate(swap)]
    assert len({*find_words(pa.array(pair)).hashes.tolist()}) == 2
    odd = "İstanbul ﬁne ǅ 漢字。カナ ẞtraße x\u0301y é e\u0301 ａｂ Ⅷ ª ʼn aʼb اللغة हिन्दी don't we'll"
    texts = pa.array([*pair, f"{pair[1]} tail", "abcdefgh abcdefgi", None, odd, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(700)) + odd])
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    ids, ends = tokens.Encoder(path).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_pieces_that_share_a_hash_are_compared(monkeypatch):
    import pyarrow as pa

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    monkeypatch.setattr("lexigrid.llm.common.mix64", lambda x: x & np.uint64(0))
    texts = pa.array(["international internationals interoperability", "interoperability", "internationals internationals"])
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts.to_pylist(), add_special_tokens=False)]
    ids, ends = tokens.Encoder(path).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_token_files_have_their_layout_and_are_read_in_part(spark, tmp_path):
    import pyarrow.parquet as pq

    public = pytest.importorskip("public_tokenizers")
    path, folder = public.path("word_bpe_49k.json"), f"file://{tmp_path}/tokens"
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id, repeat(' word', int(id % 50))) AS text").unionByName(spark.sql("SELECT bigint(7) AS doc_id, 'other' AS text"))
    tokens.write_token_table(docs, folder, path, 1, row_group_bytes=20_000, page_rows=100)
    files = sorted((tmp_path / "tokens").glob("part-*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in files for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > len(files)
    for g in groups:
        kinds = {g.column(c).path_in_schema: set(g.column(c).encodings) for c in range(g.num_columns)}
        assert "DELTA_BINARY_PACKED" in kinds["doc_id"] and "DELTA_BINARY_PACKED" in kinds["n_tokens"]
        assert kinds["ids.list.element"] & {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"}
        assert all(g.column(c).has_column_index and g.column(c).has_offset_index for c in range(g.num_columns))
    lows = [(g.column(0).statistics.min, g.column(0).statistics.max) for g in groups]
    assert all(a[1] <= b[0] for a, b in zip(lows, lows[1:]))
    some = tokens.read_documents(spark, folder, 5, 9)
    assert sorted(r.doc_id for r in some.collect()) == [5, 6, 7, 7, 8, 9]
    assert "GreaterThanOrEqual(doc_id,5)" in some._jdf.queryExecution().toString()
    everything = [r for r in tokens.digests_of(spark, folder).orderBy("start").collect()]
    flat = [i for r in tokens.read_token_table(spark, folder).orderBy("file", "row").collect() for i in r.ids]
    assert everything[-1].start + everything[-1].n_tokens == len(flat)
    part = tokens.read_tokens(spark, folder, 1000, 1500).orderBy("start").collect()
    assert [i for r in part for i in r.ids] == flat[1000:1500] and part[0].start == 1000
    again = f"file://{tmp_path}/again"
    tokens.write_token_table(docs.repartition(3), again, path, 1)
    assert [i for r in tokens.read_token_table(spark, again).orderBy("file", "row").collect() for i in r.ids] == flat


def test_hidden_markov_forward_and_base(docs, rows, empty):
    random = np.random.RandomState(1)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(norm(random.rand(3)), norm(random.rand(3, 3)), norm(random.rand(3, 7)).T, np.zeros(0, np.uint64), np.ones(1), 1, 1, 1)
    symbols, lengths = random.randint(0, 7, 30), np.array([5, 1, 20, 4])
    expected, at = [], 0
    for n in lengths:
        a = model.first * model.emit[symbols[at]]
        for s in symbols[at + 1 : at + n]:
            a = (a @ model.steps) * model.emit[s]
        expected.append(np.log(a.sum()))
        at += n
    assert hmm.forward(model, symbols, lengths) == pytest.approx(expected)
    train = [low(t or "").split() for i, t, *_ in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    counts = collections.Counter(w for t in train for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    got = collections.Counter()
    for r in hmm.language_model(docs, rounds=2, n_symbols=32).collect():
        assert r.train_tokens == n and np.isfinite(r.score) and r.score < 0
        got[r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)] += 1
    want = collections.Counter()
    for i, t, *_ in rows:
        w = [*low(t or "").split(), None]
        want[i, len(w), sum(counts[x] > 0 for x in w), round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert got == want
    assert hmm.language_model(empty).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 4, 128])
def test_expected_counts_are_those_of_whole_documents(monkeypatch, piece):
    """Against sums over all paths of states, by forward and backward probabilities without scaling."""
    monkeypatch.setattr(hmm, "PIECE", piece)
    random = np.random.RandomState(9)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(norm(random.rand(3)), norm(random.rand(3, 3)), norm(random.rand(3, 5)).T, np.zeros(0, np.uint64), np.ones(1), 1, 1, 1)
    lengths = np.array([1, 9, 4, 12, 3, 1, 7])
    symbols = random.randint(0, 5, lengths.sum())
    emissions, transitions, first, likelihood = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3), 0.0
    for end, n in zip(np.cumsum(lengths), lengths):
        o = symbols[end - n : end]
        f = [model.first * model.emit[o[0]]]
        for x in o[1:]:
            f.append((f[-1] @ model.steps) * model.emit[x])
        b = [np.ones(3)]
        for x in o[:0:-1]:
            b.insert(0, model.steps @ (model.emit[x] * b[0]))
        p = f[-1].sum()
        likelihood += np.log(p)
        first += f[0] * b[0] / p
        for t in range(n):
            emissions[o[t]] += f[t] * b[t] / p
            if t:
                transitions += np.outer(f[t - 1], model.emit[o[t]] * b[t]) * model.steps / p
    got = hmm.expected_counts(model, symbols, lengths)
    assert got[0] == pytest.approx(emissions) and got[1] == pytest.approx(transitions) and got[2] == pytest.approx(first)
    assert got[3] == pytest.approx([likelihood, len(symbols)])


def test_long_documents_keep_their_scale():
    random = np.random.RandomState(10)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(norm(random.rand(4)), norm(random.rand(4, 4)), norm(random.rand(4, 3000)).T, np.zeros(0, np.uint64), np.ones(1), 1, 1, 1)
    symbols, lengths = random.randint(0, 3000, 60_010), np.array([60_000, 10])
    emissions, transitions, first, total = hmm.expected_counts(model, symbols, lengths)
    assert emissions.sum() == pytest.approx(60_010) and transitions.sum() == pytest.approx(60_008) and first.sum() == pytest.approx(2)
    assert total[0] == pytest.approx(hmm.forward(model, symbols, lengths).sum())


def test_held_out_score_beats_the_base(spark):
    got = hmm.language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b", "count(*) AS n").first()
    assert got.n > 50 and got.s > got.b


def test_language_model_of_a_hot_word_and_odd_texts(spark):
    rows = [(1, "the " * 50_000), (2, None), (3, ""), (3, ""), (None, "the end"), *[(k, "the the cat") for k in range(10, 40)]]
    got = hmm.language_model(spark.createDataFrame(rows, "doc_id bigint, text string"), rounds=1).collect()
    assert len(got) == len(rows) and all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_baum_welch_raises_the_likelihood(docs):
    blocks = hmm.encode_blocks(docs.selectExpr("doc_id", "false AS held_out", "text"))
    history = hmm.train(blocks, hmm.vocabulary(blocks), n_states=3, n_symbols=64, rounds=4)[1]
    assert history == sorted(history)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for r in got:
        assert taken[r.source] == int(r.target) and r.target <= 2 * r.source_size
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert mixing.mix(empty).count() == 0


def test_mixing_over_several_levels(docs, monkeypatch):
    one = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 0.0001)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == one


def test_toxicity(spark, empty):
    random = np.random.RandomState(2)
    plain = [f"plain{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(random.choice(plain, 8)) for _ in range(random.randint(1, 6))]
        bad = i % 4 == 0
        if bad:
            sentences[random.randint(len(sentences))] += " nasty"
        rows.append((i, ". ".join(sentences), 0))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None, 0), (1001, "", 0)], "doc_id bigint, text string, score int")
    known = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, known).collect()}
    assert got[1000].score == got[1001].score == 0
    assert np.mean([got[i].predicted == y for i, y in labels if got[i].held_out]) > 0.97
    spot = next(r for r in got.values() if r.predicted and r.held_out)
    assert any("nasty" in rows[spot.doc_id][1].encode()[s.begin : s.end].decode() for s in spot.sentences)
    assert toxicity.scored(empty, known.limit(0)).count() == 0


def test_toxicity_sample_is_bounded_in_rows(spark):
    rows = [(7, f"text {k}") for k in range(300)] + [(k, f"plain {k}") for k in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([(7, 1), *[(k, 0) for k in range(20, 30)]], "doc_id bigint, toxic int")
    got = toxicity.sample(docs, known, 2, 2).collect()
    assert sorted(r.toxic for r in got) == [0, 0, 1] and len({r.doc_id for r in got}) == 3
    again = toxicity.sample(docs.repartition(5), known, 2, 2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_toxicity_scores_are_the_noisy_or_of_sentences(spark):
    """Scores and sentences against a word-by-word version with the fitted weights."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["Bad thing here. Good day!", "good", "", None, "bad\nbad. thing", "x. " * 40 + "Bad"])], "doc_id bigint, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id bigint, toxic int")
    weights = toxicity.fit(docs, known, least_texts=1, least_z=0.0, rounds=30)
    features = lambda word: [int(x) for x in toxicity._features(find_words(__import__("pyarrow").array([word])))[0]]
    for r in toxicity.score(docs, weights, offending=0.3).collect():
        text = docs.filter(docs.doc_id == r.doc_id).first().text or ""
        clean, bad = 1.0, 0
        for sentence in re.split(r"[.!?\n\r]", text):
            if words(sentence):
                logit = sum(float(weights.values[f]) for w in words(sentence) for f in features(w)) + weights.bias
                p = 1 / (1 + np.exp(-logit))
                clean *= 1 - p
                bad += p >= 0.3
        assert r.score == pytest.approx(1 - clean, abs=1e-6) and len(r.sentences) == bad


def test_toxicity_gradient_is_that_of_finite_differences():
    random = np.random.RandomState(3)
    counts = random.randint(1, 5, 20)
    rows, columns = random.randint(0, counts.sum(), 200), random.randint(0, 9, 200)
    label, importance = random.rand(20) < 0.4, random.rand(20) + 0.5
    weight, bias, e = random.standard_normal(9), -0.7, 1e-6
    value = lambda w, b: toxicity.likelihood(w, b, columns, rows, counts, label, importance)[0]
    _, gradient, slope = toxicity.likelihood(weight, bias, columns, rows, counts, label, importance)
    for k in range(9):
        move = np.eye(9)[k] * e
        assert (value(weight + move, bias) - value(weight - move, bias)) / (2 * e) == pytest.approx(gradient[k], rel=1e-4, abs=1e-8)
    assert (value(weight, bias + e) - value(weight, bias - e)) / (2 * e) == pytest.approx(slope, rel=1e-4)


def test_toxicity_of_one_kind_of_label_and_wide_stops(spark):
    import pyarrow as pa

    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c. " * 30_000), (3, None)], "doc_id bigint, text string")
    for kind in (0, 1):
        known = spark.createDataFrame([(1, kind), (2, kind)], "doc_id bigint, toxic int")
        got = [r.score for r in toxicity.scored(docs, known).orderBy("doc_id").collect()]
        assert all(0 <= x <= 1 for x in got) and got[-1] == 0 and got[0] == got[1]
        assert (got[0] > 0.5) == bool(kind)
    words, head = toxicity._sentences(pa.array(["你好。再见！吗？end", "one"]))
    assert [words.raw[words.starts[k] : words.ends[k]].tobytes().decode() for k in head] == ["你好", "再见", "吗", "end", "one"]


def test_vector_search(spark):
    random = np.random.RandomState(4)
    data = np.concatenate([random.normal(size=(300, 16)), np.ones((40, 16))]).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(data)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in vector_search.search(df, lambda c: c % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = total = 0
    for q in range(0, 340, 20):
        far = np.sqrt(((data.astype(float) - data[q].astype(float)) ** 2).sum(axis=1))
        far[q] = np.inf
        hits += len(set(got[q]) & set(np.lexsort((np.arange(340), far))[:10].tolist()))
        total += 10
    assert got[320] == [i for i in range(300, 311) if i != 320][:10]
    assert set(got) == set(range(0, 340, 20)) and hits / total >= 0.9
    assert vector_search.search(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "https://a.example/x", "<p>WARC/1.1\r\n\r\nü</p>"), (2, None, None), (3, "https://a.example/y", "same"), (9, "https://a.example/z", "same"), (10, "u", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = shared_folder(spark, "warc")
    warc.write_archives(pages, path)
    captures = warc.transactions(warc.read_archives(spark, path))
    got = {r.page_id: r for r in warc.report(captures).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 10), 3: ("revisit", 9), 9: ("response", None), 10: ("response", None)}
    assert all(got[i].payload_digest == warc.digest32((h or "").encode()) and got[i].payload_bytes == len((h or "").encode()) for i, _, h in rows)
    assert all(r.request is not None and r.metadata is not None for r in captures.collect())


def test_warc_repeated_and_null_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (4, "u", "a"), (4, "v", "a"), (4, "u", "c"), *[(None, "u", t) for t in ("a", "a", "d", None)]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    path = shared_folder(spark, "warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    captures = warc.transactions(records)
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(captures).collect()), key=repr)
    old = lambda i, t: i == 1 and t == "a"
    assert got == sorted(((i, warc.digest32((t or "").encode()), "revisit" if old(i, t) else "response", 4 if old(i, t) else None) for i, _, t in rows), key=repr)
    names = [r.record_id for r in records.collect()]
    assert len(set(names)) == len(names) == 3 * len(rows)
    assert all(r.request is not None and r.metadata is not None for r in captures.collect())
    main = {r.record_id: r.response for r in captures.collect()}
    assert all(main[x.refers_to].type == "response" and main[x.refers_to].payload_digest == x.payload_digest for x in main.values() if x.refers_to)


def test_warc_archives_of_other_writers(spark, tmp_path):
    """Several members, several records in one, plain files, other kinds, either direction, folded and repeated fields."""
    import gzip

    def record(kind, name, body, *fields):
        head = "".join(f"{f}\r\n" for f in (f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", "WARC-Date: 2020-01-01T00:00:00Z", *fields, f"Content-Length: {len(body)}"))
        return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    body = bytes(range(256)) * 5000 + b"WARC/1.0\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    one = record("response", "a", http + body, "WARC-Target-URI: http://a.example/", "WARC-Concurrent-To: <urn:ask-a>", "WARC-Concurrent-To: <urn:meta-a>")
    asks = record("request", "ask-a", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://a.example/")
    metas = record("metadata", "meta-a", b"via: x\r\n") + record("metadata", "meta-b", b"n: 2\r\n", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To:\r\n <urn:b>")
    two = record("revisit", "b", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", "WARC-Payload-Digest: sha1:ABC", "WARC-Refers-To: <urn:a>") + record("revisit", "c", b"")
    odd = record("strange", "s", b"?") + record("conversion", "t", b"") + record("response", "e", b"no head at all", "WARC-Payload-Digest: sha1:AAAA")
    (tmp_path / "many.warc.gz").write_bytes(b"".join(map(gzip.compress, (info, one, asks))) + gzip.compress(metas + two) + bytes(4))
    (tmp_path / "plain.warc").write_bytes(info + odd)
    (tmp_path / "empty.warc").write_bytes(b"")
    records = warc.read_archives(spark, f"file://{tmp_path}")
    assert collections.Counter(r.type for r in records.collect()) == {"warcinfo": 2, "response": 2, "request": 1, "metadata": 2, "revisit": 2, "strange": 1, "conversion": 1}
    got = {r.record_id: r for r in warc.transactions(records).collect()}
    assert set(got) == {"urn:a", "urn:b", "urn:c", "urn:e"}
    a, b = got["urn:a"], got["urn:b"]
    assert bytes(a.response.payload) == body and a.response.n_bytes == len(body) and a.response.verified is None
    assert a.request.part_id == "urn:ask-a" and a.metadata.part_id == "urn:meta-a" and (a.n_request, a.n_metadata) == (1, 2)
    assert b.response.n_bytes == 77 and b.response.payload_digest == "ABC" and b.metadata.part_id == "urn:meta-b" and b.request is None
    assert got["urn:c"].response.n_bytes is None and got["urn:e"].response.verified is False and got["urn:e"].response.n_bytes == 0
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.warc.gz").write_bytes(gzip.compress(one)[:-20])
    with pytest.raises(Exception, match="cut off|inside a record"):
        warc.read_archives(spark, f"file://{tmp_path}/cut").collect()


def test_warc_members_are_records_of_any_size(spark):
    import gzip

    rows = [(1, "http://a.example/", "x" * (17 << 20)), (2, "http://a.example/", "y"), (3, None, "\x00\x1f\x8b")]
    path = shared_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    files = [f for f in spark.read.format("binaryFile").load(path).collect() if f.length]
    assert sum(gzip.decompress(bytes(f.content)).count(b"WARC/1.1\r\n") for f in files) == 9
    assert sum(bytes(f.content).count(b"\x1f\x8b\x08") for f in files) >= 9
    got = {r.page_id: r for r in warc.report(warc.transactions(warc.read_archives(spark, path))).collect()}
    assert {k: r.payload_bytes for k, r in got.items()} == {1: 17 << 20, 2: 1, 3: 4}


def test_warc_empty(spark):
    path = shared_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.report(warc.transactions(warc.read_archives(spark, path))).count() == 0


def test_line_dedup(spark):
    page = lambda k: f"<div>Menu</div><p>Text {k}</p><script>x</script><p>Text {k}</p>"
    rows = [(k, "https://Site.example/p", page(k)) for k in range(5)] + [(7, None, None), (8, "https://other.example/", "<p>Menu</p>")]
    out = {r.page_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id bigint, url string, html string"), least_pages=3).collect()}
    assert all(out[k].kept == [f"Text {k}", f"Text {k}"] and out[k].host == "site.example" for k in range(5))
    assert out[7].kept == [] and out[8].kept == ["Menu"]


def test_line_dedup_edges(spark):
    """A share exactly at the ratio stays, repeated rows are pages, long texts and a hot host work, and empty tables too."""
    schema = "page_id bigint, url string, html string, lines string, names string"
    at = [(k, "http://a.example/", "<p>often</p>" if k < 4 else "<p>x</p>", "", "") for k in range(40)]
    over = [(100 + k, "http://b.example/", "<p>often</p>" if k < 5 else "<p>y" + str(k), "", "") for k in range(40)]
    hot = [(1000, "http://hot.example/", f"<p>menu</p><p>own {k % 500}</p>", "", "") for k in range(2000)]
    long = [(5000, None, "<li>" + "word " * 200_000 + "</li>" * 3, None, None)] * 2
    df = spark.createDataFrame(at + over + hot + long, schema).repartition(7)
    out = line_dedup.drop_boilerplate(df, least_pages=3).collect()
    assert len(out) == len(at) + len(over) + len(hot) + 2
    kept = collections.Counter((r.host, r.page_id == 1000, tuple(r.kept)[:1] if r.page_id != 5000 else len(r.kept)) for r in out)
    assert kept["a.example", False, ("often",)] == 4 and kept["b.example", False, ()] == 5
    assert all(r.kept == [x for x in r.lines if x != "menu"] for r in out if r.host == "hot.example")
    assert kept["", False, 1] == 2
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_line_dedup_goes_by_the_ratio_alone(spark):
    """Without least_pages a line goes above the ratio, however few pages a site has; hosts are those of the urls."""
    urls = ["http://u:p@Site.org:80/x", "https://site.org/y?a=b@c", "http://site.org", "http://[2001:DB8::1]:8080/", "http://x@[2001:db8::1]/", "site.org/no-scheme", "http:///", None]
    rows = [(k, u, f"<p>all</p><p>own {k}</p>") for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert [r.host for r in df.select(line_dedup.host(df.url).alias("host")).collect()] == ["site.org"] * 3 + ["[2001:db8::1]"] * 2 + [""] * 3
    kept = {r.page_id: r.kept for r in line_dedup.drop_boilerplate(df, ratio=0.4).collect()}
    assert kept == {0: ["own 0"], 1: ["own 1"], 2: ["own 2"], 3: [], 4: [], 5: ["own 5"], 6: ["own 6"], 7: ["own 7"]}
    assert all(r.kept == [] for r in line_dedup.drop_boilerplate(df).collect())


def test_near_duplicate_classes_are_components_of_all_similar_pairs(spark):
    """No link too many: over the whole documents table every class holds together by similar pairs of its own, found by brute force
    over its members. Nor one too few within a bucket, whatever the registers say (see the tile's test)."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    members = collections.defaultdict(list)
    for r in near_duplicates.classes(docs).collect():
        members[r.class_id].append(r.doc_id)
    weighed = lambda k: near_duplicates._weighted(pa.array([text[k]], pa.string()), 5)[0]
    several = {c: m for c, m in members.items() if c is not None and len(m) > 1}
    assert len(several) > 10
    for m in several.values():
        sets = {k: weighed(k) for k in m}
        same = lambda a, b: text[a] == text[b] or near_duplicates.probability_jaccard(sets[a], sets[b]) >= 0.8
        reached, ahead = {m[0]}, [m[0]]
        while ahead:
            a = ahead.pop()
            new = [b for b in m if b not in reached and same(a, b)]
            reached.update(new)
            ahead += new
        assert reached == set(m)


def test_shared_share_is_an_upper_bound():
    random = np.random.RandomState(5)
    sets = []
    for _ in range(40):
        shingles = np.unique(random.randint(0, 60, 30).astype(np.uint64))
        sets.append((shingles, random.randint(1, 5, len(shingles))))
    parts = [(s, w / w.sum(), np.full(len(s), k)) for k, (s, w) in enumerate(sets)]
    index = [np.concatenate(x) for x in zip(*parts)]
    order = np.argsort(index[0], kind="stable")
    index = tuple(x[order] for x in index)
    for x in sets:
        bound = near_duplicates.shared_share(x, index, len(sets))
        assert all(near_duplicates.probability_jaccard(x, y) <= b + 1e-9 for y, b in zip(sets, bound))


def test_near_duplicates_find_all_similar_pairs(spark):
    """Against all pairs that share a shingle, of the whole documents table: nine of ten similar pairs share a class."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.text is not None]
    found = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}
    sets = near_duplicates._weighted(pa.array([t for _, t in rows]), 5)
    by_shingle = collections.defaultdict(list)
    for k, (x, _) in enumerate(sets):
        for z in x.tolist():
            by_shingle[z].append(k)
    pairs = {(a, b) for at in by_shingle.values() if len(at) < 200 for a in at for b in at if a < b}
    alike = [(rows[a][0], rows[b][0]) for a, b in pairs if near_duplicates.probability_jaccard(sets[a], sets[b]) >= 0.8]
    assert len(alike) > 50
    assert np.mean([found[a] == found[b] for a, b in alike]) >= 0.9


def test_near_duplicates_of_a_hot_bucket(spark):
    """Very many near copies of one text, copies of another, and very long texts."""
    base = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(base + [f"end{k}"])) for k in range(900)] + [(2000 + k, "same words here for all of us") for k in range(900)]
    rows += [(5000 + k, " ".join(f"long{i}" for i in range(k, 60_000 + k))) for k in range(3)]
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert {got[k] for k in range(900)} == {0} and {got[2000 + k] for k in range(900)} == {2000} and {got[5000 + k] for k in range(3)} == {5000}


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "decontamination", "mixing", "token ids"]
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        after = [r.doc_id for r in out.select("doc_id").collect()]
        assert after and set(after) <= before
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count()


def test_pipeline_decides_rows_by_their_own_text(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    leak, base = " ".join(f"leak{k}" for k in range(12)), [f"word{k}" for k in range(100)]
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = lambda k: " ".join(f"t{k}x{n}" for n in range(30))
    rows = [(None, f"so {leak} on"), (None, clean(0)), (None, clean(1)), (7, f"{leak} too"), (7, clean(2)), (7, clean(3)), (8, clean(4)), (9, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = pipeline.contaminated_out(spark, docs, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((r for r in rows if leak not in (r[1] or "")), key=repr)
    near = lambda k: " ".join(base[:k] + ["changed"] + base[k + 1 :])
    # Texts of one id apart from one another stay; of similar ones the smallest id stays, null last, whatever the id's other texts.
    rows = [(5, clean(0)), (5, near(3)), (5, clean(1)), (4, near(50)), (None, near(90)), (None, clean(2)), (None, clean(2)), (None, clean(3)), (5, clean(1)), (6, None), (None, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = pipeline.near_duplicates_out(spark, docs, str(tmp_path))
    want = [(5, clean(0)), (5, clean(1)), (4, near(50)), (None, clean(2)), (None, clean(3)), (6, None), (None, None), (6, None)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_near_duplicates_of_each_text_of_a_repeated_id(spark):
    texts = [[" ".join(f"{c}{k}" if k != j else "new" for k in range(100)) for j in (3, 50)] for c in "abc"]
    rows = [(50, t[0]) for t in texts] + [(10 + k, t[1]) for k, t in enumerate(texts)] + [(70, "alone"), (70, "alone"), (71, "ALONE.")]
    got = {tuple(r) for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == {(50, 10), (10, 10), (11, 10), (12, 10), (70, 70), (71, 70)}


def test_mix_of_repeated_and_null_ids_stays_in_its_budget(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(None if k % 3 else 5, " ".join(["x"] * (20 + k % 7)), source) for source in ("a", "b", "c") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    goal = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    words_of, copies = collections.Counter(), collections.Counter()
    for r in pipeline.mixed(spark, docs, "").collect():
        words_of[r.source] += len(r.text.split())
        copies[tuple(r)] += 1
    assert {s: int(t) <= words_of[s] < int(t) + 26 for s, t in goal.items()} == dict.fromkeys("abc", True)
    assert set(copies) <= set(rows)


def test_mix_of_very_many_alike_rows(spark):
    """A third of all rows without id, and repeated ids of several sizes, against a sequential version."""
    rows = [(None, "x " * 3, "a")] * 20_600 + [(k % 40, "y " * (1 + k % 5), "ab"[k % 2]) for k in range(900)] + [(k, None, None) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    sizes = collections.defaultdict(list)
    for i, t, source in rows:
        sizes[source].append((hashlib.md5(f"{mixing.SEED}{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, len((t or "").split())))
    want = collections.Counter()
    goal = {r.source: (int(r.target), r.source_size) for r in got}
    for source, listed in sizes.items():
        before = 0
        for _, i, size in sorted(listed):
            want[source, i, size, sum(max(0, min(size, goal[source][0] - e * goal[source][1] - before)) for e in range(2))] += 1
            before += size
    assert collections.Counter((r.source, -1 if r.doc_id is None else r.doc_id, r.size, r.taken) for r in got) == want


def test_tasks_that_run_again_give_the_same_sums(docs):
    blocks = hmm.encode_blocks(docs.selectExpr("doc_id", "false AS held_out", "text"))
    model = hmm.train(blocks, hmm.vocabulary(blocks), n_states=2, n_symbols=16, rounds=0)[0]
    one, two = (sorted(map(tuple, hmm._task_sums(blocks, model).collect())) for _ in range(2))
    assert one and one == two


@pytest.mark.parametrize("n", [2, 8, 12, 15])
def test_vector_search_of_few(spark, n):
    data = np.random.RandomState(n).normal(size=(n, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in vector_search.search(df, lambda c: c >= 0).collect()}
    far = np.sqrt(((data[:, None] - data) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    if n <= 11:
        assert got == {(q, k + 1): i for q in range(n) for k, i in enumerate(far[q].argsort()[: n - 1].tolist())}
    assert len(got) == n * min(10, n - 1)


def test_vector_search_of_copies(spark):
    random = np.random.RandomState(6)
    data = [*([[1.0] * 16] * 1500), *random.normal(size=(9, 16)).tolist()]
    df = spark.createDataFrame(list(enumerate(data)), "vec_id bigint, embedding array<double>")
    got = collections.Counter(r.query_id for r in vector_search.search(df, lambda c: (c % 300 == 0) | (c >= 1500)).collect())
    assert got == dict.fromkeys([0, 300, 600, 900, 1200, *range(1500, 1509)], 10)


def test_vector_search_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, data = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = collections.defaultdict(set)
    for r in vector_search.search(df, lambda c: c % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, far))[:10]].tolist()))
        total += 10
    print("recall", hits / total)
    assert total > 0 and hits / total >= 0.9


def test_vector_search_of_repeated_ids(spark):
    """Another row with the query's id is a candidate, and each row of a repeated query id is a query."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [5.0, 5.0]), (1, [5.0, 5.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in vector_search.search(df, lambda c: c == 0, k=2).collect())
    assert got == [(0, 1, 0, 0.1), (0, 1, 0, 0.1), (0, 2, 2, 1.0), (0, 2, 2, round(1.01**0.5, 6))]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_warc", "op5_decontamination", "op10_mixing"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from lexigrid.llm import queries

    con, data = duckdb.connect(), "/root/testdata/sf0.001"
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    plain = lambda v: float(f"{v:.8g}") if isinstance(v, float) else v
    cursor = con.execute(queries.ORACLE[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[at[c]]) for c in columns]) for r in cursor.fetchall())


def test_scratch_deletes_what_is_not_kept(spark):
    from lexigrid.llm.common import scratch, written

    one = spark.range(5)
    with scratch(spark):
        outer = written(one, "outer")
        with scratch(spark):
            gone, stays = written(one, "gone"), written(one, "stays", keep=True)
        assert stays.count() == outer.count() == 5
        with pytest.raises(Exception):
            gone.count()
    for df in (outer, stays):
        with pytest.raises(Exception):
            df.count()


def test_scratch_blocks_of_threads_are_their_own(spark):
    import threading

    from lexigrid.llm.common import scratch, written

    made = []
    with scratch(spark):
        other = threading.Thread(target=lambda: made.append(written(spark.range(3), "other")))
        other.start()
        other.join()
    assert made[0].count() == 3  # the block of this thread leaves it alone


def test_pipeline_of_clashing_columns(spark, tmp_path):
    """Columns named as the stages' own stay as they are."""
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["row_key", "row", "copies", "copy", "last", "most", "mixed_source", "class_id", "kept", "n", "node", "label", "salt", "place", "predicted", "held_out", "score", "count(*)", "a b"]
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(40)), "en", "ab"[k % 2], 1, *(f"{c}{k}" for c in names)) for k in range(30)]
    columns = ["doc_id", "text", "lang", "source", "n_chars", *names]
    docs = spark.createDataFrame(rows, columns)
    spark.createDataFrame([(k, 1, int(k > 27)) for k in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"w3x{j}" for j in range(12)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        assert {tuple(r) for r in docs.collect()} <= set(rows)
    assert 0 < pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_pipeline_runs_whole(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    data = "/root/testdata/sf0.001"
    out = pipeline.run(spark, data)
    assert out.count() > 0 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_flat_files_of_empty_tables_and_texts(spark, empty):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    folder = shared_folder(spark, "flat")
    tokens.write_flat(empty, folder, path, 65535)
    assert tokens.scan_separators(spark, folder, 65535).count() == 0
    folder = shared_folder(spark, "flat")
    tokens.write_flat(spark.createDataFrame([(1, ""), (2, None), (3, "")], "doc_id bigint, text string").coalesce(1), folder, path, 65535)
    assert sorted((r.doc, r.start, r.n_tokens, r.ended) for r in tokens.scan_separators(spark, folder, 65535).collect()) == [(k, k, 1, True) for k in range(3)]
    for odd in (10, 2570, -1, 1 << 16):
        with pytest.raises(ValueError):
            tokens.scan_separators(spark, folder, odd)


def test_pipeline_of_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    tables = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_nearest_vectors_of_other_lengths_and_clashing_names(spark):
    rows = [(k, [float(k), 1.0, 0.0], 5, "q") for k in range(20)] + [(100, [1.0, 2.0], 5, "q"), (200, [1.0] * 9, 5, "q"), (300, [None, 1.0, 1.0], 5, "q")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, list int, limit string")
    got = {(r.query_id, r.rank): r.vec_id for r in vector_search.search(df, lambda c: c % 100 == 0, k=2).collect()}
    assert got == {(0, 1): 1, (0, 2): 2}
