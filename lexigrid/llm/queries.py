"""The queries opN_<name> over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import decontaminate, divergence, hmm, line_dedup, mixing, near_duplicates, spelling, suffix_dedup, tokens, toxicity, vector_search, warc
from lexigrid.llm.common import shared_folder, table, written

END_ID = 1
#: Outside the vocabulary, so no text can hold it.
SEPARATOR = 65535


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(line_dedup.drop_boilerplate(table(spark, sf_dir, "pages")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    # The digests are made of the payloads as they are read; the payloads themselves aren't written again.
    return warc.report(warc.transactions(written(warc.read_archives(spark, path).drop("payload"), "records")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("n_offending", F.size("sentences").cast("long"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model(table(spark, sf_dir, "documents"))


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "flat")
    tokens.write_flat(table(spark, sf_dir, "documents"), path, tokenizer_path(), SEPARATOR)
    return tokens.scan_separators(spark, path, SEPARATOR)


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.without_repeats(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_warc, op3_toxicity, op4_near_duplicates, op5_decontamination, op6_token_output, op7_hidden_markov, op8_separator_scan, op9_nearest_vectors, op10_mixing, op11_source_divergence, op12_spelling_variants, op13_suffix_dedup)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate({}, '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = r"regexp_extract_all(translate({}, '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_RUNS = r"regexp_extract_all(translate({}, '" + _UPPER + "', '" + _LOWER + "'), '[a-z\u00C0-\u00FF]+')"

ORACLE = {
    "op1_line_dedup": r"""
WITH cut AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '')) AS host,
         list_filter(list_transform(regexp_split_to_array(
           regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>', chr(10), 'g'),
             '(?i)<(/?(p|div|li|ul|ol|nav|article|section|header|footer|h[1-6]|table|tr|td|th|title|head|body|html|blockquote|pre|form|main|aside)|br)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[\n\r]+'),
           lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM cut GROUP BY host),
counts AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut) GROUP BY host, line),
often AS (SELECT host, list(line) AS bad FROM counts JOIN totals USING (host) WHERE n > 0.1 * pages GROUP BY host),
kept AS (SELECT page_id, cut.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept
         FROM cut LEFT JOIN often ON cut.host = often.host)
SELECT page_id, host, len(lines) AS n_lines, len(kept) AS n_kept, md5(coalesce(array_to_string(kept, chr(10)), '')) AS kept_md5 FROM kept""",
    "op2_warc": """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM hashed)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((((strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 AS INT) + 1, 1)) - 1) * 16
      + greatest(strpos('0123456789abcdef', substr(h || '0', CAST(5 * i // 4 AS INT) + 2, 1)) - 1, 0)) >> CAST(3 - (5 * i) % 4 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM ranked""",
    "op5_decontamination": rf"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
grams AS (
  SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, k, grams.size AS size, item_id FROM grams JOIN windows ON grams.size = windows.size AND grams.phrase = windows.phrase),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS at FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS named
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op10_mixing": r"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sizes GROUP BY source),
caps AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM totals),
levels AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM totals)::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
goal AS (SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * weight), cap) AS target FROM levels),
placed AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sizes)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - ahead)) + greatest(0, least(size, floor(target) - source_size - ahead)) AS BIGINT) AS taken
FROM placed JOIN goal ON placed.source IS NOT DISTINCT FROM goal.source""",
    "op11_source_divergence": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
terms AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
kept AS (SELECT lang, source, term, count(*) AS n FROM words JOIN terms USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(DISTINCT term) AS v, sum(n) AS all_of FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(all_of, 0) AS all_of
  FROM groups LEFT JOIN (SELECT lang, source, sum(n) AS total FROM kept GROUP BY lang, source) USING (lang, source) LEFT JOIN langs USING (lang)),
counts AS (SELECT lang, term, sum(n) AS n FROM kept GROUP BY lang, term),
shares AS (SELECT g.lang, g.source, c.term, coalesce(k.n, 0) AS n,
    CAST(1 + 1000000000::HUGEINT * (coalesce(k.n, 0) + 1) // (g.total + g.v) AS HUGEINT) AS p, CAST(1 + 1000000000::HUGEINT * (c.n + 1) // (g.all_of + g.v) AS HUGEINT) AS q
  FROM totals g JOIN counts c USING (lang) LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM every LEFT JOIN pairs USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
runs AS (SELECT doc_id, unnest({_RUNS.format("coalesce(text, '')")}) AS run FROM documents),
pairs AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195::BIGINT, CAST(ord(c) - 64 AS BIGINT)] END)) AS b FROM pairs),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
slips AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % len(run) AS INT)) || substr(run, CAST(h % len(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(len(word))) AS INT) AS k FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.k = b.k AND a.rest = b.rest AND len(a.word) = len(b.word) AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
          FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM forms UNION ALL SELECT steps.word, forms.form FROM steps JOIN forms ON steps.root = forms.word WHERE forms.form IS NOT NULL),
roots AS (SELECT steps.word, steps.root FROM steps JOIN forms ON steps.root = forms.word WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""",
    "op13_suffix_dedup": """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT r, doc_id, c, substr(h, 2 * c + 1, 2098) AS piece FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49, 1000)) AS c FROM texts)),
starts AS (SELECT r, doc_id, c + k AS k, md5(substr(piece, 2 * k + 1, 100)) AS digest
           FROM (SELECT r, doc_id, c, piece, unnest(range(least(1000, len(piece) // 2 - 49))) AS k FROM parts)),
firsts AS (SELECT digest, min(doc_id) AS least FROM starts GROUP BY digest),
windows AS (SELECT r, doc_id, k, least FROM starts JOIN firsts USING (digest)),
gone AS (SELECT r, k, k - lag(k) OVER (PARTITION BY r ORDER BY k) AS step FROM windows WHERE least < coalesce(doc_id, 9223372036854775807)),
spans AS (SELECT r, min(k) AS b, max(k) + 50 AS e FROM
  (SELECT r, k, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) AS span FROM gone) GROUP BY r, span),
pieces AS (SELECT r, b, e, substr(h, 2 * coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) + 1, 2 * (b - coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0))) AS before
           FROM spans JOIN texts USING (r)),
cut AS (SELECT r, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY b) AS head, max(e) AS last FROM pieces GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)""",
}
