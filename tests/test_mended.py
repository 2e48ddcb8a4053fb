"""Operators on the odd input that they once got wrong."""

import json
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from lexigrid.functions import text as fn
from lexigrid.operators import accounts, aggregation, comparison, completions, distances, variants
from lexigrid.sources import tables

ODD = ["a\nb", " x ", "", None, 'say "hi", \\ and ,', "line\r\nend\\", "\ttab", "é漢", '"', "a\rb"]


def test_csv_round_trip(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "id int, t string")
    for bom in (False, True):
        path = tables.export(rows, "csv", bom=bom)
        assert sorted(map(tuple, tables.csv_rows(spark, path, rows.schema).collect())) == list(enumerate(ODD))
    assert sorted(map(tuple, variants.round_trip(rows, "json").collect())) == list(enumerate(ODD))


def test_redacted(spark):
    texts = [
        '{"k":"a\\"secret"}', '{"K": -12, "b": 1}', '{"a": {"k": [1, {"x": "secret"}]}, "k": true}', '[{"k": null}, {"other": "k"}]', '{"\\u006b": "secret"}',
        '{"a": 1}', None, "", 'not json, k: secret', "{" * 50 + "k", '{"k.x": 1, "é": "' + "é" * 40 + '"}',
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(fn.redacted(F.col("t"), ["k"], 60)).collect()]
    assert got[:4] == ['{"k": "***"}', '{"K": "***", "b": 1}', '{"a": {"k": "***"}, "k": "***"}', '[{"k": "***"}, {"other": "k"}]']
    assert got[4:8] == ['{"k": "***"}', '{"a": 1}', None, ""]
    assert got[8] == got[9] == "***" and all("secret" not in (t or "") for t in got)
    assert len(got[10].encode()) <= 62 and got[10].startswith('{"k.x": 1, "é"')


def test_nested_tree_keys(spark):
    names = ["x]:y", 'q"t', "a:[b", "\\", "plain"]
    rows = spark.createDataFrame([("top", n, m, "leaf") for n in names for m in names], "a string, b string, c string, d string")
    tree = json.loads(completions.nested_tree(rows, ["a", "b", "c", "d"]).first().tree)
    assert tree == {n: {m: ["leaf"] for m in names} for n in names}


def test_change_history_over_nulls(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("k", 3, "a"), ("k", 4, "b"), ("n", 1, None)], "key string, at int, v string")
    assert [tuple(r) for r in completions.change_history(rows, "key", ["at"], "v", 5).collect()] == [("k", 1, "a,b")]


def test_limits_at_the_edge_of_a_window(spark):
    """As in the SQL, a time counts for its nearest second; a half goes to the even one."""
    times = [datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 23, 59, 59, 400_000), datetime(2024, 1, 1, 23, 59, 59, 600_000), datetime(2024, 1, 2, 0, 0, 0, 100_000)]
    rows = spark.createDataFrame([(k, "u", t) for k, t in enumerate(times)], "id int, user string, at timestamp_ntz")
    got = {r.id: r.limited for r in accounts.within_limits(rows, ["id"], 86400, "at", {"user": 1}).collect()}
    assert got == {0: None, 1: "user", 2: None, 3: "user"}


def test_ranking_adds_up_once(spark):
    """Values that differ each time they are read, as sums of doubles do in their last digits: no key gets lost."""
    value = F.udf(lambda: float(uuid.uuid4().int % 1_000_003), "double").asNondeterministic()
    rows = spark.range(40).select((F.col("id") % 8).alias("key"), F.col("id").alias("user"), value().alias("value"))
    ranked = aggregation.ranking(rows, "key", "value", "user").collect()
    assert sorted(r.key for r in ranked) == list(range(8)) and sorted(r["rank"] for r in ranked) == list(range(1, 9))
    assert variants.ranked_positive(rows, "key", "value").count() == 8


def test_ngram_counts(spark):
    """Pieces, odd characters, keys and lengths count as one row for each occurrence does; a piece's rows are combined in its task."""
    texts = ["a b\tc\u00a0d", "", None, "x", "\U0001f600é\U0001f600é", "漢字漢字", "a\0b\0", "\x0b\x0c\r\n", "abab" * 300_000]
    rows = spark.createDataFrame([(k, t) for k in ("p", None, "q") for t in texts], "key string, text string").coalesce(1)
    for n in (1, 2, 3, 5):
        got = sorted(map(repr, comparison.ngram_counts(rows, "key", "text", n).collect()))
        assert got == sorted(map(repr, comparison.ngrams(rows, "key", "text", n).groupBy("key", "ngram").agg(F.count("*").alias("n")).collect()))
    assert comparison.ngram_counts(rows.filter("text = ''"), "key", "text", 2).count() == 0
    assert comparison.ngram_counts(rows.limit(0), "key", "text", 2).count() == 0


def test_positive_pmi_partitions(spark, monkeypatch):
    """Pairs are dealt out by their number, as far as their keys allow, and the result is the same."""
    rows = [(h if h < 60 else None, (h * 7 + k * k) % 23 if k < 9 else None) for h in range(61) for k in range(10)]
    lines = spark.createDataFrame(rows, "h bigint, t bigint")
    whole = sorted(map(tuple, comparison.positive_pmi(lines, "h", "t", 2).collect()))
    monkeypatch.setattr(comparison, "PAIRS", 50)
    parted = comparison.positive_pmi(lines, "h", "t", 2)
    assert whole and sorted(map(tuple, parted.collect())) == whole
    sets = {}
    for h, t in rows:
        if h is not None and t is not None:
            sets.setdefault(h, set()).add(t)
    expected = sum(len(v) * (len(v) - 1) // 2 for v in sets.values()) // 50 + 1
    assert f"hashpartitioning(a#" in (plan := parted._jdf.queryExecution().toString()) and f", {expected}), REPARTITION_BY_NUM" in plan


def test_anchored_matrix_is_the_blend_of_its_parts(spark):
    """Each part enters once for a group and two locations, as it comes alone."""
    rows = [(g, p, k, "abc"[(k * p + k // 3 + len(g)) % 3]) for g in ("F", "OO") for p in range(4) for k in range(9)] + [("F", p, k, "b") for p in range(3) for k in range(0, 9, 2)]
    found = distances.tokens(spark.createDataFrame(rows, "g string, p int, k int, v string"), "g", "p", "k", "v")
    profile = spark.createDataFrame([(p, v, 0.1 * p + 0.2 * k, 0.5 * k) for p in range(4) for k, v in enumerate("abc")], "location int, value string, share double, rank_percent double")
    weight = {"F": 2.0, "OO": 1.0}
    cells = distances.aligned(found, ["group"])
    parts = [{(r.group, r.a, r.b): r[name] for r in df.collect()} for df, name in ((distances.intra(cells, ["group"]), "intra"), (distances.anchors(cells, ["group"], profile), "anchor"), (distances.values(cells, ["group"]), "value"))]
    matrix = distances.distance_matrix(found, spark.createDataFrame(list(weight.items()), "group string, weight double"), "anchored", profile, 0.3)
    got = {(r.a, r.b): r.distance for r in matrix.collect()}
    assert len(got) == 6 and len(parts[2]) == 12
    for (a, b), d in got.items():
        each = {g: 0.7 * (0.85 * parts[0][g, a, b] + 0.15 * parts[1][g, a, b]) + 0.3 * parts[2][g, a, b] for g in weight}
        assert abs(d - sum(weight[g] * x for g, x in each.items()) / 3) < 2e-6
