"""The similarity join against all pairs."""

import re

import numpy as np
import pytest

from lexigrid.operators import matching
from lexigrid.plans import matching as plans


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def texts(seed, n, letters="abcdé漢字 "):
    random = np.random.RandomState(seed)
    out = ["".join(random.choice(list(letters), random.randint(1, 12))) for _ in range(n)]
    out += [x + "zz" for x in out[:10]] + [x[1:] + "q" for x in out[10:20] if len(x) > 1] + ["a", "x", "abc" * 30, "abc" * 29 + "abd", "d" * 64, "d" * 65, "d" * 63 + "e"]
    return out


def test_indel_ratios():
    a, b = texts(1, 80), texts(2, 80)
    first, second = [x for x in a for _ in b], b * len(a)
    got = matching.indel_ratios(first, second)
    assert np.allclose(got, [2 * common(x, y) / (len(x) + len(y)) for x, y in zip(first, second)])
    assert matching.indel_ratios(["", "a", ""], ["", "", "b"]).tolist() == [0, 0, 0]


@pytest.mark.parametrize("ratio", [0.7, 0.9, 0.35])
def test_match_batch(spark, ratio):
    names, terms = [*texts(3, 150), "漢漢é!"], [("sound", "hanhane!"), *((t, v) for t, v in zip(texts(4, 40), texts(4, 40)))]
    terms += [("several", names[0]), ("several", names[1]), ("several", "漢"), ("none", ""), ("lost", None), (None, "a")]
    sounds = [("漢", "han"), ("é", "e"), ("c", "k"), ("c", "z"), (" ", "")]
    got = matching.match_batch(
        spark.createDataFrame([(x,) for x in [*names, None, "", *names[:5]]], "name string"), spark.createDataFrame(terms, "term string, variant string"), ratio, spark.createDataFrame(sounds, "char string, sound string")
    ).collect()
    key = lambda t: "".join({"漢": "han", "é": "e", "c": "k", " ": ""}.get(c, c.lower()) for c in t)
    expected = {}
    for term, v in terms:
        for n in set(names) if v and term else ():
            score = 2 * common(n, v) / (len(n) + len(v))
            tier = 1 if n == v else 2 if n.startswith(v) else 3 if v in n else 4 if score >= ratio - 1e-12 else 5 if key(n) == key(v) != "" else None
            if tier:
                new = (tier, round(score, 6) if tier == 4 else None)
                old = expected.get((term, n))
                expected[term, n] = new if old is None or new[0] < old[0] or (new[0] == old[0] == 4 and new[1] > old[1]) else old
    assert {(r.term, r.name): (r.tier, r.ratio) for r in got} == expected and len(got) == len(expected)
    assert len({t for t, _ in expected.values()}) == 5


def test_match_batch_plan(spark):
    """Nothing is crossed, whatever the number of terms."""
    names, terms = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("a", "a")], "term string, variant string")
    plan = matching.match_batch(names, terms)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tiles(spark, monkeypatch):
    """Many blocks, with texts of over 64 characters, give what one pair at a time gives; no pair is shuffled before it is found."""
    monkeypatch.setattr(matching, "TEXTS", 16)
    monkeypatch.setattr(matching, "CHARS", 100)
    names, terms = sorted({*texts(7, 120), "\0", "a\0", "aa\0\0"}), sorted({*texts(8, 90), "\0a", "aa\0"})
    pairs = matching.similar(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in terms], "variant string"), 0.6)
    got = [(r.name, r.variant, round(r.ratio, 9)) for r in pairs.collect()]
    expected = {(n, v, round(2 * common(n, v) / (len(n) + len(v)), 9)) for n in names for v in terms if 2 * common(n, v) / (len(n) + len(v)) >= 0.6 - 1e-12}
    assert len(got) == len(set(got)) and set(got) == expected and any(len(n) > 64 < len(v) for n, v, _ in expected)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and not re.search(r"keys=\[name#\d+, variant", plan)


def test_sides_of_joins_are_named(spark, monkeypatch):
    """Spark's estimates don't see how many rows an explode gives, so no join is left to them; dealt out or sent, rows are the same."""
    names = spark.createDataFrame([(x,) for x in texts(5, 60)], "name string")
    terms = spark.createDataFrame([(x, x) for x in texts(6, 30)], "term string, variant string")
    sounds = spark.createDataFrame([("c", "k"), ("é", "e")], "char string, sound string")
    found = []
    for small in (200_000, 0):
        monkeypatch.setattr(matching, "SMALL", small)
        monkeypatch.setattr(matching, "SIGNS", 0)
        out = matching.match_batch(names, terms, 0.7, sounds)
        joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
        assert len(joins) > 9 and all("strategy=" in x for x in joins)
        found.append(sorted(map(repr, out.collect())))
    assert found[0] == found[1] and found[0]


def test_words_of_any_length(spark, tmp_path):
    """Short words are names and terms too."""
    for name, texts_ in (("documents", ["a cat sat, on Ürgo", None, "x7y"]), ("benchmark", ["at cats ab", ""])):
        spark.createDataFrame([(t,) for t in texts_], "text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.term, r.name): r.tier for r in plans.adv39_fuzzy_matches(spark, str(tmp_path)).collect()}
    assert got == {("at", "cat"): 3, ("at", "sat"): 3, ("cats", "cat"): 4}


def test_few_sounds_need_no_row_for_each_character(spark, monkeypatch):
    names = spark.createDataFrame([("Ca é",), ("xyz",), ("漢c",), ("e",)], "name string")
    sounds = spark.createDataFrame([("c", "k"), ("c", "z"), ("é", ""), ("漢", "han"), ("x", None), (None, "q")], "char string, sound string")
    keys = matching.sound_keys(names, "name", sounds, True)
    assert "Generate" not in keys._jdf.queryExecution().optimizedPlan().toString()
    got = {r.name: r.key for r in keys.collect()}
    monkeypatch.setattr(matching, "SIGNS", 0)
    assert got == {r.name: r.key for r in matching.sound_keys(names, "name", sounds, True).collect()} == {"Ca é": "ca ", "xyz": "xyz", "漢c": "hank", "e": "e"}
    assert {r.key for r in matching.sound_keys(names, "name", sounds.limit(0), True).collect()} == {"ca é", "xyz", "漢c", "e"}
