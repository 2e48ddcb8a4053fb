"""Scalar functions on text and time (survey group FN)."""

from __future__ import annotations

from json import dumps, loads

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def split_many(text: Column, separators: str) -> Column:
    """Non-empty parts between any of the separator characters."""
    escaped = "".join("\\" + c for c in separators)
    return F.filter(F.split(text, f"[{escaped}]+"), lambda x: x != "")


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Replaces by the first rule, longest first, whose text occurs; others stay."""
    cases = [F.when(F.contains(text, F.lit(a)), F.replace(text, F.lit(a), F.lit(b))) for a, b in sorted(rules, key=lambda r: -len(r[0]))]
    return F.coalesce(*cases, text)


def category(text: Column, rules: list[tuple[str, list[str], list[str]]], other: str) -> Column:
    """The first rule's name with one of its texts and none of its exclusions."""
    out = F.lit(other)
    for name, texts, without in reversed(rules):
        hit = F.lit(False)
        for x in texts:
            hit = hit | F.contains(text, F.lit(x))
        for x in without:
            hit = hit & ~F.contains(text, F.lit(x))
        out = F.when(hit, name).otherwise(out)
    return out


def route_template(url: Column) -> Column:
    """The path of a url with numbers as {id} and without query."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)?", 1)
    return F.regexp_replace(path, r"/[0-9]+(?=/|$)", "/{id}")


def _redact(value, names: frozenset[str]):
    if isinstance(value, dict):
        return {k: "***" if k.lower() in names else _redact(v, names) for k, v in value.items()}
    return [_redact(v, names) for v in value] if isinstance(value, list) else value


def redacted(json: Column, names: list[str], most: int) -> Column:
    """Values of the named JSON keys, at any depth and with letter case ignored, replaced by ***, whatever their type; cut to
    `most` bytes of UTF-8 (a character cut in two shows as U+FFFD). Texts that hold none of the names stay as they are. Of what isn't
    JSON and holds a name, nothing is shown but ***. Null stays null."""
    low = frozenset(n.lower() for n in names)

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None or text != text:  # NaN stands for null in some versions
                return None
            if any(n in text.lower() for n in low) or "\\u" in text:  # names may be written with escapes
                try:
                    text = dumps(_redact(loads(text), low), ensure_ascii=False)
                except (ValueError, RecursionError):
                    text = "***"
            raw = text.encode("utf-8", "replace")
            return text if len(raw) <= most else raw[:most].decode("utf-8", "replace")

        return texts.map(one, na_action=None)

    return shown(json)


def coordinates(text: Column) -> Column:
    """"lat,lon" as a struct of doubles, null where it can't be read."""
    parts = F.split(text, ",")
    return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("lat"), F.get(parts, F.lit(1)).try_cast("double").alias("lon"))


#: Vowels of the romanisation, and single Han characters' ranges and stand-in signs.
VOWELS = "aeuioy"
HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}□■⬜⬛☐☑☒▯▢▣█]"
TONE_END = r"[0-9⁰¹²³⁴⁵⁶⁷⁸⁹]{1,4}[ABCDabcd]?$"


def script_candidates(text: Column, layers: list[dict[str, str]]) -> Column:
    """Of each character its candidates in the first layer that has it (each a text of candidate characters), or itself."""
    tables = [F.create_map(*(F.lit(x) for pair in layer.items() for x in pair)) for layer in layers if layer]
    known = lambda c: F.coalesce(*(F.try_element_at(t, c) for t in tables), c)
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), known)


def to_traditional(text: Column, layers: list[dict[str, str]]) -> Column:
    """The text with each character's first candidate."""
    return F.array_join(F.transform(script_candidates(text, layers), lambda c: F.substring(c, 1, 1)), "")


def mapped_characters(text: Column, pairs: dict[str, str]) -> Column:
    """One-to-one replacement of characters."""
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def path_label(path: Column, ambiguous: list[str]) -> Column:
    """[value]{column}[value]{column} as value·value, with the column after values that are ambiguous."""
    pairs = F.regexp_extract_all(path, F.lit(r"(\[[^\[\]]+\]\{[^{}]+\})"))
    value = lambda p: F.regexp_extract(p, r"\[([^\[\]]+)\]", 1)
    shown = lambda p: F.concat(value(p), F.when(value(p).isin(ambiguous), F.regexp_extract(p, r"\{([^{}]+)\}", 1)).otherwise(""))
    return F.array_join(F.transform(pairs, shown), "·")


def mark_label(mark: Column, labels: dict[int, str]) -> Column:
    out = F.lit("")
    for value, label in labels.items():
        out = F.when(mark == value, label).otherwise(out)
    return out


def merged_note(note: Column, label: Column) -> Column:
    """The label before the note, unless the note holds it; a note '_' or without text is none."""
    base = F.trim(F.coalesce(note, F.lit("")))
    return F.when(label == "", base).when(F.contains(base, label), base).when((base == "") | (base == "_"), label).otherwise(F.concat(label, F.lit("；"), base))


def onset_rime_tone(ipa: Column, vowels: str) -> Column:
    """Struct of onset (/ without one, ʔ for a zero sign), rime (from the first vowel up to a digit or space; a syllabic
    sonant without vowels) and tone (the code at the end, or 輕聲) of an IPA syllable."""
    s = F.trim(F.coalesce(ipa, F.lit("")))
    body = F.regexp_replace(s, "^[∅Ø0]", "")
    letters = F.regexp_extract(body, r"^([^0-9⁰¹²³⁴⁵⁶⁷⁸⁹\s]*)", 1)
    vowel, sonant = f"[{vowels}]", "[zflmnŋȵɲvʒr]"
    has = F.rlike(letters, F.lit(vowel))
    rime = F.when(has, F.regexp_extract(letters, f"({vowel}.*)$", 1)).otherwise(F.regexp_extract(letters, f"({sonant}.*)$", 1))
    onset = F.when(F.rlike(s, F.lit("^[∅Ø0]")), "ʔ").when(F.length(letters) == 0, "").when(F.length(rime) == F.length(letters), "/").otherwise(F.substr(letters, F.lit(1), F.length(letters) - F.length(rime)))
    tone = F.when(F.contains(s, F.lit("輕聲")), "輕聲").otherwise(F.regexp_extract(s, f"({TONE_END[:-1]})$", 1))
    return F.struct(onset.alias("onset"), rime.alias("rime"), tone.alias("tone"))


def split_romanised(text: Column, vowels: str = VOWELS) -> Column:
    """Struct of initial, final, tone (all digits), nucleus and coda of a romanised syllable."""
    tone, letters = F.regexp_replace(text, "[^0-9]", ""), F.regexp_replace(text, "[0-9]", "")
    final = F.coalesce(F.nullif(F.regexp_extract(letters, f"([{vowels}].*)$", 1), F.lit("")), F.regexp_extract(letters, "(ng|n|m)$", 1))
    initial = F.substr(letters, F.lit(1), F.length(letters) - F.length(final))
    n_vowels = F.regexp_count(final, F.lit(f"[{vowels}]"))
    glide = F.rlike(final, F.lit("[iu]$")) & (n_vowels > 1)
    nucleus = F.when(final.isin("ng", "n", "m"), final).when(glide, F.substr(final, F.lit(1), F.length(final) - 1)).otherwise(F.regexp_replace(final, f"[^{vowels}]", ""))
    coda = F.when(final.isin("ng", "n", "m"), "").when(glide, F.right(final, F.lit(1))).otherwise(F.regexp_replace(final, f"[{vowels}]", ""))
    return F.struct(initial.alias("initial"), final.alias("final"), tone.alias("tone"), nucleus.alias("nucleus"), coda.alias("coda"))


def first_of(text: Column, rules: Column) -> Column:
    """Replaced by the first rule, longest first, whose text occurs. rules: an array of structs (of, to)."""
    ordered = F.array_sort(F.transform(rules, lambda r: F.struct((-F.length(r["of"])).alias("k"), r["of"].alias("of"), r["to"].alias("to"))))
    hit = F.get(F.filter(ordered, lambda r: F.contains(text, r["of"])), F.lit(0))
    return F.when(hit.isNull(), text).otherwise(F.replace(text, hit["of"], hit["to"]))


def romanised_to_ipa(text: Column, rules: dict[str, Column], vowels: str = VOWELS) -> Column:
    """Struct of ipa (the alternatives between slashes, each put together from its replaced parts) and note (what stands
    in round brackets). rules: by part (initial, nucleus, coda, tone), an array of structs (of, to)."""
    note = F.array_join(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)")), ";")
    bare = F.trim(F.regexp_replace(text, r"\([^()]*\)", ""))

    def one(x):
        parts = split_romanised(F.trim(x), vowels)
        return F.concat(*(first_of(parts[p], rules[p]) if p in rules else parts[p] for p in ("initial", "nucleus", "coda", "tone")))

    return F.struct(F.array_join(F.transform(F.split(bare, "/"), lambda x: one(x)), "/").alias("ipa"), note.alias("note"))


def format_errors(char: Column, ipa: Column, allowed: str) -> Column:
    """The sorted faults of a row: not one Han character, no tone, odd signs; none where either is empty."""
    c, s = F.trim(F.coalesce(char, F.lit(""))), F.trim(F.coalesce(ipa, F.lit("")))
    toneless = ~F.rlike(s, F.lit(TONE_END))
    odd = F.rlike(s, F.lit("^[0-9]")) | F.exists(F.split(s, r"[,;/\\]"), lambda p: ~F.rlike(F.trim(p), F.lit(f"^[{allowed}]*$")))
    found = F.array_compact(F.array(F.when(~F.rlike(c, F.lit(f"^{HAN}$")), "not one character"), F.when(toneless, "no tone").when(odd, "odd signs")))
    return F.when((c == "") | (s == ""), F.array().cast("array<string>")).otherwise(F.array_sort(found))


def tone_replaced(ipa: Column, old: str, new: str, checked: bool, finals: str) -> Column:
    """The tone at the end replaced, if it is `old` and the syllable's final is (or isn't) one of the checked finals."""
    code = F.regexp_extract(ipa, f"({TONE_END[:-1]})$", 1)
    head = F.substr(ipa, F.lit(1), F.length(ipa) - F.length(code))
    stop = F.coalesce(F.contains(F.lit(finals), F.nullif(F.right(head, F.lit(1)), F.lit(""))), F.lit(False))
    return F.when((F.translate(code, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789") == old) & (stop == checked), F.concat(head, F.lit(new))).otherwise(ipa)


def route_rule(path: Column, rules: list[tuple[str, str]], first: list[tuple[str, str]], other: str) -> Column:
    """The value of the rule that matches a path: those of `first` in order, then an exact one, then the wildcard (*) with
    the most other characters."""
    test = lambda p: F.rlike(path, F.lit("^" + ".*".join(_literal(x) for x in p.split("*")) + "$"))
    exact = [(p, v) for p, v in rules if "*" not in p]
    wild = sorted(((p, v) for p, v in rules if "*" in p), key=lambda r: -len(r[0].replace("*", "")))
    out = F.lit(other)
    for pattern, value in reversed([*first, *exact, *wild]):
        out = F.when(test(pattern), value).otherwise(out)
    return out


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in text)


def device(agent: Column) -> Column:
    """Struct of os and browser by the signs in a user agent; the browser's own name counts before the system's usual one."""
    has = lambda x: F.contains(F.coalesce(agent, F.lit("")), F.lit(x))
    system = F.when(has("iPhone") | has("iPad"), "iOS").when(has("Android"), "Android").when(has("Windows"), "Windows").when(has("Macintosh"), "Mac OS").when(has("Linux"), "Linux").otherwise("Unknown OS")
    usual = F.when(system.isin("iOS", "Mac OS"), "Safari").when(system.isin("Android", "Windows"), "Chrome").when(system == "Linux", "Firefox").otherwise("Unknown Browser")
    browser = F.when(has("Chrome"), "Chrome").when(has("Firefox"), "Firefox").when(has("Safari"), "Safari").when(has("Edge"), "Edge").otherwise(usual)
    return F.struct(system.alias("os"), browser.alias("browser"))


def local_time(at: Column, zone: str = "Asia/Shanghai") -> Column:
    """A UTC instant as that zone's wall clock."""
    return F.from_utc_timestamp(at, zone)


def utc_time(at: Column, zone: str = "Asia/Shanghai") -> Column:
    """That zone's wall clock as UTC."""
    return F.to_utc_timestamp(at, zone)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """2 * longest common subsequence / (length + length), 0 for an empty or null text: nested aggregates over characters,
    so meant for names."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    empty = F.array().cast("array<int>")

    def row(before, x):
        def step(done, j):
            left = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))
            above = lambda k: F.coalesce(F.get(before, k), F.lit(0))
            value = F.when(F.get(chars(b), j) == x, F.when(j > 0, above(j - 1)).otherwise(0) + 1).otherwise(F.greatest(left, above(j)))
            return F.concat(done, F.array(value))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars(b)) - 1), empty, step)

    common = F.try_element_at(F.aggregate(chars(a), empty, row), F.lit(-1))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 2 * common / (F.length(a) + F.length(b))).otherwise(0.0)


def json_list(text: Column) -> Column:
    """A JSON list of texts; null where it isn't one."""
    return F.from_json(text, "array<string>")


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
