"""Text rules as native Columns: normalisation, title and label tests, boilerplate, completeness, coherence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .numbers import half_up

# Patterns whose matches must equal those of the rules they express.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"
CONTROL = "[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
LINK = "https?://"
PHONE = "[0-9]{3}[\\s.-]?[0-9]{3}[\\s.-]?[0-9]{4}"
EMAIL = "(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}"
WWW = "(?i)(?<![A-Za-z0-9_])www\\.[^\\s]+"
WHOLE_PHONE = "(?<![A-Za-z0-9_])[0-9]{3}[\\s.-]?[0-9]{3}[\\s.-]?[0-9]{4}(?![A-Za-z0-9_])"
PAGE_NUMBER = "(\\$[0-9,]+(?:\\.[0-9]{2})?|[0-9,]+(?:\\.[0-9]{2})?%|[0-9,]+(?:\\.[0-9]+)?[KMB]?)"
IMAGE_NUMBER = "([$€£]?[0-9]+[.,]?[0-9]*%?|[0-9]+[.,][0-9]+|[0-9]+%)"
IMAGE_HEADING = "^[A-Z][a-z\\s]+$"
CAPS_RUN = "[A-Z]{3,}"
WEIRD = "[^A-Za-z0-9\\s\\-–%$.,/:]"
# A word boundary is between ASCII letters, digits or underscores and anything else, accented letters included.
WORD3 = "(?<![A-Za-z0-9_])[a-zA-Z]{3,}(?![A-Za-z0-9_])"
CAPS3 = "(?<![A-Za-z0-9_])[A-Z]{3,}(?![A-Za-z0-9_])"
BRACKETS = "[\\]\\[)({}|<>\\\\]"
LABEL_CHARACTER = "[A-Za-z0-9\\s\\-–%$.,/:]"
NUMERIC = "(?i)(?:\\$[0-9,]+(?:\\.[0-9]+)?(?:%|[kmb]|x)?|[0-9,]+(?:\\.[0-9]+)?(?:%|[kmb]|x)|[0-9]+\\s*[–-]\\s*[0-9]+(?:%|[kmb]|x)?)"
NOT_SPECIAL = "[a-zA-Z0-9\\s.,\\-:;'\"()]+"
CONFUSED = "[0O]l{2,}|[l1|]{3,}"


def text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def count(x: Column, pattern: str) -> Column:
    """Matches of a pattern: as many characters as a text grows by if one is put behind each. (regexp_count makes an array of all.)"""
    return F.length(F.regexp_replace(x, pattern, "$0\x01")) - F.length(x)


def count_of(x: Column, characters: str) -> Column:
    """Characters of a class, by what is left without them."""
    return F.length(x) - F.length(F.regexp_replace(x, f"{characters}+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once a row whatever branches use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(text(x), SPACE, " "))


def sanitize(x: Column) -> Column:
    """NUL goes, other control characters become spaces, white space collapses."""
    return collapse(F.regexp_replace(F.replace(text(x), F.lit("\0"), F.lit("")), CONTROL, " "))


def sanitize_nullable(x: Column) -> Column:
    return F.nullif(sanitize(x), F.lit(""))


def sanitize_deep(x: Column, kind: T.DataType) -> Column:
    """sanitize on every string within a struct, an array or a map's values; other scalars are as they were."""
    if isinstance(kind, T.StringType):
        return F.when(x.isNotNull(), sanitize(x))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: sanitize_deep(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: sanitize_deep(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(sanitize_deep(x.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    return x


def is_boilerplate(x: Column) -> Column:
    low = F.lower(text(x))
    return low.rlike(LINK) | low.contains("www.") | low.contains("@") | low.rlike(PHONE)


def strip_logo(x: Column) -> Column:
    """Without a leading token of up to three letters, if what follows has two real words."""
    return without_logo(collapse(x))


def without_logo(t: Column) -> Column:
    """strip_logo of a collapsed title."""
    rest = F.trim(F.regexp_extract(t, "^[a-zA-Z]{1,3}\\s+(.{6,})$", 1))
    return F.when((rest != "") & (count(rest, WORD3) >= 2), rest).otherwise(t)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is found once however often f names it: functions of arrays evaluate each mention anew."""
    return F.transform(F.array(x), f)[0]


def first_of(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Items without those that are the same as an earlier one, in one fold."""
    return let(items, lambda all_: F.aggregate(all_, F.slice(all_, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: same(k, x)), kept).otherwise(F.array_append(kept, x))))


def is_good_title(x: Column) -> Column:
    return passes_for_title(strip_logo(x))


def passes_for_title(t: Column) -> Column:
    """is_good_title of a title that is collapsed and has no logo prefix."""
    n = F.length(t)
    enough = (n >= 10) & (n <= 120) & t.rlike(WORD3) & (F.size(F.split(t, " ")) >= 2)
    shape = (count_of(t, BRACKETS) < 2) & (count_of(t, "[A-Za-z]") * 100 >= n * 55)
    shouting = (count(t, CAPS3) >= 5) & (count(t, WORD3) < 3)
    return enough & shape & ~is_boilerplate(t) & ~shouting & ~t.rlike("(?i)(?<![a-z0-9_])use\\)(?=[a-z0-9_])")


def normalize_confidence(x: Column) -> Column:
    v = F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(x)
    return F.least(F.greatest(F.when(v <= 1, v * 100).otherwise(v), F.lit(0.0)), F.lit(100.0))


def boilerplate_key(x: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text(x)), "[^a-z0-9@./:\\-\\s]", " "))


def title_key(x: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text(x)), "[^a-z0-9\\s]", " "))


def is_garbled(x: Column) -> Column:
    """Not a label: empty, too long, or more noise than words."""
    t = collapse(x)
    n, letters, digits, gaps = F.length(t), count_of(t, "[A-Za-z]"), count_of(t, "[0-9]"), count_of(t, "\\s")
    tokens = F.split(t, " ")
    single = F.size(F.filter(tokens, lambda w: F.length(w) == 1))
    k = F.size(tokens)
    signs = [
        t == "", n > 90, letters < 4, count_of(t, LABEL_CHARACTER) * 100 < n * 82, (n > 25) & (gaps < 2), (n > 25) & (digits > 0) & (letters * 10 < digits * 6),
        t.rlike("[|\\\\]{2,}"), t.rlike("[\\[\\]{}<>]"), t.contains("___"), (n > 30) & (count(t, CAPS3) >= 4), (k >= 6) & (single * 100 > k * 35), k > 12,
    ]
    out = signs[0]
    for s in signs[1:]:
        out = out | s
    return out


def is_numeric_value(x: Column) -> Column:
    return text(x).rlike(NUMERIC)


def locate(x: Column, part: Column) -> Column:
    """1-based position of part in x, 0 if it isn't there."""
    return F.call_function("locate", part, x)


def trimmed(x: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(text(x), f"^{SPACE}|{SPACE}$", "")


# Java's classes are ASCII's; its $ also stands before a last line end, of which only NEL isn't white space here.
_NUMERIC, _LINK, _PHONE = (re.compile(p, re.ASCII) for p in (NUMERIC, LINK, PHONE))
_ENDS = re.compile(f"^{SPACE}|{SPACE}(?=\x85?\\Z)", re.ASCII)


def judged_word(word: str) -> tuple[bool, str]:
    """For Arrow batches: whether is_numeric_value holds, and the word itself if so; else it trimmed, or empty if is_boilerplate holds."""
    if _NUMERIC.search(word):
        return True, word
    clean = _ENDS.sub("", word)
    low = clean.lower()
    return False, "" if _LINK.search(low) or "www." in low or "@" in low or _PHONE.search(low) else clean


def key_numbers(x: Column, reach: int = 50) -> Column:
    """array<struct<value, context>>: every numeric token of a page in order, with the text around the token's first
    occurrence, reach characters to both sides of its beginning."""
    t = text(x)
    found = F.filter(F.regexp_extract_all(t, F.lit(PAGE_NUMBER), F.lit(1)), is_numeric_value)

    def around(v: Column) -> Column:
        at = locate(t, v) - 1
        start = F.greatest(at - reach, F.lit(0))
        return F.struct(v.alias("value"), trimmed(F.substring(t, start + 1, at + reach - start)).alias("context"))

    return F.transform(found, around)


def headings(titles: Column, boilerplate: Column | None = None, most: int = 10) -> Column:
    """Of slide titles in order those that pass, aren't boilerplate keys, and have a key of their own; the first most."""
    clean = F.filter(F.transform(F.transform(titles, collapse), without_logo), passes_for_title)
    keyed = F.transform(clean, lambda t: F.struct(F.trim(F.regexp_replace(title_key(t), "^[^a-z]+", "")).alias("k"), boilerplate_key(t).alias("b"), t.alias("t")))
    keyed = F.filter(keyed, lambda p: (p["k"] != "") & (p["b"] != ""))
    if boilerplate is not None:
        keyed = F.filter(keyed, lambda p: ~F.array_contains(boilerplate, p["b"]))
    def distinct(titles_: Column) -> Column:
        add = lambda s, p: F.when((F.size(s) >= most) | F.exists(s, lambda o: o["k"] == p["k"]), s).otherwise(F.array_append(s, p))
        return F.aggregate(titles_, F.slice(titles_, 1, 0), add, lambda s: F.transform(s, lambda p: p["t"]))

    return let(keyed, distinct)


def image_headings(x: Column, most: int = 10) -> Column:
    """Lines below 60 characters that start with no lower-case letter and are all capitals, or one capital and then
    small letters, without repeats."""
    lines = F.transform(F.split(text(x), "\n"), trimmed)
    capital = lambda t: t == F.upper(t)
    good = F.filter(lines, lambda t: (F.length(t) > 0) & (F.length(t) < 60) & capital(F.left(t, F.lit(1))) & (capital(t) | t.rlike(IMAGE_HEADING)))
    return F.slice(F.array_distinct(good), 1, most)


def image_numbers(x: Column, most: int = 20, reach: int = 50) -> Column:
    """array<struct<value, context>>: the numbers of all lines, each where it first stands, with the beginning of the
    last line that holds it; the first most."""
    lines = F.filter(F.transform(F.split(text(x), "\n"), trimmed), lambda t: F.length(t) > 0)
    pairs = F.flatten(F.transform(lines, lambda t: F.transform(F.regexp_extract_all(t, F.lit(IMAGE_NUMBER), F.lit(1)), lambda v: F.struct(v.alias("value"), F.left(t, F.lit(reach)).alias("context")))))
    first = F.slice(F.array_distinct(F.transform(pairs, lambda p: p["value"])), 1, most)
    return F.transform(first, lambda v: F.element_at(F.filter(pairs, lambda p: p["value"] == v), -1))


def strip_boilerplate(x: Column, titles: Column | None = None) -> Column:
    """Links, addresses and phone numbers, and titles whatever their case, become spaces."""
    out = text(x)
    for pattern in ("(?i)https?://\\S+", WWW, EMAIL, WHOLE_PHONE):
        out = F.regexp_replace(out, pattern, " ")
    if titles is not None:
        quoted = lambda t: F.concat(F.lit("(?i)\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        out = F.aggregate(titles, out, lambda s, t: F.regexp_replace(s, quoted(t), F.lit(" ")))
    return collapse(out)


def ocr_scale(width: Column, height: Column) -> Column:
    side = F.greatest(width, height, F.lit(1.0))
    return F.least(F.lit(6), F.greatest(F.lit(4), F.ceil(F.lit(1400.0) / side)))


def has_text_layer(tokens: Column, items: Column) -> Column:
    return (tokens >= 20) | (items >= 20)


# Positioned words: array<struct<text, x, y, w, h, conf>>


def slide_title(words: Column, height: Column) -> Column:
    """The line of the tallest word in the top quarter, its readable words from left to right; with less than three
    words, and readable ones in a second line close below, both lines."""
    top = F.filter(words, lambda w: (F.length(text(w["text"])) > 0) & (w["y"] <= height * 0.25) & (w["h"] > 0))
    # Heights within a tenth are as good as equal; then the more certain word.
    tall = F.array_max(F.transform(top, lambda w: w["h"]))
    anchor = F.array_max(F.transform(F.filter(top, lambda w: tall - w["h"] <= 0.1), lambda w, i: F.struct(w["conf"].alias("c"), (-i).alias("i"), w["h"].alias("h"), w["y"].alias("y"))))
    y, h = anchor["y"], anchor["h"]
    readable = F.filter(top, lambda w: (F.length(trimmed(w["text"])) > 1) & (w["conf"] >= 50) & (w["h"] >= 8) & ~is_boilerplate(w["text"]))
    band = lambda w: F.abs(w["y"] - y)
    one, two = F.filter(readable, lambda w: band(w) <= h * 0.8), F.filter(readable, lambda w: (band(w) > h * 0.8) & (w["y"] >= y) & (band(w) <= h * 1.3))

    places = lambda ws: F.transform(ws, lambda w, i: F.struct(w["x"].alias("x"), i.alias("i"), w["y"].alias("y"), trimmed(w["text"]).alias("t")))
    by_line = lambda a, b: F.when(F.abs(a["y"] - b["y"]) > h * 0.2, F.signum(a["y"] - b["y"])).otherwise(F.signum(a["x"] - b["x"])).cast("int")
    both = F.when((F.size(one) < 3) & (F.size(two) > 0), F.array_sort(places(F.concat(one, two)), by_line)).otherwise(F.array_sort(places(one)))
    return F.coalesce(F.array_join(F.transform(both, lambda w: w["t"]), " "), F.lit(""))


def word_metrics(words: Column, most: int = 10) -> Column:
    """array<struct<value, label>>: each numeric word with the first most words near it as its label, from left to
    right; one of each pair, none without a label."""

    said = F.transform(words, lambda w, i: F.struct(w["x"].alias("x"), i.alias("i"), trimmed(w["text"]).alias("t"), w["y"].alias("y")))
    labels = F.array_sort(F.filter(said, lambda w: (w["t"] != "") & ~is_numeric_value(w["t"]) & ~is_boilerplate(w["t"])))

    def label(v: Column, from_: Column) -> Column:
        near = F.filter(from_, lambda w: (F.abs(w["y"] - v["y"]) <= v["h"] * 0.75 + 8) & (w["x"] >= v["x"] - 120) & (w["x"] <= v["x"] + v["w"] + 120))
        return F.array_join(F.transform(F.slice(near, 1, most), lambda w: w["t"]), " ")

    numeric = F.filter(words, lambda w: is_numeric_value(w["text"]))
    # The words of labels are cleaned and ordered once a page, not once a number.
    pairs = let(labels, lambda from_: F.filter(F.transform(numeric, lambda v: F.struct(v["text"].alias("value"), label(v, from_).alias("label"))), lambda p: p["label"] != ""))
    return first_of(pairs, lambda a, b: (F.lower(a["value"]) == F.lower(b["value"])) & (F.lower(a["label"]) == F.lower(b["label"])))


def readable_words(words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(F.trim(w["text"])) > 0) & (w["w"] > 0) & (w["h"] >= 8) & (w["conf"] >= 50))


# Completeness, coherence, verification


def ingest_completeness(summary_length: Column, headings_: Column, metrics: Column) -> Column:
    """Hundredths: 40 for a summary, 30 for headings, 30 for metrics."""
    a = F.when(summary_length >= 100, 40).when(summary_length >= 20, 20).otherwise(0)
    b = F.when(headings_ >= 3, 30).when(headings_ >= 1, 15).otherwise(0)
    return a + b + F.when(metrics >= 5, 30).when(metrics >= 1, 15).otherwise(0)


def data_completeness(summary_length: Column, headings_: Column, metrics: Column) -> Column:
    a = F.when(metrics >= 3, 30).when(metrics >= 1, 15).otherwise(0)
    b = F.when(headings_ >= 5, 30).when(headings_ >= 2, 15).otherwise(0)
    return a + b + F.when(summary_length >= 300, 40).when(summary_length >= 100, 20).when(summary_length > 0, 10).otherwise(0)


def listed(*checks: tuple[Column, str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(say)) for holds, say in checks)))


def coherence_facts(x: Column) -> Column:
    """What coherence is judged by, each found once: characters (n), special ones, words and the characters in them, confused glyphs."""
    t = text(x)
    spaced = lambda c: F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))

    def facts(c: Column) -> Column:
        gaps = spaced(c)
        letters = F.length(c) - gaps
        words = F.when(letters > 0, gaps + 1 - F.startswith(c, F.lit(" ")).cast("int") - F.endswith(c, F.lit(" ")).cast("int")).otherwise(0)
        special = F.length(F.regexp_replace(t, NOT_SPECIAL, ""))
        return F.struct(F.length(t).alias("n"), special.alias("special"), words.alias("words"), letters.alias("letters"), t.rlike(CONFUSED).alias("confused"))

    return let(F.regexp_replace(t, SPACE, " "), facts)


def coherence_checks(f: Column) -> tuple[tuple[Column, int, str], ...]:
    """(condition, hundredths it costs, own wording) of what makes a text incoherent, by its facts."""
    odd = (f["words"] > 0) & ((f["letters"] < f["words"] * 2) | (f["letters"] > f["words"] * 15))
    return (
        (f["special"] * 100 > f["n"] * 15, 30, "many special characters"), (odd, 20, "words of odd length"),
        (f["confused"], 20, "confused glyphs"), (f["n"] < 50, 20, "little text"),
    )


def coherence(x: Column) -> Column:
    """Hundredths: 100 less 30 for special characters, 20 each for odd word lengths, confused glyphs, short text; 0 if empty."""

    def score(f: Column) -> Column:
        out = F.lit(100)
        for bad, cost, _ in coherence_checks(f):
            out = out - F.when(bad, cost).otherwise(0)
        return F.when(f["n"] == 0, 0).otherwise(F.greatest(out, F.lit(0)))

    return let(coherence_facts(x), score)


def coherence_issues(x: Column) -> Column:
    return let(coherence_facts(x), lambda f: F.when(f["n"] == 0, F.array(F.lit("no text"))).otherwise(listed(*((bad, say) for bad, _, say in coherence_checks(f)))))


def completeness_issues(summary_length: Column, headings_: Column, metrics: Column, pages: Column) -> Column:
    """What is missing for full points, and headings fewer than one in three pages, two at least, where there are pages."""
    return listed(
        (metrics.between(1, 2), "few metrics"), (metrics == 0, "no metrics"), (headings_.between(2, 4), "few sections"), (headings_ < 2, "hardly any structure"),
        (summary_length.between(1, 99), "a brief summary"), (summary_length == 0, "no summary"), ((pages > 0) & (headings_ < F.greatest(F.lit(2), F.floor(pages / 3))), "fewer sections than pages suggest"),
    )


def verification(x: Column, kind: Column, ocr_mean: Column, ocr_words: Column, coherence_: Column, summary_length: Column, headings_: Column, metrics: Column, pages: Column) -> Column:
    """struct<overall, ocr, coherence, completeness, warnings, recommendations> of an extracted document; coherence_ is
    coherence(x), which callers compute once. Only PDF text that went through OCR has an OCR grade of its own."""
    complete = data_completeness(summary_length, headings_, metrics)
    ocr = F.when((kind == "pdf") & (ocr_words > 0), ocr_grade(ocr_mean)).otherwise("pass")
    total, c_grade, d_grade = overall(ocr, coherence_, complete), part_grade(coherence_), part_grade(complete)
    warnings = F.concat(listed((ocr == "warn", "OCR below ideal"), (ocr == "fail", "OCR very low")), coherence_issues(x), completeness_issues(summary_length, headings_, metrics, pages))
    advice = listed(
        (ocr == "fail", "scan again"), (c_grade == "fail", "review the text by hand"), (d_grade != "pass", "compare with the source"),
        (total >= 0.8, "ready for analysis"), ((total >= 0.6) & (total < 0.8), "review before analysis"), (total < 0.6, "manual review required"),
    )
    parts = {"overall": total, "ocr": ocr, "coherence": c_grade, "completeness": d_grade, "warnings": warnings, "recommendations": advice}
    return F.struct(*(v.alias(n) for n, v in parts.items()))


def ocr_grade(mean: Column) -> Column:
    return F.when(mean >= 90, "pass").when(mean >= 75, "warn").otherwise("fail")


def part_grade(hundredths: Column) -> Column:
    return F.when(hundredths >= 80, "pass").when(hundredths >= 50, "warn").otherwise("fail")


def overall(ocr: Column, coherence_: Column, completeness: Column) -> Column:
    """0..1 of an OCR grade and two scores in hundredths."""
    points = F.when(ocr == "pass", 100).when(ocr == "warn", 70).otherwise(40)
    return (points * 25 + coherence_ * 35 + completeness * 40) / F.lit(10000.0)


def verification_status(overall_: Column) -> Column:
    return F.when(overall_ >= 0.8, "verified").when(overall_ >= 0.5, "warnings").otherwise("failed")


# Files


# File extensions and the kinds of content they hold.
KINDS = {"pdf": "pdf", "xlsx": "excel", "xls": "excel", "pptx": "powerpoint", "ppt": "powerpoint", "docx": "word", "doc": "word", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image"}


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), key), F.lit(default))


def content_type(filename: Column) -> Column:
    return lookup(KINDS, F.lower(F.regexp_extract(filename, "\\.([^.]+)$", 1)), "unknown")


def company(filename: Column) -> Column:
    name = F.regexp_replace(filename, "\\.[^.]+$", "")
    prefixed = F.trim(F.regexp_extract(name, "^(?:PD|BP|WP|Financials)\\s*-\\s*([^-]+?)(?:\\s*-|$)", 1))
    before = F.trim(F.regexp_extract(name, "(?i)^([^Dd]+?)(?:\\s+Deck|\\s+Fund|\\s+Series|\\s+Raise|\\s+Valuation|\\s+Overview)", 1))
    rest = F.trim(F.regexp_replace(name, "(?i)\\s*(v[0-9]+|edits?|version|v[0-9a-z]+).*$", ""))
    empty = F.lit("")
    return F.coalesce(F.nullif(prefixed, empty), F.nullif(before, empty), F.nullif(rest, empty), F.lit("Unknown"))


def file_document_type(filename: Column) -> Column:
    n = F.lower(filename)
    return (
        F.when(n.contains("pd -") | n.contains("pitch"), "pitch_deck")
        .when(n.contains("bp -") | n.contains("business plan"), "business_plan")
        .when(n.contains("wp -") | n.contains("whitepaper"), "whitepaper")
        .when(n.contains("financials") | n.contains("valuation"), "financials")
        .otherwise("other")
    )


def variant(filename: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(filename, "(?i)((?:v[0-9]+[a-z]?|version\\s+[0-9]+|edits?)\\s*(?:\\(.*\\))?)", 1)), F.lit(""))


def match_confidence(company_: Column, deal: Column) -> Column:
    """1 if equal, 0.85 if one contains the other, else the share of common words, 0.7 at most."""
    a, b = F.trim(F.lower(company_)), F.trim(F.lower(deal))
    x, y = F.split(a, "\\s+"), F.split(b, "\\s+")
    common = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.85).otherwise(F.least(common.cast("double") / F.greatest(F.size(x), F.size(y)), F.lit(0.7)))


def title_case(x: Column) -> Column:
    return F.initcap(F.lower(x))


def human_size(n: Column) -> Column:
    """1024 steps, two decimals."""
    i = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    unit = F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), i + 1)
    value = half_up(n.cast("double") / F.element_at(F.array(*(F.lit(1024.0**k) for k in range(4))), i + 1), 2)
    whole = value == F.floor(value)
    return F.when(n == 0, "0 Bytes").otherwise(F.concat(F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string")), F.lit(" "), unit))


# Context compression

MARKER = "\n[... truncated due to length ...]"
_TRIM_LINES = "(?m)[\\t\\x0b\\f\\r ]+$"
_COMMENTS = ("(?s)<!--.*?-->", "(?s)/\\*.*?\\*/", "(?m)//.*$", "(?m)--.*$", "(?m)^(?!#\\s)#[^#].*$")


def squeeze(x: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text(x), _TRIM_LINES, ""), "\n{3,}", "\n\n")
    return F.regexp_replace(out, "^\\s+|\\s+$", "")


def without_comments(x: Column) -> Column:
    out = text(x)
    for pattern in _COMMENTS:
        out = F.regexp_replace(out, pattern, "")
    return out


def _abbreviated(x: str) -> str:
    words = x.split()
    grams = Counter(" ".join(words[i : i + 3]) for i in range(len(words) - 2))
    for gram, n in grams.items():
        if n >= 3 and len(gram) > 20:
            x = x.replace(gram, "".join(w[0] for w in gram.split(" ")[:2]).upper())
    return x


def _slices(texts: pa.Array, many: int = 64) -> list[pa.Array]:
    return [texts.slice(i, many) for i in range(0, max(1, len(texts)), many)]


def abbreviate_repeats(x: Column) -> Column:
    """Three-word phrases of over 20 characters that occur three times or more become two capital initials, in turn.

    A replacement changes what later ones find, so this is a fold over one text: an Arrow-batched function, which
    holds few texts of a batch as Python's at once.
    """

    def fold(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([_abbreviated(v.as_py()) for v in part], pa.string()) for part in _slices(texts)])

    return arrow_udf(fold, "string")(text(x))


def truncate(x: Column, most: int) -> Column:
    """Cut at most characters, at the last full stop or line end beyond four fifths of it, with a marker."""
    head = F.left(text(x), F.lit(most))
    back = F.reverse(head)
    last = lambda s: F.when(F.instr(back, s) > 0, F.lit(most) - F.instr(back, s)).otherwise(-1)
    stop = F.greatest(last("."), last("\n"))
    return F.when(F.length(text(x)) <= most, text(x)).otherwise(F.concat(F.when(stop > most * 0.8, F.left(head, stop + 1)).otherwise(head), F.lit(MARKER)))


def summarize_lines(x: Column, most: int) -> Column:
    """The first fifth of the lines, a sample of the middle, and the last fifth; most lines."""
    lines = F.split(text(x), "\n", -1)
    n = F.size(lines)
    edge = F.ceil(n * F.lit(0.2)).cast("int")
    room = F.lit(most) - edge - edge
    middle = F.slice(lines, edge + 1, F.greatest(n - edge - edge, F.lit(0)))
    step = F.greatest(F.lit(1), F.floor(F.size(middle) / F.greatest(room, F.lit(1)))).cast("int")
    sampled = F.filter(middle, lambda _, i: i % step == 0)
    picked = F.when(room > 0, F.slice(sampled, F.lit(1), F.greatest(F.lit(most) - edge, F.lit(0)))).otherwise(F.slice(middle, 1, 0))
    tail_from = F.greatest(edge + room, n - edge)
    tail = F.slice(lines, tail_from + 1, F.greatest(n - tail_from, F.lit(0)))
    return F.when(n <= most, text(x)).otherwise(F.array_join(F.slice(F.concat(F.slice(lines, F.lit(1), edge), picked, tail), 1, most), "\n"))


def condensed(x: Column) -> Column:
    """Without needless white space, comments and repeats."""
    return abbreviate_repeats(without_comments(squeeze(x)))


def compress(x: Column, most: int | None = None) -> Column:
    """Condensed, then cut where that is asked for."""
    return truncate(condensed(x), most) if most else condensed(x)


def compression_estimate(x: Column) -> Column:
    """Per cent: 7 for white space, 10 for comments, 3 for words repeated over five times, 20 for length; 40 at most."""
    t = text(x)
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(state: Column, word: Column) -> Column:
        run = F.when(state["word"] == word, state["run"] + 1).otherwise(1)
        return F.struct(word.alias("word"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    repeats = F.aggregate(F.array_sort(F.split(t, "\\s+")), start, step, lambda state: state["most"]) > 5
    score = (
        F.when(t.rlike("\n\n\n|\\s{2,}"), 7).otherwise(0)
        + F.when(t.rlike("/\\*|//|<!--|--"), 10).otherwise(0)
        + F.when(repeats, 3).otherwise(0)
        + F.when(F.length(t) > 5000, 20).otherwise(0)
    )
    return F.least(score, F.lit(40))


def estimated_tokens(x: Column) -> Column:
    return F.ceil(F.length(text(x)) / 4)


def bucket_31(x: Column) -> Column:
    """abs of the 32-bit hash h = 31 h + code, modulo 100; for ids of basic characters."""
    codes = F.transform(F.filter(F.split(text(x), ""), lambda s: s != ""), lambda s: F.ascii(s).cast("long"))
    wrap = lambda h: F.pmod(h + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, k: wrap(h * 31 + k))) % 100
