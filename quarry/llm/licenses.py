"""License scans by ordered signature rules, in native expressions only.

Words are runs of digits, a-z (A-Z lower-cased) and characters above 127. A rule matches at each place of its first word where
its regular expression, from there on, ends at a word's end within LONGEST words; so every place counts, whatever others there
are. Rules are left out by their keywords, first for a text (before that by stems that keywords share), then for each block of BLOCK words, with the LONGEST words after it;
only what remains is matched. As blocks have a known number of words, places in the text need no counting from its start,
and neither time nor memory grows with the square of a text's length.

Of overlapping detections one is dropped if another's interval holds its own and that one has the higher priority, or an
equal one and is longer, or is as long and earlier in the rules. Detections of base rules always stay. The score is the
highest confidence among what stays, else 0.

Defined results: a null or empty text has no words and the score 0; repeated rows are scanned each; other columns are not
read; an empty table gives no row. One pass, no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import LONGEST, Rule, rules, stem

#: Words of a block.
BLOCK = 256
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "struct<n:int,label:string,anchor:string,regex:string,priority:int,confidence:double,base:boolean>"


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grouped(table: Sequence[Rule]) -> Column:
    """Rules by keyword, and these by stem, as one literal."""
    groups: dict[str, dict[str, list[dict]]] = {}
    for n, r in enumerate(table):
        one = {"n": n, "label": r.label, "anchor": r.anchor, "regex": f"^(?:{r.regex}) ", "priority": r.priority, "confidence": r.confidence, "base": r.base}
        groups.setdefault(stem(r.keyword), {}).setdefault(r.keyword, []).append(one)
    listed = [{"stem": s, "groups": [{"keyword": k, "rules": v} for k, v in g.items()]} for s, g in groups.items()]
    return F.from_json(F.lit(json.dumps(listed)), f"array<struct<stem:string,groups:array<struct<keyword:string,rules:array<{_RULE}>>>>>")


def _places(words: Column, rule: Column, k: Column) -> Column:
    """The places of a rule in block k; words has an empty word first."""
    at = F.filter(F.sequence(F.lit(1), F.lit(BLOCK)), lambda i: F.get(words, i) == rule["anchor"])

    def place(i: Column) -> Column:
        window = F.concat(F.array_join(F.slice(words, i + 1, F.lit(LONGEST)), " "), F.lit(" "))
        start = k.cast("long") * BLOCK + i - 1
        length = _spaces(F.call_function("regexp_extract", window, rule["regex"], F.lit(0)))
        parts = [rule[c].alias(c) for c in ("n", "label", "priority", "confidence", "base")]
        return F.struct(start.alias("start"), length.cast("int").alias("length"), *parts)

    return F.filter(F.transform(at, place), lambda d: d["length"] > 0)


def _in_block(block: Column, after: Column, k: Column, hits: Column) -> Column:
    """The detections that start in block k."""
    text = F.concat(block, F.coalesce(F.substring_index(after, " ", LONGEST + 1), F.lit("")), F.lit(" "))

    def found(t: Column) -> Column:
        near = F.filter(hits, lambda g: F.contains(t, g["keyword"]))

        def by_words(words: Column) -> Column:
            use = F.filter(F.flatten(F.transform(near, lambda g: g["rules"])), lambda r: F.array_contains(words, r["anchor"]))
            return F.flatten(F.transform(use, lambda r: _places(words, r, k)))

        return F.when(F.size(near) > 0, _let(F.split(t, " "), by_words))

    return _let(text, found)


def _beats(e: Column, d: Column) -> Column:
    """Whether e suppresses d."""
    holds = (e["start"] <= d["start"]) & (e["start"] + e["length"] >= d["start"] + d["length"])
    level = e["priority"] == d["priority"]
    longer = (e["length"] > d["length"]) | ((e["length"] == d["length"]) & (e["n"] < d["n"]))
    return holds & ((e["priority"] > d["priority"]) | (level & longer))


def detections(docs: DataFrame, table: Sequence[Rule] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, found (all detections) and kept (those that no other suppresses), both arrays of
    (start, length, n, label, priority, confidence, base) by words from 0."""
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.concat(F.lit(" "), lower), SEPARATORS, " ").alias("norm"))
    stems = F.filter(_grouped(rules() if table is None else table), lambda s: F.contains(F.col("norm"), s["stem"]))
    groups = F.flatten(F.transform(stems, lambda s: s["groups"]))
    n_words = (_spaces(F.col("norm")) - F.endswith("norm", F.lit(" ")).cast("int")).cast("long")
    gated = norm.select("doc_id", n_words.alias("n_words"), "norm", F.filter(groups, lambda g: F.contains(F.col("norm"), g["keyword"])).alias("hits"))
    blocks = F.when(F.size("hits") > 0, F.regexp_extract_all("norm", F.lit(f"(?: [^ ]+){{1,{BLOCK}}}"), F.lit(0)))
    cut = gated.select("doc_id", "n_words", "hits", blocks.alias("blocks"))
    found = F.transform("blocks", lambda b, k: _in_block(b, F.get("blocks", k + 1), k, F.col("hits")))
    by_block = cut.select("doc_id", "n_words", found.alias("by_block"))

    def unbeaten(ds: Column, k: Column) -> Column:
        around = F.concat(ds, F.coalesce(F.get("by_block", k - 1), F.slice(ds, 1, 0)))
        return F.when(F.size(ds) > 0, _let(around, lambda near: F.filter(ds, lambda d: d["base"] | ~F.exists(near, lambda e: _beats(e, d)))))

    def whole(x: Column) -> Column:
        return F.flatten(F.filter(x, lambda ds: ds.isNotNull()))

    return by_block.select("doc_id", "n_words", whole(F.col("by_block")).alias("found"), whole(F.transform("by_block", unbeaten)).alias("kept"))


def scan(docs: DataFrame, table: Sequence[Rule] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found, n_kept, licensed_words
    (words in kept detections' intervals, overlaps counted for each)."""
    base = F.filter("kept", lambda d: d["base"])
    made = detections(docs, table).select("doc_id", "n_words", F.size("found").alias("found"), "kept", base.alias("base"))

    def number(c: str) -> Column:
        return F.greatest(F.size(c), F.lit(0)).cast("long")

    def starts(c: str) -> Column:
        return F.transform(c, lambda d: d["start"])

    def names(c: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ","), F.lit(""))

    return made.select(
        "doc_id", "n_words", number("base").alias("n_base"), F.array_min(starts("base")).alias("first_word"), F.array_max(starts("base")).alias("last_word"), names("base").alias("base_labels"), names("kept").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0)).alias("score"), F.greatest("found", F.lit(0)).cast("long").alias("n_found"), number("kept").alias("n_kept"),
        F.coalesce(F.aggregate("kept", F.lit(0).cast("long"), lambda n, d: n + d["length"]), F.lit(0).cast("long")).alias("licensed_words"),
    )


def oracle(table: Sequence[Rule] | None = None) -> str:
    """SQL of another engine for the rows of scan() over documents: each place of an anchor by itself, no blocks."""
    listed = ", ".join(f"({n}, '{r.label}', '{r.keyword}', '{r.anchor}', '^(?:{r.regex}) ', {r.priority}, {r.confidence}e0, {r.base})" for n, r in enumerate(rules() if table is None else table))
    return f"""
WITH r(n, label, keyword, anchor, regex, priority, confidence, base) AS (VALUES {listed}), w AS (
  SELECT doc_id, row_number() OVER () AS k, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS words FROM documents
), i AS (
  SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM w
), p AS (
  SELECT k, i, words[i] AS anchor, array_to_string(words[i:i + {LONGEST - 1}], ' ') || ' ' AS span FROM i WHERE words[i] IN (SELECT anchor FROM r)
), d AS (
  SELECT k, i - 1 AS s, r.*, regexp_extract(span, regex) AS m FROM p JOIN r USING (anchor)
), h AS (SELECT * EXCLUDE (m), len(m) - len(replace(m, ' ', '')) AS l FROM d WHERE m <> ''), kept AS (
  SELECT * FROM h WHERE base OR NOT EXISTS (FROM h AS e WHERE e.k = h.k AND e.s <= h.s AND e.s + e.l >= h.s + h.l AND (e.priority > h.priority OR (e.priority = h.priority AND (e.l > h.l OR (e.l = h.l AND e.n < h.n)))))
), a AS (
  SELECT k, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(confidence) AS score, count(*) AS n_kept, CAST(sum(l) AS BIGINT) AS licensed_words FROM kept GROUP BY k
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score,
  (SELECT count(*) FROM h WHERE h.k = w.k) AS n_found, coalesce(n_kept, 0) AS n_kept, coalesce(licensed_words, 0) AS licensed_words FROM w LEFT JOIN a USING (k)
"""
