"""Names of one table against names of another: equal, one within the other, or with words in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_confidence

#: Characters of a gram.
GRAM = 4


def _plain(name: Column) -> Column:
    return F.trim(F.lower(name))


def _grams(name: Column, size: Column | int) -> Column:
    """Distinct pieces of size characters."""
    n = F.length(name)
    size = size if isinstance(size, Column) else F.lit(size)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(name, i, size)))).otherwise(F.array().cast("array<string>"))


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (i, o) of names of which o holds i. Each i has one anchor: of its grams that with the fewest names o, or the whole of a
    name under GRAM characters; each o is listed under its grams. So a frequent gram is an anchor only of names that have no rarer one."""
    sizes = F.sequence(F.lit(1), F.lit(GRAM))
    listed = outer.select(F.col("name").alias("o"), F.explode(F.flatten(F.transform(sizes, lambda k: _grams(F.col("name"), k)))).alias("gram"))
    often = listed.groupBy("gram").agg(F.count("*").alias("n"))
    asked = inner.select(F.col("name").alias("i"), F.explode(_grams(F.col("name"), F.least(F.length("name"), F.lit(GRAM)))).alias("gram"))
    # A gram that no o has rules its name out: of left-joined grams one without o's is the least.
    least = asked.join(often, "gram", "left").groupBy("i").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a"))
    anchors = least.filter(F.col("a.n") > 0).select("i", F.col("a.gram").alias("gram"))
    return anchors.join(listed, "gram").filter(F.col("o").contains(F.col("i"))).select("i", "o")


def _sharing(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (l, r) that may have enough common words for least: some of l's words must be r's, so one of these is among l's rarest."""
    words = lambda d, as_: d.select(F.col("name").alias(as_), F.split("name", "\\s+").alias("words"))
    listed = words(right, "r").select("r", F.explode(F.array_distinct("words")).alias("word"))
    often = listed.groupBy("word").agg(F.count("*").alias("n"))
    asked = words(left, "l").select("l", F.posexplode("words").alias("pos", "word"))
    ranked = asked.join(often, "word", "left").groupBy("l").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "pos"))).alias("words"))  # a name's words are a few
    size = F.size("words")
    # Of n words at least ceil(least * n) are common, so one of the first n + 1 - that many is.
    first = F.slice("words", 1, size + 1 - F.greatest(F.lit(1), F.ceil(size * F.lit(least) - F.lit(1e-9)).cast("int")))
    probes = ranked.select("l", F.explode(F.array_distinct(F.transform(F.filter(first, lambda w: w["n"] > 0), lambda w: w["word"]))).alias("word"))
    return probes.join(listed, "word").select("l", "r").distinct()


def name_matches(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of names (left_name, right_name, confidence) with a confidence of least or more, above 0 and at most 0.7 for common words.

    left and right have a column name; names count once each, trimmed and in lower case; null and blank ones match nothing. Candidates come
    from equal names, anchors of contained names and rare common words; their confidence is then computed as for a single pair.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, and 1 at most")
    a, b = (d.select(_plain(F.col("name")).alias("name")).filter(F.length("name") > 0).distinct() for d in (left, right))
    pairs = _within(b, a).select(F.col("o").alias("l"), F.col("i").alias("r")).union(_within(a, b).select(F.col("i").alias("l"), F.col("o").alias("r")))
    if least <= 0.7:
        pairs = pairs.union(_sharing(a, b, least))
    scored = pairs.distinct().select(F.col("l").alias("left_name"), F.col("r").alias("right_name"), match_confidence(F.col("l"), F.col("r")).alias("confidence"))
    return scored.filter(F.col("confidence") >= least)
