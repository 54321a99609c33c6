"""URL filters: explicit rules, and a path-template tree per host.

Rules (host, path prefix) are a bounded parameter: one CASE expression, longest rule first. For the rest, paths are
generalised to templates per host: a segment's digit runs become {n} and long hexadecimal runs {x} where it stands;
then, level by level, a node with more than LITERALS distinct children has them replaced by {s}, and what follows their first dot
kept; only children that are {n} or {x} stay. What is below LEVELS
segments stays one last segment. Labels are a column of the input: in the query, the rules' verdicts.

Evidence: every node of a host's tree has the labelled and the blocked pages below it. At each level, a labelled node
takes the counts of its labelled siblings too if its block rate doesn't differ from theirs statistically (two-proportion
z-test below Z): such branches are merged. A node's purity is (blocked + ALPHA * q) / (labelled + ALPHA), where q is what
is expected there: the mean rate of the same node on other hosts, each labelled host one vote (a subdomain is a host of its own, so a rule for a domain votes once a host), smoothed by ALPHA votes
for the purity of the parent; the root's parent has PRIOR. A template is rejected when the purity of its leaf exceeds
REJECT. So a branch without labels of its own is judged by its host's and by the same branch elsewhere.

The pages are aggregated to (host, shaped path) first, so that a host with a third of all pages costs no more than its
distinct shapes; only the small template table is joined back, by a join that adaptive execution can split. All of it
is DataFrame code.

Defined results: a null url, or one without ://, has empty host and path, no rule, and the method's verdict for the
template of an empty path on an empty host; repeated rows are judged each; an empty table gives no row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
LITERALS = 32
LEVELS = 6
Z = 1.96
ALPHA, PRIOR, REJECT = 4.0, 0.2, 0.6

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): A-Z of the host in lower case, nothing else changed."""
    host = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments, digits and long hexadecimal runs generalised; what is below LEVELS is one segment."""
    flat = F.regexp_replace(F.regexp_replace(path, "(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{12,}(?![A-Za-z0-9])", "{x}"), "[0-9]+", "{n}")
    return F.split(F.regexp_replace(flat, "^/", ""), "/", LEVELS)


def templates(shapes: DataFrame) -> DataFrame:
    """shapes (host, parts, ...) with template and prefixes (the template's nodes from the root on) added, by widening
    nodes with too many children."""
    out = shapes.withColumn("template", F.lit("")).withColumn("prefixes", F.array(F.lit("")))
    for level in range(LEVELS):
        part = F.get("parts", F.lit(level))
        here = F.size("parts") > level
        wide = out.filter(here).groupBy("host", "template").agg(F.countDistinct(part).alias("children")).filter(F.col("children") > LITERALS)
        wide = wide.select("host", "template", F.lit(True).alias("wide"))
        kept = F.when(F.col("wide") & ~part.isin("{n}", "{x}"), F.regexp_replace(part, r"^[^.]*", "{s}")).otherwise(part)
        out = out.join(wide, ["host", "template"], "left").withColumn("template", F.when(here, F.concat("template", F.lit("/"), kept)).otherwise(F.col("template")))
        out = out.withColumn("prefixes", F.when(here, F.array_append("prefixes", F.col("template"))).otherwise(F.col("prefixes"))).drop("wide")
    return out


def purity(shaped: DataFrame) -> DataFrame:
    """Per (host, template): the smoothed block purity of its leaf."""
    leaves = shaped.groupBy("host", "template", "prefixes").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    below = leaves.select("host", "template", "prefixes", "blocked", "labelled", F.posexplode("prefixes").alias("depth", "node"))
    parent = F.get("prefixes", F.col("depth") - 1)
    nodes = below.groupBy("host", "depth", "node", parent.alias("parent")).agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n"))
    kin = Window.partitionBy("host", "depth", "parent")  # a parent has about LITERALS children and their few shapes
    nodes = nodes.withColumn("ob", F.sum("b").over(kin) - F.col("b")).withColumn("on", F.sum("n").over(kin) - F.col("n"))
    pooled = F.try_divide(F.col("b") + F.col("ob"), F.col("n") + F.col("on"))
    gap = F.abs(F.try_divide("b", "n") - F.try_divide("ob", "on"))
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), F.col("on"))))
    alike = F.coalesce((F.col("depth") > 0) & (gap <= Z * spread), F.lit(False))
    rate = F.try_divide("b", "n")
    nodes = nodes.select("host", "depth", "node", rate.alias("rate"), F.when(alike, F.col("b") + F.col("ob")).otherwise(F.col("b")).alias("b"), F.when(alike, F.col("n") + F.col("on")).otherwise(F.col("n")).alias("n"))
    # Rates in millionths: sums of integers don't depend on their order.
    rate = F.round(F.col("rate") * 1_000_000).cast("long")
    votes = nodes.groupBy("depth", "node").agg(F.coalesce(F.sum(rate), F.lit(0)).alias("all_rates"), F.count("rate").alias("hosts"))
    nodes = nodes.withColumn("own", rate).join(votes, ["depth", "node"])
    others = (F.col("all_rates") - F.coalesce("own", F.lit(0))) / 1_000_000
    facts = F.struct("depth", "b", "n", others.alias("v"), (F.col("hosts") - F.when(F.col("own").isNull(), 0).otherwise(1)).alias("m"))
    nodes = nodes.select("host", "depth", "node", facts.alias("facts"))
    branch = below.select("host", "template", "depth", "node").join(nodes, ["host", "depth", "node"]).groupBy("host", "template").agg(F.array_sort(F.collect_list("facts")).alias("branch"))
    step = lambda p, x: (x["b"] + ALPHA * ((x["v"] + ALPHA * p) / (x["m"] + ALPHA))) / (x["n"] + ALPHA)
    return branch.select("host", "template", F.aggregate("branch", F.lit(PRIOR), step).alias("purity"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, label: Column | None = None) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict, template, purity.

    label: block as true, allow as false, unknown as null; the rules' verdict if it isn't given.
    """
    prepare(pages.sparkSession)
    url = F.col("url")
    host, path = split_url(url)
    mark = label if label is not None else F.lit(None).cast("boolean")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), mark.alias("given"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"), F.array_join(shape(F.col("path")), "/").alias("shape"))
    known = F.coalesce("given", F.col("said") == "block")
    shapes = rows.groupBy("host", "shape").agg(F.count_if(known).alias("blocked"), F.count(known).alias("labelled"))
    tree = stored(templates(shapes.withColumn("parts", F.split("shape", "/", LEVELS))).select("host", "shape", "template", "prefixes", "blocked", "labelled"), "templates")
    judged = stored(tree.select("host", "shape", "template").join(purity(tree), ["host", "template"]), "purity")
    return rows.join(judged, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("purity") > REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity"
    )
