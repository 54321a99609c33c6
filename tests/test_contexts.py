"""Text rules that no SQL expresses, against plain versions over whole texts."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import cache, documents
from quarry.plans.catalog import QUERIES

PAGE = "Revenue 12% grew to $1,200.50 (12% of plan), 3-5x. Call 415-555-0100.\nOWNED 12K of 15 units\nMarket size\nTITLE LINE 2024\n 12% again\n9lives\n€7,5 and 12.5 or 12%\nmixed Case Title"
NUMERIC = re.compile(r"(?i)(?:\$[0-9,]+(?:\.[0-9]+)?(?:%|[kmb]|x)?|[0-9,]+(?:\.[0-9]+)?(?:%|[kmb]|x)|[0-9]+\s*[–-]\s*[0-9]+(?:%|[kmb]|x)?)")


def one(spark, x, rule):
    return spark.createDataFrame([(x,)], "x string").select(rule(F.col("x")).alias("v")).first()["v"]


def numbers(t):
    out = []
    for m in re.finditer(r"(\$[0-9,]+(?:\.[0-9]{2})?|[0-9,]+(?:\.[0-9]{2})?%|[0-9,]+(?:\.[0-9]+)?[KMB]?)", t):
        if NUMERIC.search(m[0]):
            at = t.index(m[0])
            out.append((m[0], t[max(0, at - 50) : min(len(t), at + 50)].strip()))
    return out


@pytest.mark.parametrize("t", ["", "no number", PAGE, "x" * 80 + " 5% " + "y" * 80 + " 5%", "5%" * 30])
def test_key_numbers(spark, t):
    assert [(m["value"], m["context"]) for m in one(spark, t, text.key_numbers)] == numbers(t)


@pytest.mark.parametrize("t", ["", "  \n ", PAGE, "\n".join(f"{i} of {i % 7}% and {i}" for i in range(60))])
def test_image_text(spark, t):
    lines = [x.strip() for x in t.split("\n") if x.strip()]
    heads = [x for x in lines if len(x) < 60 and x[0] == x[0].upper() and (x == x.upper() or re.fullmatch(r"[A-Z][a-z\s]+", x))]
    assert one(spark, t, text.image_headings) == list(dict.fromkeys(heads))[:10]
    found = {}
    for x in lines:
        for m in re.finditer(r"[$€£]?[0-9]+[.,]?[0-9]*%?|[0-9]+[.,][0-9]+|[0-9]+%", x):
            found[m[0]] = x[:50]
    assert [(m["value"], m["context"]) for m in one(spark, t, text.image_numbers)] == list(found.items())[:20]


def test_headings(spark):
    titles = ["AB Market Entry Strategy", "market entry strategy", "2024 Market Entry Strategy", "Team Growth Plan", "Repeated Page Title", "see www.x.org for more", "ab", "Product Roadmap Now"]
    got = spark.range(1).select(text.headings(F.array(*map(F.lit, titles)), F.array(F.lit("repeated page title"))).alias("h")).first()["h"]
    assert got == ["Market Entry Strategy", "Team Growth Plan", "Product Roadmap Now"]
    many = [f"Chapter {chr(97 + i) * 3} of a Book" for i in range(15)]
    assert spark.range(1).select(text.headings(F.array(*map(F.lit, many))).alias("h")).first()["h"] == many[:10]


def test_best_contexts(spark):
    rows = [
        (1, "5%", "growth a year on year basis", 1), (1, "5%", "growth of sales", 2), (1, "5%", "growth of units", 3), (1, "7x", "[garbled {context}", 4), (1, "none", "not a number here", 5), (2, "$5M", "repeated footer text", 6), (2, "$5m", "raised from angels", 7), (2, "9%", "", 8),
        (3, "1K", "Net Profit ÄÄ margin", 9), (3, "1K", "Net Profit margin of the year", 10),
    ]
    found = spark.createDataFrame(rows, "document_id long, value string, context string, n long")
    footer = spark.createDataFrame([(2, "repeated footer text"), (1, "raised from angels")], "document_id long, key string")
    got = {(r["document_id"], r["value"]): (r["context"], r["n"]) for r in documents.best_contexts(found, footer).collect()}
    assert got == {(1, "5%"): ("growth of sales", 2), (2, "$5m"): ("raised from angels", 7), (3, "1k"): ("Net Profit margin of the year", 10)}


def test_best_contexts_judge_whole_texts(spark, tmp_path):
    late = "x " * 4000 + "sales rose 88% now"
    rows = [(1, late), (51, "margin 88%"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["document_id"], r["value"]): (r["n"], r["context"]) for r in QUERIES["x24_best_contexts"](spark, str(tmp_path)).collect()}
    assert got == {(1, "88%"): (51, "margin 88%")}


def test_strip_boilerplate(spark):
    x = "See http://a.b/c or WWW.x.org, mail A.b@c.De or a@b, call 415 555-0100 or 1415555010099. ACME (Deck) here \\E end"
    got = spark.createDataFrame([(x,)], "x string").select(text.strip_boilerplate(F.col("x"), F.array(F.lit("acme (deck)"), F.lit("\\E end"))).alias("v")).first()["v"]
    assert got == "See or mail or a@b, call or 1415555010099. here"


def plain_condensed(t):
    from collections import Counter

    t = "\n".join(re.sub(r"[\t\v\f\r ]+$", "", x) for x in t.split("\n"))
    t = re.sub(r"\n{3,}", "\n\n", t).strip()
    for pattern in (r"(?s)<!--.*?-->", r"(?s)/\*.*?\*/", r"(?m)//.*$", r"(?m)--.*$", r"(?m)^(?!#\s)#[^#].*$"):
        t = re.sub(pattern, "", t)
    words = t.split()
    for gram, n in Counter(" ".join(words[i : i + 3]) for i in range(len(words) - 2)).items():
        if n >= 3 and len(gram) > 20:
            t = t.replace(gram, "".join(w[0] for w in gram.split(" ")[:2]).upper())
    return t


def test_condensed(spark):
    texts = ["", "a  \n\n\n\nb // c", "Quarterly revenue increased strongly. " * 5, "<!-- x\ny -->keep /* z */ this -- not\n# Title\n#tag"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1)
    assert [r["v"] for r in df.select(text.condensed(F.col("x")).alias("v")).collect()] == [plain_condensed(t) for t in texts]


def test_contexts(spark):
    doc, ask = "This is a long document. " * 400, "Extract facts from the document."
    r = cache.document_contexts(spark.createDataFrame([(1, doc, ask)], "id long, document string, instructions string")).first()
    assert len(r["document"]) < len(doc) and r["instructions"] == ask and 0 < r["reduction"] < 100
    facts, hypotheses = "Fact number one: " * 900, "This is a critical hypothesis\nthat must be true"
    rows = spark.createDataFrame([(facts, hypotheses, "\n".join(f"query {i}" for i in range(200)))], "facts string, hypotheses string, queries string")
    r = cache.analysis_contexts(rows).first()
    assert len(r["facts"]) <= 8000 + len(text.MARKER) and r["hypotheses"] == hypotheses and len(r["queries"].split("\n")) == 50
    empty = cache.document_contexts(spark.createDataFrame([(1, "", None)], "id long, document string, instructions string")).first()
    assert (empty["document"], empty["instructions"], empty["reduction"]) == ("", "", None)


def shorter(x):
    """Phrases of three words, in the order in which they first stand, replaced one after the other."""
    words, seen = re.split(r"\s+", x.strip()) if x.strip() else [], []
    phrases = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    for p in phrases:
        if p not in seen:
            seen.append(p)
            if phrases.count(p) >= 3 and len(p) > 20:
                x = re.sub(re.escape(p), (p.split(" ")[0][0] + p.split(" ")[1][0]).upper(), x)
    return x


def condensed(x, most):
    x = "\n".join(line.rstrip() for line in x.split("\n"))
    x = re.sub(r"\n{3,}", "\n\n", x).strip()
    for pattern in (r"<!--[\s\S]*?-->", r"/\*[\s\S]*?\*/", r"(?m)//.*$", r"(?m)--.*$", r"(?m)^(?!#\s)#[^#].*$"):
        x = re.sub(pattern, "", x)
    x = shorter(x)
    if len(x) <= most:
        return x
    cut = x[:most]
    stop = max(cut.rfind("."), cut.rfind("\n"))
    return (cut[: stop + 1] if stop > most * 0.8 else cut) + "\n[... truncated due to length ...]"


SAID = [
    "", "short", "quarterly revenue increased. " * 4, "alpha betagamma deltaepsilon " * 3 + "x", "a\n\n\n\nb  \n  c // gone\nd -- gone\n# kept\n#gone\n/* a\nb */e<!-- x -->",
    ("customers renewed contracts early and customers renewed contracts late; " * 9).strip(), "long sentence here. " * 40, "no stop at all " * 50, "tail\n" * 130,
]


@pytest.mark.parametrize("x", SAID)
def test_compression_equals_a_plain_version(spark, x):
    assert one(spark, x, text.abbreviate_repeats) == shorter(x)
    assert one(spark, x, lambda v: text.compress(v, 500)) == condensed(x, 500)


def test_compression_of_the_table(spark):
    """The registered queries over all turns."""
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}
    for name, plain in (("s54_compress", lambda x: condensed(x, 500)), ("s56_repeats", shorter)):
        got = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert {(r["conv_id"], r["turn"]): r["text"] for r in got} == {k: plain(v or "") for k, v in turns.items()}


def test_start_checks_of_deals_without_documents(spark):
    """As in the SQL: a deck is asked for where there are documents; documents without an id don't count; rows of a deal are one."""
    from quarry.operators import entities

    deals = spark.createDataFrame([(1, False), (2, False), (3, True), (3, True), (None, None), (None, None)], "id long, deleted boolean")
    documents = spark.createDataFrame([(10, 2, "legal"), (None, 2, "other"), (11, 3, "other")], "document_id long, deal_id long, type string")
    got = {(r["id"], r["documents"], r["decks"]): r["errors"] for r in entities.start_checks(deals, documents).collect()}
    assert got == {(1, 0, 0): ["a document is needed"], (2, 1, 0): ["a pitch deck is needed"], (3, 2, 2): ["the deal doesn't exist"], (None, 0, 0): ["a document is needed"]}
    assert entities.start_checks(deals, documents).count() == 4


def test_prerequisites_of_deals_without_documents(spark, tmp_path):
    """s39 (F2): a deal without documents lacks a document and a deck, as in the SQL."""
    import duckdb

    from quarry.plans.catalog import ORACLES

    spark.sql("SELECT * FROM VALUES (16L, 'a', 'BUILDING'), (17L, 'b', 'BUILDING'), (18L, 'c', 'X'), (19L, 'd', 'X'), (34L, 'e', 'X'), (CAST(NULL AS BIGINT), 'f', 'X') AS t(c_custkey, c_name, c_mktsegment)").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 18L, '1-URGENT', 'F', DATE '2024-01-01'), (2L, 19L, '2-HIGH', 'O', DATE '2024-01-02'), (3L, 34L, '4-LOW', 'O', DATE '2024-01-02') AS t(o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_orderdate)").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["s39_prerequisites"](spark, str(tmp_path)).select("errors", "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(ORACLES["s39_prerequisites"]).fetchall(), key=str) == [(0, 1), (1, 1), (2, 2), (3, 1), (None, 1)]


def test_citations_with_ties_are_the_same_in_any_order(spark):
    from quarry.operators import entities

    rows = [(1, 7, "2024-01-01", f"t{i}", e) for i, e in enumerate(["b", "a", None, "d", "c"])]
    own = [sorted(map(tuple, entities.citations(spark.createDataFrame(x, "deal_id long, evidence_id long, created_at string, text string, excerpt string").coalesce(1)).select("text").collect())) for x in (rows, rows[::-1], rows[2:] + rows[:2])]
    assert own[0] == own[1] == own[2] and len(own[0]) == 3


def test_condensing_holds_few_texts_at_once():
    import pyarrow as pa

    parts = text._slices(pa.array([f"t{i}" for i in range(1000)]))
    assert max(map(len, parts)) <= 64 and pa.concat_arrays(parts).to_pylist() == [f"t{i}" for i in range(1000)]
    assert [len(p) for p in text._slices(pa.array([], pa.string()))] == [0]
