"""Boundary rows of the rules, as literals."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import numbers, text
from quarry.operators import cache, client, rules

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("score", "documents", "stage", "evidence", "points"), [(49, 0, "intake", 0, 0), (50, 1, "intake", 1, 21), (60, 2, "under_review", 2, 42), (70, 3, "in_diligence", 3, 68), (80, 4, "ready_decision", 5, 98), (80, 5, "pitched", 6, 100), (None, 4, "pitched", 5, 60)])
def test_priority_points(spark, score, documents, stage, evidence, points):
    assert value(spark, rules.priority_points(L(score).cast("long"), L(documents), L(stage), L(evidence))) == points


@pytest.mark.parametrize(("points", "name"), [(39, "low"), (40, "medium"), (69, "medium"), (70, "high")])
def test_priority(spark, points, name):
    assert value(spark, rules.priority(L(points))) == name


@pytest.mark.parametrize(("summary", "headings", "metrics", "score"), [(19, 0, 0, 0), (20, 1, 1, 50), (99, 2, 3, 50), (100, 3, 5, 100)])
def test_ingest_completeness(spark, summary, headings, metrics, score):
    assert value(spark, text.ingest_completeness(L(summary), L(headings), L(metrics))) == score


@pytest.mark.parametrize(("summary", "headings", "metrics", "score"), [(0, 1, 0, 0), (1, 2, 1, 40), (99, 4, 2, 40), (100, 5, 3, 80), (300, 5, 3, 100)])
def test_data_completeness(spark, summary, headings, metrics, score):
    assert value(spark, text.data_completeness(L(summary), L(headings), L(metrics))) == score


@pytest.mark.parametrize(("mean", "grade"), [(74.9, "fail"), (75.0, "warn"), (89.9, "warn"), (90.0, "pass")])
def test_ocr_grade(spark, mean, grade):
    assert value(spark, text.ocr_grade(L(mean))) == grade


@pytest.mark.parametrize(("overall", "status"), [(0.499, "failed"), (0.5, "warnings"), (0.799, "warnings"), (0.8, "verified")])
def test_verification_status(spark, overall, status):
    assert value(spark, text.verification_status(L(overall))) == status


@pytest.mark.parametrize(("x", "score"), [("", 0), ("a" * 49, 60), ("word " * 12, 100), ("#@~" * 30, 50)])
def test_coherence(spark, x, score):
    assert value(spark, text.coherence(L(x))) == score


@pytest.mark.parametrize(("n", "source", "confidence", "cycle", "errors"), [(9, "deck.pdf", 0.5, 1, 1), (10, "uncertain", 0.0, 3, 0), (200, "http://x", 1.0, 1, 0), (201, "other.pdf", 1.01, 4, 4), (50, "deck.pdf", -0.01, 0, 2)])
def test_fact_errors(spark, n, source, confidence, cycle, errors):
    assert len(value(spark, rules.fact_errors(L("x" * n), L(source), L(confidence), L(cycle)))) == errors


@pytest.mark.parametrize(("name", "company"), [("PD - Acme Labs - Deck.pdf", "Acme Labs"), ("Acme Raise v2.pptx", "Acme"), ("Dyna Deck.pdf", "Dyna Deck"), ("notes v6 (v2).docx", "notes"), (".pdf", "Unknown")])
def test_company(spark, name, company):
    assert value(spark, text.company(L(name))) == company


@pytest.mark.parametrize(("x", "numeric"), [("42", False), ("42%", True), ("$5", True), ("3-4", True), ("1.5x", True), ("", False)])
def test_numeric_value(spark, x, numeric):
    assert value(spark, text.is_numeric_value(L(x))) is numeric


@pytest.mark.parametrize(("x", "garbled"), [("Annual recurring revenue", False), ("", True), ("x" * 91, True), ("a b c d e f g hi", True), ("[Revenue growth]", True)])
def test_garbled(spark, x, garbled):
    assert value(spark, text.is_garbled(L(x))) is garbled


def test_sanitize(spark):
    assert value(spark, text.sanitize(L(" a\x00b\x07c  \t d\n"))) == "ab c d"
    assert value(spark, text.sanitize_nullable(L("\x00 \t"))) is None


def test_half_up_and_ratio(spark):
    assert value(spark, numbers.half_up(L(2.5))) == 3.0
    assert value(spark, numbers.ratio(L(1), L(0), 2)) is None


def test_truncate_prefers_a_stop(spark):
    assert value(spark, text.truncate(L("a" * 90 + ". " + "b" * 50), 100)) == "a" * 90 + "." + text.MARKER
    assert value(spark, text.truncate(L("short"), 100)) == "short"


def test_summarize_lines_keeps_the_bound(spark):
    out = value(spark, text.summarize_lines(L("\n".join(map(str, range(100)))), 50)).split("\n")
    assert len(out) == 50
    assert out[0] == "0"


def test_repeats_become_initials(spark):
    assert value(spark, text.abbreviate_repeats(L("quarterly revenue increased and " * 3))).count("QR") >= 2


def test_bucket(spark):
    def expected(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch) + 2**31) % 2**32 - 2**31
        return abs(h) % 100

    for s in ("", "user-1", "a longer user id 123456"):
        assert value(spark, text.bucket_31(L(s))) == expected(s)


def test_cache_replay_expires(spark):
    rows = [("k", "2024-01-01", True, 1), ("k", "2024-01-08", True, 2), ("k", "2024-01-08 00:00:01", True, 3), ("k", "2024-01-09", False, 4)]
    df = spark.createDataFrame(rows, "key string, at string, eligible boolean, id long").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {r["id"]: r["outcome"] for r in cache.replay(df).collect()}
    assert got == {1: "miss", 2: "hit", 3: "miss", 4: None}


def test_revenue_and_grade(spark):
    assert value(spark, client.revenue(L("$1,250,000"))) == 1250000.0
    assert value(spark, client.revenue(L(None).cast("string"))) == 0.0
    assert value(spark, rules.grade(L(55))) == "Fair"


def form(spark, **fields):
    return spark.createDataFrame([tuple(fields.get(f) for f in client.FORM_FIELDS)], ", ".join(f"{f} string" for f in client.FORM_FIELDS))


@pytest.mark.parametrize(
    ("fields", "scores"),
    [
        ({}, [0, 40, 0, 0, 30, 50]),
        ({"revenue": "n/a", "customers": "many", "team_size": "few"}, [0, 40, 0, 0, 70, 50]),
        ({"revenue": "$0", "customers": "0", "team_size": "2"}, [0, 40, 0, 0, 30, 50]),
        ({"revenue": "100000", "customers": "1", "team_size": "5", "growth_rate": "9%"}, [20, 40, 30, 100, 70, 50]),
        ({"revenue": "$1,000,001", "team_size": "6 people", "company_name": "A", "founder_experience": "x", "funding_amount": "1", "previous_funding": "1"}, [40, 100, 100, 40, 55, 50]),
        ({"industry": "a", "stage": "b", "target_market": "c", "funding_amount": "d", "revenue": "1", "unique_value": " ", "competitive_advantage": "x"}, [100, 40, 50, 40, 45, 100]),
    ],
)
def test_category_scores(spark, fields, scores):
    row = client.overall(client.category_scores(form(spark, **fields))).first()
    assert [row[x] for x in client.CATEGORIES] == scores
    assert row["overall"] == int(sum(scores) / 6 + 0.5)


def test_flags_and_wins(spark):
    scored = client.category_scores(form(spark, stage="Pre-Seed", team_size="1", competitive_advantage="x"))
    row = scored.select(client.red_flags().alias("red"), client.green_flags().alias("green"), client.quick_wins().alias("wins")).first()
    assert [f["severity"] for f in row["red"]] == ["medium", "medium"] and row["green"] == []
    assert [(w["category"], w["effort"]) for w in row["wins"]] == [("market", "medium"), ("team", "low"), ("financial", "low")]


@pytest.mark.parametrize(("round_type", "stage", "dollars", "hours"), [("seed", "growth", 22000, 85), (None, None, 33000, 128), ("series-d", "scale", 49500, 191), ("other", "other", 22000, 85)])
def test_savings(spark, round_type, stage, dollars, hours):
    money, time = rules.savings(L(round_type).cast("string"), L(stage).cast("string"))
    assert (value(spark, money), value(spark, time)) == (dollars, hours)


@pytest.mark.parametrize(("brier", "grade", "points"), [(0.09, "excellent", 100), (0.1, "good", 95), (0.2, "acceptable", 85), (0.3, "poor", 80), (None, "poor", 80)])
def test_ledger_quality(spark, brier, grade, points):
    b = L(brier).cast("double")
    assert value(spark, rules.calibration_grade(b)) == grade
    assert value(spark, rules.ledger_quality(L(0.9), b)) == points


@pytest.mark.parametrize(("model", "price"), [("qwen-14b", 0.02), ("qwen-7b-quantized", 5.0), ("llama-70b", 0.05), ("gpt-4o", 5.0), (None, 5.0)])
def test_model_price(spark, model, price):
    assert value(spark, cache.model_price(L(model).cast("string"))) == price


def test_cache_key(spark):
    import hashlib

    for model, temperature, tail in ((None, None, "default:0.7"), ("m", 0.0, "m:0.7"), ("m", 0.2, "m:0.2"), ("", 1.0, "default:1")):
        key = value(spark, cache.cache_key(L("h"), L("t"), L(model).cast("string"), L(temperature).cast("double")))
        assert key == hashlib.sha256(f"h:t:{tail}".encode()).hexdigest()


def test_prerequisites_give_both_errors(spark):
    assert len(value(spark, rules.prerequisite_errors(L(True), L(0), L(0)))) == 2
    assert len(value(spark, rules.prerequisite_errors(L(True), L(2), L(0)))) == 1


@pytest.mark.parametrize(("when", "bucket"), [("5 minutes ago", "today"), ("Today, 9:00", "today"), ("just now", "today"), ("5 min", "this week"), ("Yesterday, 4:22 PM", "yesterday"), ("yesterday", "this week")])
def test_notification_bucket(spark, when, bucket):
    assert value(spark, client.notification_bucket(L(when))) == bucket
