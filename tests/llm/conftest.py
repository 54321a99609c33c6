import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, odd white space and special strings."""
    long = "word and another " * 12_000
    return [
        (0, "one two three four five six seven"), (1, None), (2, ""), (3, "   \n\t "), (4, long), (5, "one two three four five six seven"), (5, "one two three four five six seven"),
        (6, "a"), (7, "a b"), (None, "orphan text of some words"), (8, "<|endoftext|> in  the   middle <s>"), (9, "  é ß 日本語\u3000x \x1c y"), (9, "another text under the same id"), (10, "\x00 nul"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)
    for name in ("key", "n", "score", "label", "node", "component_id", "digest", "kind", "start"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
