import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, repeats, ties, a very long text and columns that clash with inner names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    text = lambda k, n=40: " ".join(words[(k * 7 + i * (k % 5 + 1)) % len(words)] + (f"{k}" if i % 3 == 0 else "") for i in range(n))
    rows = [(k, text(k), "en", f"s{k % 3}") for k in range(30)]
    rows += [(30, None, "en", "s0"), (31, "", None, None), (32, " \t\n ", "en", "s1"), (None, text(3), "en", None), (33, text(4), "en", "s0"), (33, text(4), "en", "s0"), (34, "word " * 60_000, "en", "s2"), (35, text(5).upper(), "en", "s1")]
    return spark.createDataFrame([(a, b, c, d, 1, "x", 0.5, "k") for a, b, c, d in rows], "doc_id long, text string, lang string, source string, n int, words string, score double, key string")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
