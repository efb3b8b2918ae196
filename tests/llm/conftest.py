import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, `set` string, root int, label int, host string, kept int, base_failed string, host_rejected long, q_host string, q_n_words string, d_items string, d_text long, t_toxic string, t_text string, p_toxic string, `row` string, item string, at long, `a column` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    words = " ".join(f"w{k}" for k in range(40))
    long = " ".join(f"word{k % 9973} x{k}" for k in range(60_000))
    rows = [
        (1, words, "en", "a"), (2, words.upper(), "en", "a"), (3, words + " tail", None, None), (4, None, "en", "b"), (5, "", "en", "b"), (6, " \n\t ", "en", "b"),
        (7, long, "en", "a"), (8, "one two", "en", "a"), (9, "One  Two", "en", "a"), (10, "one two three", None, "c"), (None, words, None, None), (1, words, "en", "a"), (11, "Ünï\u00a0cödé 日本 <|endoftext|> don't 3.5kg", "de", "c"),
        (12, "\x00\x01 odd bytes " * 30, "en", "a"), (13, " ".join("abcdefghij"), "en", "a"),
    ]
    return spark.createDataFrame([(a, b, c, d, None, "p", "s", 1, 0, "h", 7, "b", 8, "q", "w", "i", 9, "t", None, "x", "r", "e", 10, "c") for a, b, c, d in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)
