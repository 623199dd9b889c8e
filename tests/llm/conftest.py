import random

import pytest

#: Extra columns whose names the operators use for columns of their own.
EXTRA = "hash string, n long, row_id long, words string, key string, place int, label int"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, odd white space, clashing names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, twin = text(9000), text(60)
    texts = ["", " ", None, "one", "One\tTWO\x0bthree", "a\x1cb\x85c d", twin, twin, twin.replace("alpha", "omega", 1), long, long, text(5000), "x" * 30000, "tab\tand\nline\r\n end", "中文 字 <|endoftext|> x"]
    texts += [text(rng.randint(1, 120)) for _ in range(40)]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id here at all", "en", "src1", 17), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'h' as hash", "1L as n", "2L as row_id", "'w' as words", "'k' as key", "3 as place", "4 as label").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, hard_docs):
    return hard_docs.where("false")
