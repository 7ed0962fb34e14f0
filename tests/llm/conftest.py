import random

import pytest

#: Names that operators might use for columns of their own.
EXTRA = ("n", "id", "h", "g", "m", "fp", "src", "pos", "d", "label", "rep", "part", "host", "path", "kept", "copies", "w", "key", "x", "rank")


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) as documents, with columns whose names clash with operators' own."""

    def run(rows, source=lambda i: f"src{(i or 0) % 3}"):
        kind = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, "en", source(i), len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, kind)
        for c in EXTRA:
            df = df.withColumn(c, df.text)
        return df

    return run


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a very long one, ties, repeated rows, a null id."""
    rng = random.Random(3)
    base = prose(rng, 120)
    long = prose(rng, 60_000, 5000)
    return [(1, base), (2, None), (3, ""), (4, long), (5, base), (5, base), (6, " \n\t "), (None, base), (7, prose(rng, 3)), (8, "MIT License, apache  LICENSE")]
