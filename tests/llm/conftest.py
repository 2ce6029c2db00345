import random

import pytest

EXTRA = {"lang": "xx", "key": 1, "id": 7, "fp": 3, "start": 5, "n": 2, "rep": 1, "size": 9, "first": 0}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A maker of documents tables from (doc_id, text) or longer rows."""

    def make(rows, extra=False):
        full = [(r + ("en", "a", None))[:5] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame([(a, b, c, d, len(b) if b is not None else None) for a, b, c, d, _ in full], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({k: F.lit(v) for k, v in EXTRA.items() if k not in df.columns})
        return df

    return make


@pytest.fixture()
def rng():
    return random.Random(5)


WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "x", "été", "straße", "日本"]


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
