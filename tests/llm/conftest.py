import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of texts; ids count from 0 unless given."""

    def make(texts, ids=None, lang="en"):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)

    return make


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
