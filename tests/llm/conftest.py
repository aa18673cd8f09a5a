"""Small fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from {doc_id: text} or [(doc_id, text)], with clashing extra columns."""
    def build(texts, extra: bool = False):
        pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("score", "predicted", "sid", "comp", "n", "b", "key", "start", "value", "item_id", "text_hash", "length", "path", "label"):
                df = df.withColumn(c, F.lit(f"extra {c}"))
        return df
    return build


@pytest.fixture(scope="session")
def awkward():
    """Texts with nulls, empties, blanks, ties, repeats and one long text, by id (None = no id)."""
    rng = random.Random(5)
    long_text = " ".join(words(rng, 60_000, 5000))
    base = " ".join(words(rng, 40))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, base), (6, base), (6, base), (7, base + " tail"),
            (8, long_text), (9, "Ünïcödé 文字 " * 30), (None, base), (10, "x" * 5000)]
