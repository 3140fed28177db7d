import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, shard int, fp long, tokens long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and clashing names."""
    rng = random.Random(4)
    prose = " ".join("".join(rng.choices("abcde", k=rng.randrange(2, 7))) for _ in range(60))
    long_text = " ".join("".join(rng.choices("fghij", k=5)) for _ in range(30_000))
    texts = [
        (1, prose), (2, prose), (2, prose), (3, prose + " end"), (None, prose), (None, None), (4, None), (5, ""), (6, " \n\t "), (7, long_text),
        (8, "é ß ñ Ünïcode ÀÉ"), (9, "Licensed under the Apache License, Version 2.0."), (10, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" here"),
        (11, "x"), (12, "one two"), (13, "💥 emoji 💥 words"),
    ]
    rows = [(i, t, ["en", None, "fr"][k % 3], None if k % 4 else "src0", None, 0.5, "w", 3, 1, None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark, tables):
    return lambda name: spark.read.parquet(f"{tables}/{name}.parquet")
