import random

import pytest


@pytest.fixture()
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


#: Texts that every operator on documents must take.
EDGE_TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two"), (6, "ONE two"), (7, "é ü 中文 😀 ́"), (8, "x" * 50_000), (9, "word " * 20_000), (10, "same text of seven words in all"), (11, "same text of seven words in all"), (None, "no id"), (11, "same text of seven words in all")]
