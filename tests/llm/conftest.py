import random

import pytest

SCHEMA = "doc_id long, text string, rest string, n_words int, score string, key int, shard int, kept boolean, component int, ids string, rule int"


def word(draw: random.Random) -> str:
    return "".join(draw.choice(["an", "ber", "cho", "du", "es", "fi", "gra"]) for _ in range(draw.randint(1, 3)))


def prose(draw: random.Random, n: int) -> str:
    return " ".join(word(draw) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows, and extra columns whose names operators use too."""
    draw = random.Random(5)
    texts = [None, "", " \t\n", "one", prose(draw, 40), prose(draw, 40), prose(draw, 9_000), "x" * 30_000, "é ü 日本語 😀 \u00a0 \x1c end", "THE!! END!! " * 20]
    rows = [(i, t, "r", 1, "s", 2, 3, True, 4, "i", 5) for i, t in enumerate(texts)]
    rows += [(None, texts[4], None, None, None, None, None, None, None, None, None), (None, None, *[None] * 9), rows[4], rows[4], (77, texts[4], *rows[4][2:])]
    rows += [(100, texts[6] + " changed", *rows[4][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "steps")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 1), (9, 0), (None, 0), (6, None), (3, 0)], "doc_id long, quality int")
