import pytest
from pyspark.sql import functions as F

from inboxlake.functions import language as op

CASES = [
    ("hola, gracias por todo", "brand_en", "es"),
    ("hello, please help with my link", "brand_es", "en"),
    ("não consigo abrir, bom dia", "brand_en", "pt"),
    ("ciao, vorrei il file, grazie", "brand_es", "it"),
    ("ich habe das nicht", "brand_es", "de"),
    ("hola please", "brand_it", "it"),  # a tie goes to the brand
    ("gracias", "brand_en", "en"),  # one vote is not enough
    (None, "brand_de", "de"),
    ("", None, "es"),
    ("xyz", "other", "es"),
    ("¿Cómo ¿Cómo", "brand_en", "es"),  # a word that carries the sign is no list word, the sign votes
    ("Está isso", "brand_en", "pt"),  # está votes for both es and pt
    ("mi mi mi", "brand_en", "en"),  # es and it tie with two votes each
]


@pytest.mark.parametrize("text,brand,expected", CASES)
def test_language(spark, text, brand, expected):
    df = spark.createDataFrame([(text, brand)], "text string, brand string")
    assert df.select(op.detect_language(F.col("text"), F.col("brand"))).first()[0] == expected


def naive_votes(text):
    """One split per list word, as a check that shares nothing with the column form."""
    import re

    t = " " + re.sub(f"[^{op.LETTERS}]+", " ", (text or "").lower()) + " "
    result = {}
    for lang, words in op.WORDS.items():
        patterns = [f" {w} " for w in words.split()] + list(op.SEQUENCES.get(lang, ()))
        result[lang] = sum(len(t.split(p)) - 1 for p in patterns)
    return result


def test_votes_against_splits(spark):
    texts = [
        "la la la", "la la la la", "bom dia bom dia bom dia", "el la el la la", " ¿que? ¡no! ", "the  the, The", "é está está",
        "no no no no no the the", "mi ma mi ma ma ma",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counted = df.select("text", op.bound(op.normalize(F.col("text")), op.votes).alias("v"))
    for row in counted.collect():
        assert row["v"].asDict() == naive_votes(row["text"]), row["text"]


def test_brands_are_an_argument(spark):
    df = spark.createDataFrame([("", "mine")], "text string, brand string")
    assert df.select(op.detect_language(F.col("text"), F.col("brand"), {"mine": "pt"})).first()[0] == "pt"
