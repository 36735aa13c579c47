"""Queries of language detection, over whole documents and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from inboxlake.constants import BRAND_LANGS, DEFAULT_LANG
from inboxlake.functions import language as op
from inboxlake.plans.registry import query


def normal_sql(text: str) -> str:
    return f"(' ' || regexp_replace(lower(coalesce({text}, '')), '[^{op.LETTERS}]+', ' ', 'g') || ' ')"


def count_sql(normal: str, lang: str) -> str:
    """Occurrences that do not overlap, from the length that goes when they are removed."""
    patterns = [f" {word} " for word in op.WORDS[lang].split()] + list(op.SEQUENCES.get(lang, ()))
    return " + ".join(f"(length({normal}) - length(replace({normal}, '{p}', ''))) // {len(p)}" for p in patterns)


def votes_sql(text: str) -> str:
    normal = normal_sql(text)
    return ", ".join(f"cast({count_sql(normal, lang)} as int) as votes_{lang}" for lang in op.WORDS)


def winner_sql(brand: str) -> str:
    default = f"case {brand} " + " ".join(f"when '{b}' then '{l}'" for b, l in BRAND_LANGS.items())
    default += f" else '{DEFAULT_LANG}' end"
    whens = []
    for lang in op.WORDS:
        others = ", ".join(f"votes_{other}" for other in op.WORDS if other != lang)
        whens.append(f"when votes_{lang} >= 2 and votes_{lang} > greatest({others}) then '{lang}'")
    return "case " + " ".join(whens) + f" else {default} end"


@query("D01a_normalized_text", f"select doc_id, {normal_sql('text')} as normalized from documents")
def _(t):
    return t.documents.select("doc_id", op.normalize(F.col("text")).alias("normalized"))


@query("D01b_language_votes", f"select doc_id, {votes_sql('text')} from documents")
def _(t):
    counted = t.documents.select("doc_id", op.bound(op.normalize(F.col("text")), op.votes).alias("votes"))
    return counted.select("doc_id", *[F.col("votes")[lang].alias(f"votes_{lang}") for lang in op.WORDS])


_MESSAGE_VOTES = f", counted as (select id, brand, {votes_sql('text')} from messages)"


@query("D01c_language_winner", f"{_MESSAGE_VOTES} select id, {winner_sql('brand')} as lang from counted")
def _(t):
    return t.messages.select("id", op.detect_language(F.col("text"), F.col("brand")).alias("lang"))


@query(
    "D01_language",
    f", counted as (select doc_id, {votes_sql('text')} from documents) select doc_id, {winner_sql('null')} as detected from counted",
)
def _(t):
    return t.documents.select("doc_id", op.detect_language(F.col("text"), F.lit(None).cast("string")).alias("detected"))
