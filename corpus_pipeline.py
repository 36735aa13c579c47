"""The corpus pipeline: quality rules, quality classifier, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame that is written and
read again before the next one. All but the last return the columns of ``documents``.

In every stage texts may be null, empty or of any length and ids null; repeated rows, extra columns of any name and empty tables are
handled as each stage says. No stage changes a column but the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inboxlake.llm import factorisation, packing, quality_rules, simhash, suffix_dedup
from inboxlake.llm.common import bounded
from inboxlake.llm.queries import table, tokenizer
from inboxlake.sources.tables import settled, workspace


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list rejects go, and with them null, empty and very short texts. Repeated rows are judged each."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below 0.3 go. Repeated rows are judged each; a null text is scored as an empty one."""
    return factorisation.keep_likely(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id (null first). Empty and null texts have empty sets and are one group of equals."""
    bounded(spark)
    return simhash.keep_one(docs, workspace(spark))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that start anywhere else too are cut out of the texts, repeated rows' texts whole; all rows stay."""
    bounded(spark)
    return suffix_dedup.without_repeats(docs, workspace(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens, with their ids; a null or empty text is its end token alone."""
    bounded(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", passages),
    ("packing", packed),
]

#: Learned models and suffix arrays are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = workspace(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, folder, f"stage-{k}")
    return docs
