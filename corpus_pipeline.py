"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns what the next one gets. All but the last return the columns of documents.
Columns may have any further names; nulls may stand in any column; empty tables give empty tables. Long texts are whole everywhere.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm._common import materialise, table
from weftline.llm.bpe import encode
from weftline.llm.exact_dedup import drop_duplicates
from weftline.llm.mixing import mix
from weftline.llm.simhash import drop_near_duplicates
from weftline.llm.toxicity import drop_toxic

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject. Null and empty texts match nothing and stay; repeated rows are judged alike; null ids are never learned from."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal ones (null is empty): the row with the largest id, the first stored of ties; null ids lose to others."""
    return drop_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, a similarity of 0.8 or more): the row with the smallest id, the first stored of ties, null ids last.

    Texts without words, null ones among them, are one group.
    """
    return drop_near_duplicates(docs, words=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole. Texts without words are never taken; the null source is a source of its own; repeated rows are dealt apart."""
    return mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document in place of its text, with the digests of the round trip. Null and empty texts have no ids; each row is encoded for itself."""
    return encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: SQL can express neither the learned grammar nor SimHash; each stage is tested against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
