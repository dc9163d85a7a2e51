"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and gives the next one's documents.

All stages but the last return the columns of what they are given, whatever else those hold or are called; an empty table stays empty.  Texts of any
length are handled whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clausewright.llm import bpe, decontaminate, minhash, quality, suffix_dedup
from clausewright.llm.common import durable, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects.  Null and empty texts have too few words and go; repeated rows (ties) fare alike."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, similarity 0.8.  It is the one of the least key; of rows that agree in key
    and text one stays, a row with a null key only where its component has no other, rows without words are components of their own."""
    return minhash.keep_one(docs, width=5, similarity=0.8)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of 200 bytes and more cut out, the first kept, in the order of key, text hash and place.  Null texts stay null, rows
    that agree in key and text lose the same bytes, a character cut in part goes whole, a text may become empty."""
    return suffix_dedup.clean(docs, least=200)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.  Null and empty texts and items match nothing; each row is judged by itself, so repeated rows fare alike."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and the digests of ids and decoded bytes, a row for each row.  A null text counts as empty."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.encode(docs, path, pattern, decoded=True), path, pattern)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeated_strings", repeated_strings), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: The stages on suffixes and tokens can't be put in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
