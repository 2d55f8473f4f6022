"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from podium.llm import bpe, decontam, quality, simhash, suffixes
from podium.llm.common import cut, read
from podium.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the rated ones, does not reject."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies: 0.8 of the shingles of five words in common."""
    return simhash.one_of_each(docs, shingle=5, similarity=(4, 5))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the strings that stand elsewhere in what is left of the corpus."""
    return suffixes.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, also not with other names and numbers."""
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's token ids, with digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokenized),
]

#: No SQL: the stages learn, hash and tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
