"""The corpus pipeline: five of the operators as stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, minhash, mixing, quality, suffixes
from tessella.llm.common import discard, small_batches, stored, table

#: Strings of `window` bytes that repeat are cut out: passages of 50 words take some 300 bytes, 250 at the least. The
#: grams by which texts are cut keep their share of the window.
REPEATED = {"window": 250, "gram": 80, "core": 220}


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the labels of docs."""
    small_batches(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    small_batches(spark)
    return minhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out strings of 250 bytes and more that repeat. Documents of which nothing is left stay, with an empty text."""
    small_batches(spark)
    return suffixes.cleaned(docs, **REPEATED)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's weight asks for: a document may be in no row, in one or in two."""
    small_batches(spark)
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of them and of the bytes that they decode to."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("doc_id", "source"), ids=True)


STAGES = [("quality classifier", good), ("MinHash near-dedup", one_of_each), ("suffix-array dedup", without_repeats), ("mixing sources", mixed), ("byte-level BPE", encoded)]

#: No SQL can express the trained classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
            discard(last)
    return docs
