"""Corpus pipeline: five stages of the training-data operators over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the columns of
documents, for the rows that they keep.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import decontaminate, langid, minhash, sentencepiece_bpe, suffix_dedup
from veilspark.llm.runtime import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them), or whose language is uncertain, go.

    The model is learned from the rows of docs that have a lang; without any, every
    document goes. Repeated rows are judged alike. Texts are read whole.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity 0.8) the document of the least doc_id stays.

    Null and blank texts have no duplicates and stay, as do rows without a doc_id; rows
    of one doc_id are one document and stay or go together.
    """
    return minhash.keep_one(docs, shingle=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that start in an earlier document go; documents stay, however short.

    Null texts stay null; a text of repeats alone becomes empty. Rows of one doc_id don't remove each other's bytes.
    """
    return suffix_dedup.remove_repeats(docs, length=50)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; documents that are mostly benchmark go whole.

    Null and empty texts are untouched, and so is every document if the benchmark is empty.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the text decoded from them; null text counts as empty, repeated rows each give a row."""
    return sentencepiece_bpe.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("benchmark decontamination", remove_benchmark),
    ("SentencePiece encoding and decoding", encode),
]

#: No SQL expresses the naive Bayes model and the tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
