"""A corpus pipeline of five stages over ``documents``: each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage's result is written as Parquet to the shared folder and read again as
the next one's input. All but the last return the columns of ``documents``, more
columns of any name included. In every stage a null text counts as empty, rows of
one id are judged each by its text, rows without an id never stand for others, and
empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveworks.llm import byte_bpe, decontaminate, language_id, line_dedup, ngram_jaccard
from sieveworks.llm.common import saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents told as ``und`` go: those without a letter (all, if no row is labelled). No score threshold is set, so junk with a letter passes."""
    return language_id.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten letters or more that a document of smaller id holds go; the document stays, with what is left of it. Of equal ids none is earlier."""
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id, in all of its rows. Rows without an id stay."""
    return ngram_jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go; documents of which they are more than half of the words go whole. Null items have no passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as counts and digests, with the digest of what they decode to."""
    import public_tokenizers as vocabularies

    # the executors' workers still hold what earlier stages took, so texts are encoded in small slices
    return byte_bpe.report(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN, size=1 << 18)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark),
    ("byte_bpe", tokens),
]

#: Trained networks and BPE ids are beyond SQL; a test holds each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
