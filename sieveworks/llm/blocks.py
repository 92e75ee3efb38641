"""Answers that travel by block of documents instead of by document.

Operators that must know what other documents hold (lines, passages) deal the
documents into blocks by a hash of their id, ask about the distinct keys of each
block, and bring the answers back to the block. A key that a third of all
documents share is then one row for each block, never one for each document, and
no task ever holds all rows of a key's documents. Blocks are a fixed number for
each shuffle partition, so both grow with the input. They are numbered so that
Spark's hash deals the same number of them to every partition.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import partitions, prepare

#: Blocks for each shuffle partition.
SPLIT = 1
#: Name of the column that holds a document's block; of the documents' own columns only those named are carried, under names of their own.
BLOCK = "__block"


def partition_of(numbers: np.ndarray, n: int) -> np.ndarray:
    """Of each int, the one of ``n`` partitions that Spark's hash partitioning sends it to (32-bit Murmur3, seed 42)."""
    with np.errstate(over="ignore"):
        turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        k = turn(numbers.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64) % n


@cache
def labels(n: int, split: int) -> tuple[int, ...]:
    """``split`` numbers for each of ``n`` partitions, the one's after the other's, which Spark's hash sends there."""
    size = 4 * n * split + 64
    while True:
        at = partition_of(np.arange(size, dtype=np.int64), n)
        order = np.argsort(at, kind="stable")
        begin = np.searchsorted(at[order], np.arange(n + 1))
        if (np.diff(begin) >= split).all():
            return tuple(order[(begin[:-1, None] + np.arange(split)).ravel()].tolist())
        size *= 2


def block_of(key: Column, n: int, split: int) -> Column:
    """The block of a row by the hash ``key``, so that each of ``n`` partitions gets ``split`` blocks."""
    known = F.lit(list(labels(n, split))).cast("array<int>")
    return F.get(known, F.pmod(key, F.lit(n * split)).cast("int"))


def into_blocks(docs: DataFrame, *columns: str, split: int = SPLIT) -> DataFrame:
    """The given columns of ``docs`` and the block, dealt out by it. Rows without an id go by their text."""
    prepare(docs.sparkSession)
    n = partitions(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.xxhash64(F.col("doc_id").cast("long")), F.xxhash64("text")))
    return docs.select(*columns, block_of(key, n, split).alias(BLOCK)).repartition(n, BLOCK)
