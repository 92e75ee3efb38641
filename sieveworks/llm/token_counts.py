"""Token counts: pieces are counted once per distinct pre-token and summed over per-document pre-token frequencies.

Each task lists the pre-tokens of its batch by document with their frequencies,
counts the pieces of those it has not met yet (once; the table of counts lives
as long as the task and is bounded), joins the counts to the frequencies and sums. No ids
are kept and nothing is shuffled, so the work of a lost executor is its batches'.

A pre-token is a stretch without white space: the tokenizer drops white space
and neither its normaliser, its added tokens nor its split pattern reach across
it, so the counts of stretches add up to the count of the text.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows of a
repeated id are each counted; a null ``doc_id`` stays null.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import prepare, texts_of

LIMIT = 2048
#: Pre-tokens whose counts a task keeps.
KEPT = 400_000
#: White space for the tokenizer's normaliser; Python's own split also takes U+001C-U+001F.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f]")


class PieceCounts(dict):
    """Pre-token -> number of pieces, filled by the tokenizer for many new pre-tokens at once."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def learn(self, words: set[str]) -> None:
        if len(self) > KEPT:
            self.clear()
        new = [w for w in words if w not in self]
        for begin in range(0, len(new), 20_000):
            part = new[begin : begin + 20_000]
            self.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))


def pre_tokens(text: str) -> list[str]:
    return text.split() if not ODD.search(text) else [x for x in SPACE.split(text) if x]


def count(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: bytes, tokens, and whether the tokens are more than ``limit``."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(vocabulary)
        for batch in rows:
            texts = texts_of(batch)
            frequencies = [Counter(pre_tokens(x.decode())) for x in texts]
            counts.learn(set().union(*frequencies))
            totals = np.fromiter((sum(map(int.__mul__, map(counts.__getitem__, f), f.values())) for f in frequencies), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(totals), pa.array(totals > limit)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
