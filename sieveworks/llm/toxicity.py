"""Toxicity with a factorization machine over hashed terms.

score = sigmoid(b + sum w_t + sum over pairs <v_t, v_u>) over the distinct terms
of a text, so a pair (an insult and a mention of a group) can count for more than
its two words. The pair sum is ((sum v)^2 - sum v^2) / 2, linear in the terms.

Fitting takes at most ``SAMPLE`` labelled rows (a documented bound: those of least
hash of their id, so the sample does not depend on the layout of the files);
scoring takes every whole text, in batches, with a model of fixed size.

Defined results: a null text counts as empty and scores the model's base rate;
repeated rows are each scored; rows with a null ``doc_id`` are scored, never
learned from; without labels to learn from every text scores 0.001.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import WordHashes, prepare, texts_of

SAMPLE = 12_000
BITS = 18
RANK = 4
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A-Z in lower case, bytes outside words to spaces; all bytes from 0x80 belong to words.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass
class Machine:
    """Bias, weights and factors by hashed term."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, terms: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log odds of texts; ``terms`` of text i start at begin[i], and each text has at least one (a padding term 0)."""
        if not len(begin):
            return np.zeros(0)
        v = self.factor[terms]
        total, square = np.add.reduceat(v, begin), np.add.reduceat(v * v, begin)
        return self.bias + np.add.reduceat(self.weight[terms], begin) + 0.5 * (total * total - square).sum(1)


def terms_of(text: bytes, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Distinct hashed terms; term 0 is in every text and never learned."""
    words = hashes.of(list(set(text.translate(NORMAL).split())))
    return np.unique(np.concatenate(([0], (words >> np.uint64(64 - bits)).astype(np.int32)))).astype(np.int32)


def fit(samples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, rank: int = RANK, epochs: int = 12, rate: float = 0.1, decay: float = 1e-3, tested: float = 24.0) -> Machine:
    """Adagrad on the logistic loss, one text after another in a fixed random order.

    Only terms whose chi-square with the label is at least ``tested`` are learned:
    of a hundred thousand terms without any bearing on it, fewer than one is.
    """
    random = np.random.default_rng(7)
    size = 1 << bits
    every, bad = np.zeros(size), np.zeros(size)
    for x, label in zip(samples, labels, strict=True):
        every[x] += 1
        bad[x] += label
    n, positive = len(labels), float(labels.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (bad * (n - positive) - (every - bad) * positive) ** 2 / (every * (n - every) * positive * (n - positive))
    known = np.nan_to_num(chi, nan=0.0, posinf=0.0) >= tested
    known[0] = False
    samples = [x[known[x]] for x in samples]
    weight, factor = np.zeros(size), np.where(known[:, None], random.normal(0, 0.01, (size, rank)), 0.0)
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    for _ in range(epochs if len(labels) else 0):
        for i in random.permutation(len(samples)):
            t = samples[i]
            v = factor[t]
            total = v.sum(0)
            z = bias + weight[t].sum() + 0.5 * float((total * total - (v * v).sum(0)).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            dw = g + decay * weight[t]
            gw[t] += dw * dw
            weight[t] -= rate * dw / np.sqrt(gw[t])
            if len(t) > 1:
                dv = g * (total - v) / len(t) + decay * v
                gv[t] += dv * dv
                factor[t] = v - rate * dv / np.sqrt(gv[t])
    return Machine(bias, weight.astype(np.float32), factor.astype(np.float32))


def learned_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from, ``sample`` at most."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # `sample` rows of two numbers at most: a bound that holds at any size of the tables
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Terms are hashed on the executors; the driver gets ``sample`` arrays of term numbers."""
    prepare(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in rows:
            terms = [terms_of(x, hashes).tobytes() for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(terms, pa.binary())], names=["doc_id", "toxic", "terms"])

    rows = learned_rows(docs, labels, sample).mapInArrow(run, "doc_id long, toxic int, terms binary").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    terms = rows.column("terms").to_pylist()
    return fit([np.frombuffer(terms[i], np.int32) for i in order], rows.column("toxic").to_numpy()[order].astype(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight, machine.factor))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes = Machine(*shared.value), WordHashes()
        for batch in rows:
            terms = [terms_of(x, hashes) for x in texts_of(batch)]
            n = np.fromiter(map(len, terms), np.int64, len(terms))
            margin = model.margin(np.concatenate(terms) if terms else np.zeros(0, np.int32), np.cumsum(n) - n)
            value = 1 / (1 + np.exp(-np.clip(margin, -30, 30).astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The contract's columns, one row per document."""
    return score(docs, train(docs, labels, sample))
