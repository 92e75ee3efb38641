"""What the training-data operators share: sessions, tables, packed keys and word hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sieveworks.session import saved, shared_dir, ship

__all__ = ["free_name", "Words", "WordHashes", "batches", "grams", "mix64", "partitions", "prepare", "saved", "sha_hex", "shared_dir", "table", "texts_of"]

#: Rows and bytes of one Arrow batch; a batch is the unit of work of every vectorised worker.
BATCH_ROWS = 4000
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Ships the package to the workers and bounds the Arrow batches, so a run of very long texts cannot fill a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the one knob that grows with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, led by as many underscores as it takes to differ from all columns (in any case)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null gives an empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of ``size`` rows at most from dictionaries."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """Word -> 64-bit hash, kept per worker and emptied when it grows past ``most`` words."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Words:
    """Places and 64-bit hashes of the words of texts (runs of bytes other than ASCII white space), whole texts at a time.

    A word's hash is a polynomial over a table of random numbers by byte, taken
    from running sums; multiplying by the inverse power makes it independent of
    the word's place.
    """

    STEP = 0x9E3779B97F4A7C15
    CHUNK = 1 << 22

    def __init__(self) -> None:
        self.table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.inside = np.ones(256, np.int8)
        self.inside[list(b" \t\n\v\f\r")] = 0
        self.power, self.inverse = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 1 << 14)
            one = lambda step: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, step, np.uint64))))
            self.power, self.inverse = one(self.STEP), one(pow(self.STEP, -1, 1 << 64))

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends and hashes."""
        if len(text) > self.CHUNK:
            return self._scan_long(text)
        raw = np.frombuffer(text, np.uint8)
        n = len(raw)
        self._grow(n + 1)
        edge = np.zeros(n + 2, np.int8)
        edge[1:-1] = self.inside[raw]
        edge = np.diff(edge)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[raw] * self.power[:n], out=total[1:])
        return begin, end, mix64((total[end] - total[begin]) * self.inverse[begin])

    def _scan_long(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece by piece, cut at white space where there is some; a longer word is hashed by itself."""
        parts, at = [], 0
        while at < len(text):
            stop = min(len(text), at + self.CHUNK)
            while stop < len(text) and self.inside[text[stop]]:
                stop += 1
            piece = text[at:stop]
            if len(piece) > 4 * self.CHUNK:
                import xxhash

                found = [(m.start(), m.end(), xxhash.xxh3_64_intdigest(m[0])) for m in re.finditer(rb"[^\x20\x09-\x0D]+", piece)]
                b, e, h = (np.array([x[i] for x in found], np.uint64 if i == 2 else np.int64) for i in range(3))
            else:
                size, self.CHUNK = self.CHUNK, len(piece)
                b, e, h = self.scan(piece)
                self.CHUNK = size
            parts.append((b + at, e + at, h))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive words that start at each position (the last n - 1 positions have none)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out *= m
            out += h[k : len(h) - n + 1 + k]
    return mix64(out)


