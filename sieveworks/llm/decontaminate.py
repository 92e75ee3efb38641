"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training text is streamed through the automaton word by word; at each word the
longest suffix that occurs in some item is known, and with it every window that
ends there. The automaton is built from the (small) benchmark only: shards of
``SHARD_WORDS`` words at most are broadcast one by one, so what a worker holds
does not grow with the benchmark, let alone with the corpus.

Defined results: null or empty text has no words and no hits; items without
words have no windows; repeated rows are each judged; a null ``doc_id`` stays
null. Item ids may be of any type and are compared as strings; an item without an
id counts as one item, which digests leave out. Extra columns are ignored by :func:`scan` and kept by :func:`decontaminate`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm.common import prepare, texts_of

WINDOW = 10
#: Words of benchmark text in one broadcast automaton.
SHARD_WORDS = 200_000
#: Bytes that separate words become spaces, A-Z become lower case; all bytes from 0x80 are part of words.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class SuffixAutomaton:
    """All substrings of a set of word sequences; ``windows`` hang on the states that hold them."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self._hang(sequences, window)

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of q for its strings of up to length[p] + 1 words; what led to q over ``word`` leads there."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def _hang(self, sequences: list[tuple[object, list[int]]], window: int) -> None:
        own: dict[int, dict[int, set]] = {}
        self.least = window
        for item, sequence in sequences:
            size = min(window, len(sequence))
            self.least = min(self.least, size)
            for at in range(len(sequence) - size + 1):
                state = 0
                for word in sequence[at : at + size]:
                    state = self.next[state][word]
                own.setdefault(state, {}).setdefault(size, set()).add(item)
        self.windows: list[tuple] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            mine = tuple((size, tuple(items)) for size, items in sorted(own.get(state, {}).items()))
            self.windows[state] = self.windows[self.link[state]] + mine

    def stream(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items of those windows.

        A word no item holds resets the match, so only runs of known words
        that are as long as the shortest window are walked.
        """
        hit, items = np.zeros(len(words) + 1, np.int32), set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        after, link, length, windows = self.next, self.link, self.length, self.windows
        for start, end in zip(edge[::2], edge[1::2], strict=True):
            if end - start < self.least:
                continue
            state = matched = 0
            for at, word in enumerate(ids[start:end].tolist(), int(start)):
                to = after[state].get(word)
                while to is None:
                    state = link[state]
                    matched = length[state]
                    to = after[state].get(word)
                state, matched = to, matched + 1
                for size, found in windows[state]:
                    if size > matched:
                        break
                    items.update(found)
                    hit[at + 1 - size] += 1
                    hit[at + 1] -= 1
        return np.cumsum(hit[:-1]) > 0, items


def automata(spark: SparkSession, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> list:
    """Broadcast automata over ``items`` (item_id, text), ``shard_words`` words in each at most (or one longer item)."""
    shards, held, size = [], [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        words = words_of(bytes(row["text"] or b""))
        if held and size + len(words) > shard_words:
            shards.append(spark.sparkContext.broadcast(SuffixAutomaton(held, window)))
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    return [*shards, spark.sparkContext.broadcast(SuffixAutomaton(held, window))]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def cleaned(text: bytes, flags: np.ndarray, min_span: int) -> bytes:
    """``text`` without the spans of hit words (``min_span`` words or more), from first to last byte of the span."""
    cut = [s for s in _spans(flags) if s[1] - s[0] >= min_span]
    if not cut:
        return text
    at = [m.span() for m in WORD.finditer(text)]
    out, begin = [], 0
    for first, end in cut:
        out.append(text[begin : at[first][0]])
        begin = at[end - 1][1]
    return b"".join([*out, text[begin:]])


RESULT = "doc_id long, n_words long, n_hit long, items array<string>, clean_text string"


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_span: int = 1, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: words, hit words, items found and (if asked for) the text without hit spans."""
    spark = docs.sparkSession
    prepare(spark)
    shards = automata(spark, items, window)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("clean_text", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [x.value for x in shards]
        for batch in rows:
            out: dict[str, list] = {k: [] for k in schema.names}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                flags, found = np.zeros(len(words), bool), set()
                for automaton in loaded:
                    hit, some = automaton.stream(words)
                    if some:
                        flags |= hit
                        found |= some
                out["doc_id"].append(doc)
                out["n_words"].append(len(words))
                out["n_hit"].append(int(flags.sum()))
                out["items"].append(sorted(found, key=lambda x: (x is None, x or "")))
                out["clean_text"].append(cleaned(text, flags, min_span).decode() if with_text else None)
            yield pa.RecordBatch.from_pydict(out, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's columns, one row per document."""
    found = scan(docs, items, window)
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with hit spans of at least ``min_span`` words cut out and documents of a larger hit share than ``max_coverage`` gone.

    All columns stay; ``n_chars``, if there, follows the text. A null text stays null.
    Rows are rewritten in place, so equal ids need no join.
    """
    spark = docs.sparkSession
    prepare(spark)
    shards = automata(spark, items, window)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [x.value for x in shards]
        for batch in rows:
            keep, new = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                flags = np.zeros(len(words), bool)
                for automaton in loaded:
                    flags |= automaton.stream(words)[0]
                keep.append(bool(flags.sum() <= max_coverage * len(words)))
                new.append(cleaned(text, flags, min_span) if flags.any() else text)
            text = pa.array(new, pa.binary()).cast(pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), text).filter(pa.array(keep, pa.bool_()))

    out = docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
