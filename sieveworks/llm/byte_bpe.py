"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, with a literal rank map.

Texts are cut into words; each worker folds merges over the words it has not met
yet, all at once: the words of one length are the rows of a matrix of ids, and a
round merges in every row the leftmost pair of least rank, until no row has one.
Words over ``LONG`` bytes use a heap instead, to the same ids. Decoding looks up
the piece of each id and concatenates. Nothing is shuffled, so a lost executor
costs only its own batches. Texts are taken in slices of ``SLICE`` characters, long
ones cut where no word can reach across, and a task's table of words is emptied
between slices once it holds ``KEPT`` chunks, so a worker's memory does not grow
with the input, with a batch or with a text.

:func:`with_codes` is the same fold in Spark's higher-order functions over a
column of words. It gives the same ids but takes some 35 microseconds a distinct
word in interpreted lambdas, so documents are not encoded with it (see README).

Defined results: null or empty text has no ids and decodes to nothing; repeated
rows are each encoded; a null ``doc_id`` stays null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import prepare, sha_hex, texts_of

#: Chunks a task's table holds before it starts anew, and characters of text that are looked at at once.
KEPT = 100_000
SLICE = 1 << 20
#: Ids of one matrix.
CELLS = 1 << 17
LONG = 256
BUCKETS = 1 << 16
SPREAD = 40503
NONE = 2**62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word, with a heap of mergeable neighbours over a linked list."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n and (rank := ranks.get(word[left : end[right]])) is not None:
            heapq.heappush(heap, (rank, left, end[right]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, left, stop = heapq.heappop(heap)
        if not alive[left] or after[left] >= n or end[after[left]] != stop or end[left] == stop:
            continue
        gone = after[left]
        alive[gone] = False
        end[left], after[left] = stop, after[gone]
        if after[left] < n:
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def merge_literals(ranks: dict[bytes, int]) -> tuple[str, str, str, str]:
    """JSON of the merges in ``BUCKETS`` buckets, of the merges of two bytes, of the ids of bytes, and of the pieces by id.

    A merge has the key ``left * 2**20 + right`` and the id of the result, which is its rank too.
    """
    buckets: list[dict[str, list[int]]] = [{"k": [], "i": []} for _ in range(BUCKETS)]
    pairs: list[int | None] = [None] * 65536
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
        if len(piece) == 2:
            pairs[piece[0] * 256 + piece[1]] = rank
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                bucket = buckets[(left * SPREAD + right) % BUCKETS]
                bucket["k"].append((left << 20) + right)
                bucket["i"].append(rank)
    return json.dumps(buckets), json.dumps(pairs), json.dumps([ranks[bytes([b])] for b in range(256)]), json.dumps(pieces)


def _merge(left: str, right: str) -> str:
    """Id of the merge of two ids, null if they do not merge."""
    return f"merges[int((bigint({left}) * {SPREAD} + {right}) & {BUCKETS - 1})][shiftleft(bigint({left}), 20) + {right}]"


def encode_expr() -> str:
    """SQL over ``words``, ``merges``, ``pairs`` and ``bytes``: ids of each word, by folding merges of least rank.

    The state is p, the ids so far, and r, the rank of the merge of each id with the next.
    """
    step = f"""
      transform(array(int(array_position(s.r, m))), i -> named_struct(
        'p', concat(slice(s.p, 1, i - 1), array(m), slice(s.p, i + 2, size(s.p))),
        'r', concat(slice(s.r, 1, greatest(i - 2, 0)),
                    if(i > 1, array({_merge("s.p[i - 2]", "m")}), slice(s.r, 1, 0)),
                    if(i + 1 < size(s.p), array({_merge("m", "s.p[i + 1]")}), slice(s.r, 1, 0)),
                    slice(s.r, i + 2, size(s.r)))))[0]"""
    start = """
      transform(array(transform(split(w, ''), c -> ascii(c))), b -> named_struct(
        'p', transform(b, x -> bytes[x]),
        'r', zip_with(slice(b, 1, size(b) - 1), slice(b, 2, size(b) - 1), (x, y) -> pairs[x * 256 + y])))[0]"""
    folded = f"""
      aggregate(sequence(1, length(w) - 1), {start},
        (s, k) -> transform(array(array_min(s.r)), m -> if(m is null, s, {step}))[0],
        s -> s.p)"""
    return f"transform(words, w -> if(length(w) = 1, array(bytes[ascii(w)]), {folded}))"


def with_codes(blocks: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``blocks`` (words array<string>, bytes as characters U+0000-U+00FF) with the ids of each word and their decoded bytes."""
    merges, pairs, singles, pieces = merge_literals(ranks)
    return (
        blocks.withColumn("merges", F.from_json(F.lit(merges), "array<struct<k:array<bigint>,i:array<int>>>"))
        .withColumn("merges", F.expr("transform(merges, b -> map_from_arrays(b.k, b.i))"))
        .withColumn("pairs", F.from_json(F.lit(pairs), "array<int>"))
        .withColumn("bytes", F.from_json(F.lit(singles), "array<int>"))
        .withColumn("pieces", F.from_json(F.lit(pieces), "array<string>"))
        .withColumn("codes", F.expr(encode_expr()))
        .withColumn("decoded", F.expr("transform(codes, c -> array_join(transform(c, t -> pieces[t]), ''))"))
        .drop("merges", "pairs", "bytes", "pieces", "words")
    )


class Merges:
    """Ranks of pairs of ids, in an open hash table that whole arrays look up at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.singles = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        keys, values = [], []
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    values.append(rank)
        self.bits = int(np.ceil(np.log2(3 * len(keys) + 16)))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, NONE, np.int64)
        key, value = np.array(keys, np.int64), np.array(values, np.int64)
        at, self.probes = self._slot(key), 0
        while len(key):
            _, one = np.unique(at, return_index=True)
            won = one[self.key[at[one]] == -1]
            self.key[at[won]], self.value[at[won]] = key[won], value[won]
            rest = np.ones(len(key), bool)
            rest[won] = False
            key, value, at = key[rest], value[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (and id) of the merge of each pair, ``NONE`` where they do not merge."""
        shape = left.shape
        key = ((left << np.int64(32)) | right).ravel()
        at = self._slot(key)
        out = np.where(self.key[at] == key, self.value[at], NONE)
        miss = np.flatnonzero((self.key[at] != key) & (self.key[at] != -1))
        for _ in range(self.probes - 1):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            seen = self.key[at[miss]]
            good = miss[seen == key[miss]]
            out[good] = self.value[at[good]]
            miss = miss[(seen != key[miss]) & (seen != -1)]
        return out.reshape(shape)

    def fold(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, where in by_length.items():
            if length > LONG:
                for i in where:
                    out[i] = np.array(merge_long(words[i], self.ranks), np.uint32)
                continue
            for begin in range(0, len(where), max(1, CELLS // length)):
                self._rows(words, np.array(where[begin : begin + max(1, CELLS // length)]), length, out)
        return out

    def _rows(self, words: list[bytes], where: np.ndarray, length: int, out: list) -> None:
        raw = np.frombuffer(b"".join(words[i] for i in where.tolist()), np.uint8)
        ids = self.singles[raw].reshape(-1, length)
        rank = self.rank(ids[:, :-1], ids[:, 1:]) if length > 1 else np.full((len(ids), 0), NONE)
        while True:
            n = ids.shape[1]
            at = rank.argmin(1) if n > 1 else np.zeros(len(ids), np.int64)
            merged = rank[np.arange(len(ids)), at] if n > 1 else np.full(len(ids), NONE)
            done = merged == NONE
            for i, row in zip(where[done].tolist(), ids[done].astype(np.uint32), strict=True):
                out[i] = row
            if done.all():
                return
            go = ~done
            where, ids, rank, at, merged = where[go], ids[go], rank[go], at[go], merged[go]
            row, col = np.arange(len(ids)), np.arange(n - 1)
            ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
            ids[row, at] = merged
            # ranks: the merged pair's goes, those beside it are looked up again
            rank = np.take_along_axis(rank, col[:-1] + (col[:-1] >= at[:, None]), 1)
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.rank(ids[has, at[has] - 1], merged[has])
            has = np.flatnonzero(at < n - 2)
            rank[has, at[has]] = self.rank(merged[has], ids[has, at[has] + 1])


class WordCodes(dict):
    """Word -> slot; a slot's ids lie in ``flat`` from ``begin`` on. Chunks between single spaces are slots' lists."""

    def __init__(self, merges: Merges, pattern: str) -> None:
        import regex

        super().__init__()
        self.merges, self.find = merges, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.begin, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, chunks: set[str]) -> None:
        """Slots for chunks not met yet: a chunk's ids are those of its words in a row; each distinct word is folded once."""
        if len(self) > KEPT:
            self.clear()
        new = [c for c in chunks if c not in self]
        cut = [self.find(c) for c in new]
        words = list(set().union(*cut)) if cut else []
        codes = dict(zip(words, self.merges.fold([w.encode() for w in words]), strict=True))
        ids = [np.concatenate([codes[w] for w in c]) if len(c) > 1 else codes[c[0]] if c else np.zeros(0, np.uint32) for c in cut]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = np.cumsum(n) - n + len(self.flat)
        for at, chunk in enumerate(new, len(self)):
            self[chunk] = at
        self.begin, self.length = np.concatenate((self.begin, begin)), np.concatenate((self.length, n))
        self.flat = np.concatenate((self.flat, *ids), dtype=np.uint32, casting="unsafe") if ids else self.flat

    def ids(self, chunks: list[str]) -> np.ndarray:
        slots = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        n = self.length[slots]
        return self.flat[np.arange(n.sum()) + np.repeat(self.begin[slots] - (np.cumsum(n) - n), n)]


#: Two white-space characters in a row: only there do words of the pattern depend on what lies beyond a single space.
RUN = re.compile(r"[\s\x1c-\x1f]{2}")
#: A single space between other characters: a word of the pattern may begin there and none reaches across it.
GAP = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


def chunks_of(text: str) -> list[str]:
    """The text cut before each space, where that cut is also one between words of the pattern."""
    if not text or RUN.search(text):
        return [text] if text else []
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def pieces_of(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut before single spaces; without one a piece goes on to the next."""
    begin = 0
    while len(text) - begin > size and (gap := GAP.search(text, begin + size)):
        yield text[begin : gap.start()]
        begin = gap.start()
    yield text[begin:]


def slices_of(texts: list[str], size: int = SLICE) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) of the texts in order, in runs of at most about ``size`` characters in all."""
    held: list[tuple[int, str]] = []
    left = size
    for row, text in enumerate(texts):
        for piece in pieces_of(text, size):
            if held and left < len(piece):
                yield held
                held, left = [], size
            held.append((row, piece))
            left -= len(piece)
    if held:
        yield held


CODED = "doc_id long, n_tokens long, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_bytes: bool = False, size: int = SLICE) -> DataFrame:
    """One row per row of ``docs``: ids and decoded bytes (if asked for), their digests, and the count of ids.

    ``size``: characters that are encoded at once; fewer take less memory and more time.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes(Merges(shared.value), pattern)
        for batch in rows:
            numbers = batch.column("doc_id").to_pylist()
            out: dict[str, list] = {k: [] for k in schema.names}
            last, parts = 0, []

            def close(row: int, parts: list[np.ndarray], out: dict[str, list] = out, numbers: list = numbers) -> None:
                ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
                raw, text = ids.astype("<u4").tobytes(), hashlib.sha256()
                held = []
                for begin in range(0, max(1, len(ids)), SLICE):
                    decoded = b"".join(map(known.merges.pieces.__getitem__, ids[begin : begin + SLICE].tolist()))
                    text.update(decoded)
                    held += [decoded] if with_bytes else []
                values = numbers[row], len(ids), raw if with_bytes else None, b"".join(held) if with_bytes else None, sha_hex(raw), text.hexdigest()
                for k, v in zip(schema.names, values, strict=True):
                    out[k].append(v)

            for held in slices_of([x.decode() for x in texts_of(batch)], size):
                # a piece that could not be cut is encoded word by word, so that no long chunk is kept
                cut = [known.find(c[0]) if len(c) == 1 and RUN.search(c[0]) else c for c in (chunks_of(piece) for _, piece in held)]
                known.learn(set().union(*cut))
                for (row, _), chunks in zip(held, cut, strict=True):
                    if row != last:
                        close(last, parts)
                        last, parts = row, []
                    parts.append(known.ids(chunks))
            if parts:
                close(last, parts)
            yield pa.RecordBatch.from_pydict(out, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CODED)


def report(docs: DataFrame, ranks_path: str, pattern: str, size: int = SLICE) -> DataFrame:
    """The contract's columns, one row per document."""
    return encode(docs, ranks_path, pattern, size=size).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
