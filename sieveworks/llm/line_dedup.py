"""Line dedup on sharded cuckoo filters backed by exact reference-count tables.

Lines are known by a 128-bit hash of their key. A block of documents (see
``blocks``) reports each distinct key once, with its smallest document and how
many of its documents hold it. Reports are dealt to shards by hash. In a shard a
cuckoo filter sees every key: a key it has not seen goes in and costs two bytes;
only a key it may have seen enters the exact table of references, which decides.
Unique lines, nearly all of them, never reach that table. The verdicts go back
to the blocks that hold the key.

:class:`LineIndex` keeps the same state between batches, in tables of the shared
folder: documents can be inserted and deleted, and a deletion brings a line back
in the next smallest document that holds it.

Defined results: null and empty texts are one empty line; keys under
``MIN_CHARS`` code points are kept; a key that only rows of one ``doc_id`` hold
is kept in all of them; rows without a ``doc_id`` neither lose lines nor count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm.blocks import BLOCK, into_blocks
from sieveworks.llm.common import free_name, mix64, partitions, prepare, saved, sha_hex, shared_dir

MIN_CHARS = 10
#: Blocks for each shuffle partition: a task holds one block's texts at a time.
SPLIT = 4
#: What bytes.lower() does is exactly what a key asks for: A-Z only.
BLANK = b" \t\n\v\f\r"


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Normalised line, None if it is too short to count."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key


def hash_of(key: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


class CuckooFilter:
    """Buckets of four 16-bit fingerprints, filled and asked with whole arrays of 64-bit hashes; it grows by rebuilding.

    ``contains`` is never wrong on what was added and not removed.
    """

    WAYS = 4

    def __init__(self, capacity: int = 1024) -> None:
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(capacity, 16) / (0.8 * self.WAYS)))))
        self.cells = np.zeros((self.buckets, self.WAYS), np.uint16)
        self.added = 0
        self.spare: dict[tuple[int, int], int] = {}  # fingerprints that found no cell, by lower bucket

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (h >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, at: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return at ^ (mix64(print_.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(h)
        found = (self.cells[a] == print_[:, None]).any(1) | (self.cells[b] == print_[:, None]).any(1)
        if self.spare:
            found |= np.fromiter(((min(x, y), int(p)) in self.spare for p, x, y in zip(print_, a.tolist(), b.tolist(), strict=True)), bool, len(h))
        return found

    def add(self, h: np.ndarray, rounds: int = 40) -> None:
        """Every hash gets a cell; those that lose a place move on to their other bucket, all of a round at once."""
        print_, at, other = self._places(h)
        self.added += len(h)
        for turn in range(rounds):
            if not len(at):
                return
            for way in range(self.WAYS):
                free = np.flatnonzero(self.cells[at, way] == 0)
                _, one = np.unique(at[free], return_index=True)
                won = free[one]
                self.cells[at[won], way] = print_[won]
                left = np.ones(len(at), bool)
                left[won] = False
                print_, at, other = print_[left], at[left], other[left]
                if not len(at):
                    return
            if turn < 1:
                at, other = other, at
                continue
            # push one resident out of each full bucket; it moves to its own other bucket
            _, one = np.unique(at, return_index=True)
            way = turn % self.WAYS
            out = self.cells[at[one], way].copy()
            self.cells[at[one], way] = print_[one]
            rest = np.ones(len(at), bool)
            rest[one] = False
            moved = self._other(at[one], out)
            print_ = np.concatenate((print_[rest], out))
            other, at = np.concatenate((at[rest], at[one])), np.concatenate((other[rest], moved))
        for p, x, y in zip(print_.tolist(), at.tolist(), other.tolist(), strict=True):
            self.spare[min(x, y), p] = self.spare.get((min(x, y), p), 0) + 1

    def remove(self, h: np.ndarray) -> None:
        """Takes one copy of each fingerprint out; only for what was added."""
        for p, x, y in zip(*(v.tolist() for v in self._places(h)), strict=True):
            for at in (x, y):
                ways = np.flatnonzero(self.cells[at] == p)
                if len(ways):
                    self.cells[at, ways[0]] = 0
                    break
            else:
                if self.spare.get((min(x, y), p), 0) > 1:
                    self.spare[min(x, y), p] -= 1
                else:
                    self.spare.pop((min(x, y), p), None)
            self.added -= 1

    def dump(self) -> bytes:
        head = json.dumps({"buckets": self.buckets, "added": self.added, "spare": [[*k, v] for k, v in self.spare.items()]}).encode()
        return len(head).to_bytes(4, "little") + head + self.cells.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        size = int.from_bytes(data[:4], "little")
        head = json.loads(data[4 : 4 + size])
        out = cls.__new__(cls)
        out.buckets, out.added = head["buckets"], head["added"]
        out.spare = {(x, p): n for x, p, n in head["spare"]}
        out.cells = np.frombuffer(data[4 + size :], np.uint16).reshape(out.buckets, cls.WAYS).copy()
        return out


REPORT = "shard int, h1 long, h2 long, block int, min_doc long, n_docs long"


def reports(blocks: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """Distinct keys of each block: smallest document and number of documents that hold it (a row of a repeated id counts once)."""
    schema = pa.schema([("shard", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("block", pa.int32()), ("min_doc", pa.int64()), ("n_docs", pa.int64())])

    def emit(block: int, held: dict) -> pa.RecordBatch:
        h = np.array([hash_of(k) for k in held], np.uint64).reshape(-1, 2)
        least = np.fromiter((v[0] for v in held.values()), np.int64, len(held))
        count = np.fromiter((v[1] for v in held.values()), np.int64, len(held))
        return pa.RecordBatch.from_arrays([pa.array((h[:, 0] % np.uint64(shards)).astype(np.int32)), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), pa.array(np.full(len(held), block, np.int32)), pa.array(least), pa.array(count)], schema=schema)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition may hold several blocks; a key then gives a row for each of them
        held: dict[int, dict] = {}
        seen = 0
        for batch in rows:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for block, doc, text in zip(batch.column(BLOCK).to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True):
                if doc is None or not text:
                    continue
                mine = held.setdefault(block, {})
                for line in set(text.split(b"\n")):
                    key = key_of(line, min_chars)
                    if key is None:
                        continue
                    known = mine.get(key)
                    if known is None:
                        mine[key] = [doc, 1, doc]
                        seen += 1
                    elif known[2] != doc:  # rows of one document may be apart: counted twice here, told apart in the shard by min and max
                        known[0], known[1], known[2] = min(known[0], doc), known[1] + 1, doc
            if seen > 400_000:  # bounded memory: a key may be reported twice by a block
                for block, mine in held.items():
                    yield emit(block, mine)
                held, seen = {}, 0
        for block, mine in held.items():
            if mine:
                yield emit(block, mine)

    return blocks.mapInArrow(run, REPORT)


VERDICT = "block int, h1 long, h2 long, keep_doc long"


class Shard:
    """State of one shard: a cuckoo filter over all keys, an exact table of those it may have seen twice."""

    def __init__(self, expected: int) -> None:
        self.filter = CuckooFilter(expected)

    def repeated(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Mask of the rows whose key occurs in more than one row, without false negatives: the second sight of a fingerprint marks it."""
        marked = np.zeros(len(h1), bool)
        mixed = mix64(h1 ^ (h2 << np.uint64(1)))
        for begin in range(0, len(h1), 1 << 15):
            part = mixed[begin : begin + (1 << 15)]
            _, first = np.unique(part, return_index=True)
            again = np.ones(len(part), bool)
            again[first] = False
            fresh = np.flatnonzero(~again)
            known = self.filter.contains(part[fresh])
            self.filter.add(part[fresh[~known]])
            again[fresh[known]] = True
            marked[begin : begin + len(part)] = again
        # the first sights of what was marked
        return np.isin(mixed, mixed[marked])


def verdicts(reported: DataFrame, shards: int) -> DataFrame:
    """For each block, the keys it holds that at least two documents hold, and the smallest of those documents."""
    schema = pa.schema([("block", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keep_doc", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(rows)
        if not held:
            return
        t = pa.Table.from_batches(held)
        del held
        h1, h2 = (t.column(k).to_numpy().view(np.uint64) for k in ("h1", "h2"))
        block, doc, count = (t.column(k).to_numpy() for k in ("block", "min_doc", "n_docs"))
        at = np.flatnonzero((count > 1) | Shard(len(h1)).repeated(h1, h2))
        at = at[np.lexsort((h2[at], h1[at]))]
        if not len(at):
            return
        h1, h2, block, doc, count = h1[at], h2[at], block[at], doc[at], count[at]
        begin = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
        group = np.cumsum(np.isin(np.arange(len(h1)), begin)) - 1
        least, most = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
        shared = (np.maximum.reduceat(count, begin) > 1) | (least != most)
        keep = shared[group]
        yield pa.RecordBatch.from_arrays([pa.array(block[keep]), pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)), pa.array(least[group][keep])], schema=schema)

    return reported.repartitionById(shards, F.col("shard")).select("h1", "h2", "block", "min_doc", "n_docs").mapInArrow(run, VERDICT)


def split_text(text: bytes, doc: int | None, drops: dict[tuple[int, int], int], min_chars: int) -> tuple[int, list[bytes]]:
    """Number of lines, and the lines that stay."""
    lines = text.split(b"\n")
    if doc is None or not drops:
        return len(lines), lines
    kept = []
    for line in lines:
        key = key_of(line, min_chars)
        if key is None or drops.get(hash_of(key), doc) == doc:
            kept.append(line)
    return len(lines), kept


def apply(blocks: DataFrame, found: DataFrame, min_chars: int, out: T.StructType, make) -> DataFrame:
    """Each block with its verdicts; ``make(table, results)`` gives the columns of ``out``."""

    def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
        drops = {}
        if keys.num_rows:
            h1, h2 = (keys.column(k).to_numpy().view(np.uint64).tolist() for k in ("h1", "h2"))
            drops = dict(zip(zip(h1, h2, strict=True), keys.column("keep_doc").to_pylist(), strict=True))
        texts = docs.column("text").cast(pa.binary()).to_pylist()
        results = [split_text(text or b"", doc, drops, min_chars) for doc, text in zip(docs.column("doc_id").to_pylist(), texts, strict=True)]
        return make(docs, results)

    return blocks.groupBy(BLOCK).cogroup(found.groupBy("block")).applyInArrow(run, out)


def _plan(docs: DataFrame, min_chars: int, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    blocks = into_blocks(docs, *columns, split=SPLIT)
    shards = partitions(docs.sparkSession)
    return blocks, verdicts(reports(blocks, shards, min_chars), shards)


def report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The contract's columns, one row per document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks, found = _plan(docs, min_chars, ["doc_id", "text"])

    def make(table: pa.Table, results: list) -> pa.Table:
        return pa.table({
            "doc_id": table.column("doc_id"),
            "n_lines": pa.array([n for n, _ in results], pa.int64()),
            "n_dropped": pa.array([n - len(kept) for n, kept in results], pa.int64()),
            "kept_sha256": pa.array([sha_hex(b"\n".join(kept)) for _, kept in results], pa.string()),
        })

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return apply(blocks, found, min_chars, out, make)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines gone; ``n_chars``, if there, follows the text. Texts without a dropped line stay as they are."""
    given = docs.columns
    docs = docs.toDF(*[free_name(f"_{BLOCK}", given) if c.lower() == BLOCK else c for c in given])
    names = docs.columns
    blocks, found = _plan(docs, min_chars, names)

    def make(table: pa.Table, results: list) -> pa.Table:
        texts = [old if n == len(kept) else b"\n".join(kept) for old, (n, kept) in zip(table.column("text").cast(pa.binary()).to_pylist(), results, strict=True)]
        return table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string())).select(names)

    out = apply(blocks, found, min_chars, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]), make)
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
    return out.toDF(*given)


class LineIndex:
    """Incremental line dedup: exact references and filters by shard, kept as tables under ``path`` of the shared folder.

    ``refs`` holds one row for each (key, document); ``filters`` one cuckoo filter
    for each shard, over the keys with references. An insertion asks the filters
    first: keys they do not know need no look at ``refs``. A deletion takes the
    document's references away and keys without any out of the filters.
    """

    REFS = "shard int, h1 long, h2 long, doc_id long"

    def __init__(self, spark: SparkSession, shards: int | None = None, min_chars: int = MIN_CHARS) -> None:
        prepare(spark)
        self.spark, self.min_chars = spark, min_chars
        self.shards = shards or partitions(spark)
        self.dir = shared_dir(spark)
        self.refs = spark.createDataFrame([], self.REFS)
        self.filters = spark.createDataFrame([], "shard int, filter binary")

    def _references(self, docs: DataFrame) -> DataFrame:
        shards, min_chars = self.shards, self.min_chars

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                out = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    keys = {key_of(x, min_chars) for x in (text or b"").split(b"\n")} - {None} if doc is not None else ()
                    out += [(*hash_of(k), doc) for k in keys]
                h = np.array([x[:2] for x in out], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array((h[:, 0] % np.uint64(shards)).astype(np.int32)), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), pa.array([x[2] for x in out], pa.int64())], names=["shard", "h1", "h2", "doc_id"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, self.REFS).distinct()

    def _refilter(self, change: DataFrame, insert: bool) -> tuple[DataFrame, DataFrame]:
        """Filters after ``change`` (shard, h1, h2: keys to add or remove); for an insertion, also which keys may be known."""

        def run(keys: pa.Table, old: pa.Table) -> pa.Table:
            h = mix64(keys.column("h1").to_numpy().view(np.uint64) ^ (keys.column("h2").to_numpy().view(np.uint64) << np.uint64(1)))
            before = old.column("filter").to_pylist()
            state = CuckooFilter.load(before[0]) if before else CuckooFilter(max(1024, 2 * len(h)))
            (state.add if insert else state.remove)(h)
            shard = (keys if keys.num_rows else old).column("shard")[0].as_py()
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([state.dump()], pa.binary())})

        return saved(change.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(run, "shard int, filter binary"), "line-filters")

    def _maybe(self, keys: DataFrame) -> DataFrame:
        """Keys that the filters may hold; those they do not know are new for certain."""

        def run(keys: pa.Table, old: pa.Table) -> pa.Table:
            h = mix64(keys.column("h1").to_numpy().view(np.uint64) ^ (keys.column("h2").to_numpy().view(np.uint64) << np.uint64(1)))
            before = old.column("filter").to_pylist()
            return keys.filter(pa.array(CuckooFilter.load(before[0]).contains(h) if before else np.zeros(len(h), bool)))

        return keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(run, "shard int, h1 long, h2 long")

    def insert(self, docs: DataFrame) -> None:
        new = saved(self._references(docs), "line-refs")
        keys = new.select("shard", "h1", "h2").distinct()
        maybe = self._maybe(keys)
        known = maybe.join(self.refs.select("shard", "h1", "h2").distinct(), ["shard", "h1", "h2"], "left_semi")
        fresh = saved(keys.join(known, ["shard", "h1", "h2"], "left_anti"), "line-fresh")
        self.filters = self._refilter(fresh, insert=True)
        self.refs = saved(self.refs.unionByName(new).distinct(), "line-refs")

    def delete(self, doc_ids: DataFrame) -> None:
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        kept = saved(self.refs.join(gone, "doc_id", "left_anti").select("shard", "h1", "h2", "doc_id"), "line-refs")
        dead = self.refs.select("shard", "h1", "h2").distinct().join(kept.select("shard", "h1", "h2").distinct(), ["shard", "h1", "h2"], "left_anti")
        dead = saved(dead, "line-dead")
        self.refs, self.filters = kept, self._refilter(dead, insert=False)

    def counts(self) -> DataFrame:
        """The exact table: each key's number of documents and the one that keeps it."""
        return self.refs.groupBy("shard", "h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keep_doc"))
