"""Substring dedup: words covered by a passage of ``WINDOW`` words that starts in an earlier document go.

Who may share a passage is found by winnowing: of the ``GRAM``-word grams in each
window the one of least hash is the window's anchor, a function of the window's
words alone, so equal windows have equal anchors at equal offsets. Blocks of
documents (see ``blocks``) report their anchors; those in two documents or more
come back. The windows of a shared anchor are one region of words. Regions are
dealt to shards by anchor, once for each block and wording. A shard indexes its
regions in a compressed FM-index and streams them through it by backward search:
each window's matching statistic is cut at ``WINDOW`` words, and the rows that
match it give the smallest document it starts in. Verdicts return to the blocks.

Anchors that very many documents hold (``HOT``) first have their windows' hashes
compared, so that what surrounds a common passage, different everywhere, is not
sent to one shard: only windows that really repeat are, once for each block.

Defined results: null and empty texts have no words; a document of fewer words
than a window loses none; rows of one ``doc_id`` do not cut each other; rows
without a ``doc_id`` neither lose words nor count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.blocks import BLOCK, into_blocks
from sieveworks.llm.common import Words, grams, mix64, partitions, saved, sha_hex
from sieveworks.llm.fm_index import FMIndex

WINDOW = 50
GRAM = 8
#: Documents that hold an anchor before its windows are compared by hash first.
HOT = 64
#: Words in one FM-index; only whole anchors are indexed together.
INDEX_WORDS = 600_000
#: Grams whose places are told apart in the low 24 bits of a hash.
PIECE = 1 << 24


def least_places(g: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost least gram in each run of ``span`` grams, of ``PIECE`` grams at most."""
    # high bits of the hash, then the place: the least is the leftmost of the least
    wide, width = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(g), dtype=np.uint64), 1
    while 2 * width <= span:
        wide, width = np.minimum(wide[:-width], wide[width:]), 2 * width
    n = len(g) - span + 1
    at = np.minimum(wide[:n], wide[span - width : span - width + n])
    return (at & np.uint64(0xFFFFFF)).astype(np.int64)


class Anchors:
    """Anchors of one text: places, first and last window of each."""

    def __init__(self, text: bytes, scan: Words, window: int) -> None:
        self.text, self.window = text, window
        self.begin, self.end, self.hash = scan.scan(text)
        n = len(self.begin) - window + 1
        if n <= 0:
            self.place = self.first = self.last = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        g = grams(self.hash, GRAM)
        span = window - GRAM + 1
        at = np.concatenate([begin + least_places(g[begin : begin + PIECE], span) for begin in range(0, n, PIECE - span + 1)])
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.place, self.first = at[begin], begin
        self.last = np.append(begin[1:], n) - 1
        self.key = g[self.place]

    def window_hashes(self) -> np.ndarray:
        """Hash of each window."""
        m = 0x9E3779B97F4A7C15
        out, size, left = None, 1, self.window
        part, power = self.hash.copy(), m
        begin = 0
        n = len(self.begin) - self.window + 1
        with np.errstate(over="ignore"):
            while left:
                if left & 1:
                    piece = part[begin : begin + n]
                    out = piece.copy() if out is None else out * np.uint64(power) + piece
                    begin += size
                left >>= 1
                if left:
                    part = part[:-size] * np.uint64(power) + part[size:]
                    size, power = 2 * size, power * power & 0xFFFFFFFFFFFFFFFF
        return mix64(out)

    def regions(self, shared: dict[int, bool], windows: set[int]) -> Iterator[tuple[int, int, int]]:
        """(anchor, first word, end) of the regions of shared anchors, trimmed to repeated windows if the anchor is hot."""
        hashes = None
        for key, first, last in zip(self.key.tolist(), self.first.tolist(), self.last.tolist(), strict=True):
            hot = shared.get(key)
            if hot is None:
                continue
            if not hot:
                yield key, first, last + self.window
                continue
            if hashes is None:
                hashes = self.window_hashes().tolist()
            begin = None
            for at in range(first, last + 2):
                inside = at <= last and hashes[at] in windows
                if inside and begin is None:
                    begin = at
                elif not inside and begin is not None:
                    yield key, begin, at - 1 + self.window
                    begin = None

    def words(self, begin: int, end: int) -> bytes:
        """Words from ``begin`` to ``end``, with a space between."""
        return b" ".join(self.text[self.begin[begin] : self.end[end - 1]].split())

    def region_hash(self, begin: int, end: int) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(self.hash[begin:end].tobytes())


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _reports(block: int, keys: list[np.ndarray], docs: list[int]) -> pa.RecordBatch:
    """Distinct keys of a block with their smallest and largest document and how often they occur."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    d = np.repeat(np.array(docs, np.int64), [len(x) for x in keys])
    order = np.argsort(k, kind="stable")
    k, d = k[order], d[order]
    begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    if not len(k):
        least = most = n = np.zeros(0, np.int64)
    else:
        least, most, n = np.minimum.reduceat(d, begin), np.maximum.reduceat(d, begin), np.diff(np.append(begin, len(k)))
    return pa.RecordBatch.from_arrays([pa.array(_signed(k[begin])), pa.array(np.full(len(begin), block, np.int32)), pa.array(least), pa.array(most), pa.array(n.astype(np.int64))], names=["key", "block", "min_doc", "max_doc", "n"])


REPORT = "key long, block int, min_doc long, max_doc long, n long"


def anchor_reports(blocks: DataFrame, window: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Words()
        held: dict[int, tuple[list, list]] = {}
        size = 0
        for batch in rows:
            for block, doc, text in zip(batch.column(BLOCK).to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                a = Anchors(text, scan, window)
                if len(a.key):
                    keys, docs = held.setdefault(block, ([], []))
                    keys.append(np.unique(a.key))
                    docs.append(doc)
                    size += len(a.key)
            if size > 2_000_000:  # bounded memory: a block may report a key twice
                for block, (keys, docs) in held.items():
                    yield _reports(block, keys, docs)
                held, size = {}, 0
        for block, (keys, docs) in held.items():
            yield _reports(block, keys, docs)

    return blocks.mapInArrow(run, REPORT)


def shared_keys(reported: DataFrame, hot: int) -> DataFrame:
    """(block, key, hot) of the keys that two documents or more hold, for each block that holds them."""
    n = partitions(reported.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(rows)
        if not held:
            return
        t = pa.Table.from_batches(held)
        del held
        key = t.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key, block, least, most, count = (t.column(c).to_numpy()[order] for c in ("key", "block", "min_doc", "max_doc", "n"))
        if not len(key):
            return
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(begin, len(key)))
        low, high, total = np.minimum.reduceat(least, begin), np.maximum.reduceat(most, begin), np.add.reduceat(count, begin)
        keep = np.repeat(low < high, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(block[keep]), pa.array(key[keep]), pa.array(np.repeat(total > hot, sizes)[keep])], names=["block", "key", "hot"])

    return reported.repartition(n, "key").mapInArrow(run, "block int, key long, hot boolean")


def _wanted(right: pa.Table) -> tuple[dict[int, bool], set[int]]:
    """Anchors (hot or not) and window hashes from the rows of kind 0 and 1."""
    kind = right.column("kind").to_numpy()
    key = right.column("key").to_numpy().view(np.uint64)
    hot = np.asarray(right.column("hot").to_pylist(), bool)
    anchors = dict(zip(key[kind == 0].tolist(), hot[kind == 0].tolist(), strict=True))
    return anchors, set(key[kind == 1].tolist())


def _documents(docs: pa.Table, window: int) -> Iterator[tuple[int, Anchors]]:
    scan = Words()
    for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist(), strict=True):
        yield doc, Anchors(text or b"", scan, window)


def window_reports(blocks: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """Hashes of the windows of hot anchors, by block."""

    def run(docs: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids = [], []
        if right.num_rows and docs.num_rows:
            anchors = np.unique(right.column("key").to_numpy().view(np.uint64))
            for doc, a in _documents(docs, window):
                if doc is None or not len(a.key):
                    continue
                mine = np.flatnonzero(np.isin(a.key, anchors))
                if len(mine):
                    h = a.window_hashes()
                    keys.append(np.unique(np.concatenate([h[a.first[i] : a.last[i] + 1] for i in mine])))
                    ids.append(doc)
        block = docs.column(BLOCK)[0].as_py() if docs.num_rows else 0
        return pa.Table.from_batches([_reports(block, keys, ids)])

    return blocks.groupBy(BLOCK).cogroup(hot.groupBy("block")).applyInArrow(run, REPORT)


REGION = "key long, block int, region long, words binary, min_doc long, max_doc long, hot boolean"


def regions(blocks: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Regions of shared anchors, once for each block and wording, with the smallest and largest document that holds them."""

    def run(docs: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list] = {}
        if right.num_rows and docs.num_rows:
            anchors, windows = _wanted(right)
            for doc, a in _documents(docs, window):
                if doc is None or not len(a.key):
                    continue
                for key, begin, end in a.regions(anchors, windows):
                    at = key, a.region_hash(begin, end)
                    if at in found:
                        found[at][1:3] = min(found[at][1], doc), max(found[at][2], doc)
                    else:
                        found[at] = [a.words(begin, end), doc, doc, anchors[key]]
        block = docs.column(BLOCK)[0].as_py() if docs.num_rows else 0
        rows = list(found.values())
        keys = np.array(list(found), np.uint64).reshape(-1, 2)
        return pa.table({
            "key": pa.array(_signed(keys[:, 0])), "block": pa.array(np.full(len(rows), block, np.int32)), "region": pa.array(_signed(keys[:, 1])),
            "words": pa.array([x[0] for x in rows], pa.binary()), "min_doc": pa.array([x[1] for x in rows], pa.int64()),
            "max_doc": pa.array([x[2] for x in rows], pa.int64()), "hot": pa.array([x[3] for x in rows], pa.bool_()),
        })

    return blocks.groupBy(BLOCK).cogroup(wanted.groupBy("block")).applyInArrow(run, REGION)


ANSWER = "block int, key long, region long, hot boolean, payload binary"


def judged(found: DataFrame, window: int) -> DataFrame:
    """For each region, the smallest document in which each of its windows starts; regions that cut nothing are left out."""
    n = partitions(found.sparkSession)

    def index(rows: list[tuple]) -> pa.RecordBatch:
        # copies of a passage in several blocks are one text of the index, of their smallest document
        alike: dict[tuple[int, bytes], int] = {}
        of = [alike.setdefault((r[0], r[3]), len(alike)) for r in rows]
        texts = [words.split() for _, words in alike]
        first = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(first, of, np.fromiter((r[4] for r in rows), np.int64, len(rows)))
        number: dict[bytes, int] = {}
        flat = np.fromiter((number.setdefault(w, len(number) + 1) for t in texts for w in (*t, b"")), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        # the empty word stands for the end of a text
        end_of = number[b""]
        flat = np.where(flat == end_of, 0, np.where(flat > end_of, flat - 1, flat))
        end = np.cumsum(sizes + 1) - 1
        fm = FMIndex(flat, window)
        least = fm.least(np.repeat(first, sizes + 1))
        place = fm.statistics(end - sizes, end, flat)
        out = []
        for r, at in zip(rows, of, strict=True):
            values = least[place[end[at] - sizes[at] : end[at] - window + 1]]
            if values.min(initial=r[5]) < r[5]:
                out.append((r[1], r[0], r[2], r[6], values.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["block", "key", "region", "hot", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > INDEX_WORDS and held[-1][0] != row[0]:
                    yield index(held)
                    held, size = [], 0
                held.append(row)
                size += row[3].count(b" ") + 2
        if held:
            yield index(held)

    return found.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, ANSWER)


def cut(blocks: DataFrame, answers: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every document."""

    def run(docs: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[int, dict[int, np.ndarray]] = {}
        anchors: dict[int, bool] = {}
        windows: set[int] = set()
        if right.num_rows:
            kind, key, region = right.column("kind").to_numpy(), right.column("key").to_numpy().view(np.uint64), right.column("region").to_numpy().view(np.uint64)
            windows = set(key[kind == 1].tolist())
            hot, payload = right.column("hot").to_pylist(), right.column("payload")
            for i in np.flatnonzero(kind == 2).tolist():
                anchors[int(key[i])] = hot[i]
                known.setdefault(int(key[i]), {})[int(region[i])] = np.frombuffer(payload[i].as_py(), np.int64)
        n_words, n_removed, kept = [], [], []
        for doc, a in _documents(docs, window):
            gone = np.zeros(len(a.begin) + 1, np.int64)
            if doc is not None and anchors and len(a.key):
                for key_, begin, end in a.regions(anchors, windows):
                    least = known[key_].get(a.region_hash(begin, end))
                    if least is not None:
                        at = begin + np.flatnonzero(least < doc)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
            hit = np.cumsum(gone[:-1]) > 0
            removed = int(hit.sum())
            words = a.text.split()
            words = [w for w, h in zip(words, hit.tolist(), strict=True) if not h] if removed else words
            n_words.append(len(a.begin))
            n_removed.append(removed)
            kept.append(sha_hex(b" ".join(words)))
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    return blocks.groupBy(BLOCK).cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def report(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """The contract's columns, one row per document."""
    blocks = into_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    shared = saved(shared_keys(anchor_reports(blocks, window), hot), "anchors")
    common = saved(shared_keys(window_reports(blocks, shared.where("hot").select("block", "key"), window), hot), "windows")
    windows = common.select("block", F.lit(1).alias("kind"), "key", "hot")
    wanted = shared.select("block", F.lit(0).alias("kind"), "key", "hot").unionByName(windows)
    answers = judged(regions(blocks, wanted, window), window)
    right = answers.select("block", F.lit(2).alias("kind"), "key", "region", "hot", "payload").unionByName(windows.select("block", "kind", "key", F.lit(0).cast("long").alias("region"), "hot", F.lit(None).cast("binary").alias("payload")))
    return cut(blocks, right, window)
