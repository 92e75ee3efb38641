"""Near duplicates by b-bit MinHash.

A set of word shingles has HASHES minima, one for each of as many hash functions.
Bands of ROWS minima are the keys under which sets meet; of the minima themselves
only the low BITS bits are kept, packed into one signature. Of two sets that meet,
the fields that agree are counted in the xor of the signatures by bit counts: a
share of 1 / 2^BITS agrees by chance, which the similarity is corrected for. Pairs
whose estimate is too low for a link are dropped, and so are those whose parity
sketches differ in more bits than linked sets may in shingles, which never drops a
link; the others are confirmed on their full sets.

A link is lost only if no band agrees or the estimate falls below its bound. For a
pair exactly at the threshold the first has a chance of (1 - 0.85^4)^32 = 6e-11, the
second of less than LOST by the choice of ``fewest``; both fall fast above it.

Copies of a text share one set. Within a band every set is compared with the one
that meets most others; bands that then still hold several components are compared
across these, in blocks of bounded size, so a crowd of near copies is joined in
about as many comparisons as it has members.

Defined results: null and empty texts have no shingles and are linked with nothing;
a text of fewer than five words has one shingle, all its words; rows of one
``doc_id`` are judged each by its text; rows without a ``doc_id`` get no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import Words, mix64, partitions, prepare, saved, texts_of
from sieveworks.llm.graph import components
from sieveworks.llm.ngram_jaccard import distance, node_of, shingles, sketch_of, verified

#: Linked: 100 * intersection >= SHARE * union.
SHARE = 85
#: Minima in a band, bands, and bits kept of each minimum.
ROWS, BANDS, BITS = 4, 32, 2
HASHES = ROWS * BANDS
#: Most chance that the estimate drops a link at the threshold.
LOST = 1e-10
#: Sets of one band in one block, and shingles whose hashes are held at once.
BLOCK = 2048
CHUNK = 2048
_ODD = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_PLUS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_LOW = np.uint64(0x5555555555555555)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(s), CHUNK):
            out = np.minimum(out, (_ODD[:, None] * s[begin : begin + CHUNK] + _PLUS[:, None]).min(1))
    return out


def signature(least: np.ndarray) -> np.ndarray:
    """The low bits of all minima, packed into words of 64 bits."""
    fields = (mix64(least) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(fields << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), 1)


def bands(least: np.ndarray) -> np.ndarray:
    """One key for each band of minima."""
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key ^ rows[:, k])
    return key


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of fields in which packed signatures agree (BITS = 2)."""
    d = x ^ y
    return HASHES - np.bitwise_count((d | (d >> np.uint64(1))) & _LOW).sum(-1, dtype=np.int64)


def similarity(agree: np.ndarray) -> np.ndarray:
    """Similarity of two sets from the number of fields that agree, less those that agree by chance."""
    chance = 1 / (1 << BITS)
    return np.clip((agree / HASHES - chance) / (1 - chance), 0, 1)


def fewest(share: int = SHARE) -> int:
    """Fields that a pair at the threshold has in common but with a chance of LOST at most."""
    p = share / 100 + (1 - share / 100) / (1 << BITS)
    below, k = 0.0, 0
    while True:
        below += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > LOST:
            return k
        k += 1


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set), and for a set's first row in the task its signature, band keys and parity sketch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, seen = Words(), set()
        for batch in rows:
            n, node, packed, keys, sketch = [], [], [], [], []
            for text in texts_of(batch):
                s = shingles(text, scan)
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                if not len(s) or node[-1] in seen:
                    packed.append(None)
                    keys.append(None)
                    sketch.append(None)
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node[-1])
                least = minima(s)
                packed.append(signature(least).tobytes())
                keys.append(bands(least).view(np.int64))
                sketch.append(sketch_of(s))
            ids = pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in node], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), ids, pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "node", "signature", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, signature binary, bands array<long>, sketch binary")


def apart(n: int, m: int, share: int) -> int:
    """The most shingles in which linked sets of n and m differ."""
    return (n + m) * (100 - share) // (100 + share)


def likely(pairs: DataFrame, known: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) that signatures and sketches do not rule out."""
    least = fewest(share)
    side = lambda x: known.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "signature", "sketch")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint64).reshape(t.num_rows, -1) for k in ("signature_a", "signature_b"))
            t = t.filter(pa.array(agreeing(x, y) >= least))
            good = [distance(p, q) <= apart(n, m, share) for n, m, p, q in zip(*(t.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{x}" for c in ("n", "signature", "sketch") for x in "ab"))
    return rows.mapInArrow(run, "a long, b long")


def across(rows: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) of different roots within a block (key, i, j) that are not ruled out; rows: key, i, j, part, node, root, n, signature, sketch."""
    least = fewest(share)

    def compare(key: tuple, group: list[tuple], tried: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        if len(group) < 2:
            return
        part, node, root, size = (np.array([g[k] for g in group], np.int64) for k in range(4))
        x = np.frombuffer(b"".join(g[4] for g in group), np.uint64).reshape(len(group), -1)
        for begin in range(0, len(group), 64):
            some = slice(begin, begin + 64)
            near = agreeing(x[some, None, :], x[None, :, :]) >= least
            near &= (root[some, None] != root[None, :]) & (node[some, None] < node[None, :])
            if key[1] != key[2]:
                near &= part[some, None] != part[None, :]
            for a, b in zip(*np.nonzero(near), strict=True):
                a += begin
                pair = int(node[a]), int(node[b])
                if pair not in tried:
                    tried.add(pair)
                    if distance(group[a][5], group[b][5]) <= apart(int(size[a]), int(size[b]), share):
                        yield pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        tried: set[tuple[int, int]] = set()
        group: list[tuple] = []
        at: tuple = (0, 0, 0)

        def out() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [(), ()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != at:
                    found += compare(at, group, tried)
                    group, at = [], (key, i, j)
                    if len(tried) > 500_000:
                        tried.clear()
                    if len(found) > 20_000:
                        yield out()
                group.append(tuple(row))
        found += compare(at, group, tried)
        yield out()

    dealt = rows.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "part", "node", "root", "n", "signature", "sketch").mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, known: DataFrame, share: int = SHARE) -> DataFrame:
    """Confirmed links (a, b) between sets, enough of them to connect all that links connect. ``known``: node, doc, n, signature, bands, sketch."""
    member = known.select("node", F.explode("bands").alias("key"))
    met = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = saved(member.join(met, "key"), "bands")
    # the set of a band that is met in most bands stands for the others
    busy = member.groupBy("node").agg(F.count("*").alias("shared"))
    hub = member.join(busy, "node").groupBy("key").agg(F.max(F.struct("shared", "node")).alias("hub"))
    member = saved(member.join(hub.select("key", F.col("hub.node").alias("hub")), "key"), "hubs")
    stars = member.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    first = saved(verified(saved(likely(stars, known, share), "likely"), known, docs, share), "links")
    roots = components(first)
    # what is still apart within a band; a band of two sets has been looked at
    loose = member.where("size > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = loose.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("low <> high")
    blocks = loose.join(mixed.select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    rest = saved(across(blocks.join(known.select("node", "n", "signature", "sketch"), "node"), share), "likely")
    return first.unionByName(verified(rest, known, docs, share))


def clusters(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = saved(sets(docs), "sets")
    # rows without an id have no say, but may be the ones that carry the signature
    known = every.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"), F.first("signature", True).alias("signature"), F.first("bands", True).alias("bands"), F.first("sketch", True).alias("sketch"))
    known = saved(known.where("doc IS NOT NULL"), "nodes")
    roots = components(links(docs, known, share))
    least = roots.join(known.select("node", "doc"), "node").groupBy("root").agg(F.min("doc").alias("component"))
    named = known.select("node", "doc").join(roots, "node", "left").join(least, "root", "left").select("node", F.coalesce("component", "doc").alias("component"))
    out = every.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document. A row without an id is kept: nothing stands for it."""
    return clusters(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest ``doc_id``, in all rows of that id. Rows without an id stay."""
    found = clusters(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(found, docs["doc_id"].cast("long") == found["doc_id"], "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL"))
