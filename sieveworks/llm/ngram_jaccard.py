"""N-gram Jaccard join with parity sketches.

A text's set of word shingles is drawn into a sketch of bands by size class: every
shingle flips a pattern of 64 bits in one band (xor). Two sets differ in at least
as many shingles as bands, so the Hamming distance of sketches, counted in bands,
bounds the symmetric difference from below. J >= 0.75 allows D = (|A| + |B|) / 7
differing shingles at most; by the pigeonhole principle the first D + 1 + h bands
that are not empty hold 1 + h that both have, and those are joined. Sets of a size
class and those just above it meet in that class's sketch.

Sets, not documents, are joined: copies share one. A set with fewer bands in
common with any others than a link needs can have no link and is dropped (this
clears sets that only share boilerplate, without looking at a pair). In what is
left each band's most central set stands for the others, and pairs with it are
candidates. Candidates whose plain bit sketches (one parity bit for each shingle)
are farther apart than D go; the rest are verified on the words of the texts.
Where a band still holds several components, all its sets are compared by their
bit sketches across components, in blocks of bounded size, and near ones verified.
There a set leaves out its most crowded bands, one fewer than a link must share.

Defined results: null and empty texts have no shingles and are linked with
nothing; a text of fewer than five words has one shingle, all its words; rows of
one ``doc_id`` are judged each by its text; rows without a ``doc_id`` get no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.llm.common import Words, grams, mix64, partitions, prepare, saved, texts_of
from sieveworks.llm.graph import components

SHINGLE = 5
#: Linked: 100 * intersection >= 75 * union, so the difference is at most a seventh of both sizes together.
SHARE, WHOLE, SEVENTH = 75, 100, 7
#: Words are cut at ASCII white space; A-Z in lower case.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Keys a task gathers before it deals them to the shards, and keys of one packed row: rows stay far below what a JVM must place as one huge object.
FLUSH = 3_000_000
PACKED = 8192
#: Most rows that are broadcast (of one number each); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Sets of one band that are compared in one block, and rows of one hub's bands that one task compares.
BLOCK = 2048
TASK_ROWS = 20_000
HUB_BANDS = 128
#: Partners of a set that one task verifies.
PARTNERS = 256


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def shingles(text: bytes, scan: Words) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    h = scan.scan(text.translate(LOWER))[2]
    if not len(h):
        return h
    s = np.sort(grams(h, SHINGLE) if len(h) >= SHINGLE else grams(h, len(h)) ^ np.uint64(len(h)))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def spare(n: int) -> int:
    """Bands beyond those the pigeonhole needs: they let sets be dropped that share few."""
    return 4 + n // 10


def bands_of(s: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Band keys of a set, class by class, and the least number that it shares with any set it is linked to."""
    n = len(s)
    most = n * (WHOLE + SHARE) // (SHARE * SEVENTH)  # with the largest partner, n / 0.75
    keys, least = [], n
    top = n.bit_length() - 1
    low = top - 1 if top and n * SHARE <= ((1 << top) - 1) * WHOLE else top
    for size_class in range(low, top + 1):
        count = max(256, 4 << size_class)
        band = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
        sketch = np.bitwise_xor.reduceat(s, begin)
        key = mix64(sketch ^ mix64(band[begin] * np.uint64(64) + np.uint64(size_class)))
        found = len(begin)
        if found <= most:  # the pigeonhole fails: the set is also known by each of its shingles
            key, least = np.concatenate((key, mix64(s ^ np.uint64(size_class + 1)))), 1
        else:
            key = key[: most + 1 + spare(n)]
            least = min(least, 1 + spare(-(-n * SHARE // WHOLE)), found - most)
        keys.append(key)
    return keys, max(1, least)


def sketch_of(s: np.ndarray) -> bytes:
    """One parity bit for each shingle, of some eight bits a shingle: its Hamming distance bounds the difference from below."""
    size = max(512, 8 << (len(s).bit_length() - 1))
    bits = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> bytes:
    """The sketch of fewer bits of the same set."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size)).tobytes() if len(sketch) > size else sketch


def distance(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return (int.from_bytes(folded(a, size)) ^ int.from_bytes(folded(b, size))).bit_count()


def node_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))


def _signed(x: list[int] | np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set), bit sketch and the least number of shared bands of a link."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Words()
        for batch in rows:
            n, node, least, sketch = [], [], [], []
            for text in texts_of(batch):
                s = shingles(text, scan)
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                least.append(bands_of(s)[1] if len(s) else 0)
                sketch.append(sketch_of(s) if len(s) else None)
            ids = pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in node], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), ids, pa.array(least, pa.int64()), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "node", "least", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, least long, sketch binary")


def band_keys(docs: DataFrame, shards: int) -> DataFrame:
    """Packed (key, node) pairs for each shard; a set met again in the task is not repeated."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, seen = Words(), set()
        keys: list[np.ndarray] = []
        nodes: list[int] = []
        size = 0

        def deal() -> Iterator[pa.RecordBatch]:
            k = np.concatenate(keys)
            v = np.repeat(np.array(nodes, np.uint64), [len(x) for x in keys])
            shard = (k % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            k, v, ends = k[order], v[order], np.cumsum(np.bincount(shard, minlength=shards))
            for i in range(shards):
                at = range(ends[i - 1] if i else 0, ends[i], PACKED)
                cut = [slice(b, min(b + PACKED, ends[i])) for b in at]
                if cut:
                    yield pa.RecordBatch.from_pydict({"shard": [i] * len(cut), "keys": [k[x].tobytes() for x in cut], "nodes": [v[x].tobytes() for x in cut]}, pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary())]))

        for batch in rows:
            for text in texts_of(batch):
                s = shingles(text, scan)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) < 2_000_000:
                    seen.add(node)
                for k in bands_of(s)[0]:
                    keys.append(k)
                    nodes.append(node)
                    size += len(k)
            if size > FLUSH:
                yield from deal()
                keys, nodes, size = [], [], 0
        if keys:
            yield from deal()

    return docs.mapInArrow(run, "shard int, keys binary, nodes binary")


def memberships(packed: DataFrame, shards: int) -> DataFrame:
    """(key, node) of the bands that two sets or more have."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []
        for batch in rows:
            keys += [np.frombuffer(x, np.uint64) for x in batch.column("keys").to_pylist()]
            nodes += [np.frombuffer(x, np.uint64) for x in batch.column("nodes").to_pylist()]
        if not keys:
            return
        k = np.concatenate(keys)
        order = np.argsort(k)
        k = k[order]
        same = k[1:] == k[:-1]
        shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        k, v = k[shared], np.concatenate(nodes)[order[shared]]
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        one = np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1]))) if len(k) else np.zeros(0, bool)
        k, v = k[one], v[one]
        same = k[1:] == k[:-1]
        shared = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(k) else np.zeros(0, bool)
        for begin in range(0, int(shared.sum()), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(_signed(k[shared][begin : begin + 100_000])), pa.array(_signed(v[shared][begin : begin + 100_000]))], names=["key", "node"])

    return packed.repartitionById(shards, F.col("shard")).select("keys", "nodes").mapInArrow(run, "key long, node long")


def verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) of sets of which ``share`` of a hundred shingles are common, by the words of one text of each.

    A set b with many partners is dealt to several tasks: each has its text once,
    before the texts of its part of the partners.
    """
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known.select("node", "doc"), "node"), "candidates")
    small = ids.count() <= BROADCAST_ROWS
    wanted = F.broadcast(ids) if small else ids
    # rows of one id may differ: only the row whose set is the node stands for it
    texts = sets_with_text(docs.join(wanted.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "text", "node"))
    texts = saved(texts, "texts")
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    split = pairs.select("a", "b").join(size, "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts"))
    hubs = size.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    left = split.join(texts.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "text")
    right = hubs.join(texts.withColumnRenamed("node", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")

    def of(text: bytes) -> set:
        w = words_of(text)
        return set(zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else {tuple(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set = set()
        for batch in batches:
            good = []
            for a, text in zip(batch.column("a").to_pylist(), texts_of(batch), strict=True):
                x = of(text)
                if a is None:
                    own = x
                both = len(x & own)
                good.append(a is not None and WHOLE * both >= share * (len(x) + len(own) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    dealt = left.unionByName(right).repartition(partitions(docs.sparkSession), "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return dealt.select("b", "a", "text").mapInArrow(run, "a long, b long")


def sets_with_text(rows: DataFrame) -> DataFrame:
    """One (node, text) for each node, from rows (doc_id, text, node) whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Words()
        for batch in batches:
            good = []
            for text, node in zip(texts_of(batch), batch.column("node").to_pylist(), strict=True):
                s = shingles(text, scan)
                good.append(len(s) > 0 and node_of(s) == node % (1 << 64))
            yield batch.select(["node", "text"]).filter(pa.array(good, pa.bool_()))

    # ids that repeat with one text give it more than once
    return rows.mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def near(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bit sketches do not rule a link out."""
    side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            c = {k: t.column(k).to_pylist() for k in ("n_a", "n_b", "sketch_a", "sketch_b")}
            good = [distance(x, y) <= (n + m) // SEVENTH for n, m, x, y in zip(*c.values(), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return rows.mapInArrow(run, "a long, b long")


def across(rows: DataFrame) -> DataFrame:
    """Near pairs (a, b) of different roots within (key, i, j); rows: hub, crowd, key, i, j, part, node, root, n, sketch.

    Where i and j differ, sets of part i are compared with those of part j only.
    Bands of one hub are compared by few tasks, each of a bounded number of rows:
    they mostly hold the same sets, so a task finds a pair once for all its bands.
    """

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        _, i, j = group[0][:3]
        if len({g[5] for g in group}) < 2:
            return
        size = min(len(g[7]) for g in group)
        x = np.frombuffer(b"".join(folded(g[7], size) for g in group), np.uint64).reshape(len(group), -1)
        part, node, root, n = (np.array([g[k] for g in group], np.int64) for k in (3, 4, 5, 6))
        for begin in range(0, len(group), 64):
            rows = slice(begin, begin + 64)
            near_ = np.bitwise_count(x[rows, None, :] ^ x[None, :, :]).sum(-1, dtype=np.int64) <= (n[rows, None] + n[None, :]) // SEVENTH
            near_ &= (root[rows, None] != root[None, :]) & (node[rows, None] < node[None, :])
            if i != j:
                near_ &= part[rows, None] != part[None, :]
            for a, b in zip(*np.nonzero(near_), strict=True):
                yield int(node[begin + a]), int(node[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        group: list[tuple] = []

        def out() -> pa.RecordBatch:
            pairs = list(found)
            found.clear()
            return pa.RecordBatch.from_pydict({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    found.update(compare(group))
                    group = []
                    if len(found) > 200_000:
                        yield out()
                group.append(row)
        if group:
            found.update(compare(group))
        yield out()

    # a hub's bands are some hundred at most, each about as crowded
    salt = F.pmod(F.xxhash64("key", "i", "j"), F.ceil(F.col("crowd") * HUB_BANDS / TASK_ROWS))
    dealt = rows.withColumn("salt", salt).repartition(partitions(rows.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "key", "i", "j")
    return dealt.select("key", "i", "j", "part", "node", "root", "n", "sketch").mapInArrow(run, "a long, b long").distinct()


def shared_bands(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(key, node, size, hub, least, shared) of bands of two sets or more, of the sets that may have links."""
    shards = partitions(docs.sparkSession)
    member = saved(memberships(band_keys(docs.select("text"), shards), shards), "bands")
    # sets that share fewer bands with all others together than a link takes have none
    enough = member.groupBy("node").agg(F.count("*").alias("shared")).join(known.select("node", "least"), "node").where("shared >= least")
    member = member.join(enough, "node")
    size = member.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("shared", "node")).alias("hub"))
    return saved(member.join(size.where("size > 1").select("key", "size", F.col("hub.node").alias("hub")), "key"), "bands")


def blocks_of(apart: DataFrame, member: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``across`` from bands (key, hub, size, node, least, root): those of several roots, in blocks of bounded size."""
    # of the bands of a set the least - 1 most crowded may go: the set and a partner share one of the others
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("size").desc(), "key"))
    shared = member.groupBy("node").agg(F.count("*").alias("bands"))
    apart = apart.withColumn("place", place).join(shared, "node").where(F.col("place") >= F.least("least", "bands")).drop("place")
    mixed = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("crowd")).where("low <> high")
    apart = apart.join(mixed.select("key", "crowd"), "key").join(known.select("node", "n", "sketch"), "node")
    count = F.ceil(F.col("crowd") / BLOCK).cast("int")
    apart = apart.withColumn("part", F.pmod(F.xxhash64("node"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return apart.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))


def all_links(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Every link (a, b) between sets, once: all pairs of a band are compared by their bit sketches, and near ones verified."""
    member = shared_bands(docs, known)
    apart = member.select("key", "hub", "size", "node", "least", F.col("node").alias("root"))
    return saved(verified(saved(across(blocks_of(apart, member, known)), "near"), known, docs), "links")


def links(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) between sets: enough of them to connect all that links connect. ``known``: node, doc, n, least, sketch."""
    member = shared_bands(docs, known)
    # each set and the hubs of its bands
    stars = member.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    first = saved(verified(saved(near(stars, known), "near"), known, docs), "links")
    roots = components(first)
    # what is still apart within a band; a band of two sets has been looked at
    apart = member.where("size > 2").join(roots, "node", "left").select("key", "hub", "size", "node", "least", F.coalesce("root", "node").alias("root"))
    second = verified(saved(across(blocks_of(apart, member, known)), "near"), known, docs)
    return first.unionByName(second)


def clusters(docs: DataFrame, counted: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    If ``counted``, every link is searched, not only enough for components, and
    n_links is the number of other rows with an id that the row is linked to, copies included.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = saved(sets(docs), "sets")
    known = saved(every.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"), F.max("least").alias("least"), F.max("sketch").alias("sketch")), "nodes")
    found = all_links(docs, known) if counted else links(docs, known)
    roots = components(found)
    grouped = known.join(roots, "node").groupBy("root").agg(F.min("doc").alias("component"))
    named = roots.join(grouped, "root").select("node", "component")
    named = known.join(named, "node", "left").select("node", F.coalesce("component", "doc").alias("component"))
    out = every.drop("sketch").join(named, "node", "left")
    columns = ["doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")]
    if counted:
        copies = saved(every.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies")), "copies")
        both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        linked = both.join(copies.toDF("b", "others"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
        out = out.join(copies.join(linked, "node", "left"), "node", "left")
        columns.append(F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0))).alias("n_links"))
    return out.select(*columns)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    return clusters(docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest ``doc_id``, in all rows of that id. Rows without an id stay."""
    found = clusters(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(found, docs["doc_id"].cast("long") == found["doc_id"], "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL"))
