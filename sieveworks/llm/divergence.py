"""How the sources of a language differ in their words, from mergeable byte tries.

Each task counts its documents' terms in a radix trie of bytes for every language;
a leaf has, for each source, the occurrences and the number of documents. Tries are
handed on leaf by leaf, dealt out by ranges of (language, term), and each range's
leaves are merged into one trie again. Walking that trie gives the kept terms in
the order of their UTF-8 bytes, in pieces of bounded size; every piece adds to the
sums over pairs of sources and streams the best terms of each source, ties in that
order. All arithmetic is in integers.

A task holds one trie of FLUSH leaves at most, then one of its range of terms, then
a piece of PIECE terms with the counters of the language's sources. The number of
sources of a language is taken to be far below that of its terms: the pairs are
asked for, so the result itself grows with its square.

Defined results: null text, lang and source count as ''; repeated rows count each;
a language without a kept term has its pairs, all with value 0, and no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.llm.common import partitions, prepare, saved, texts_of

#: A term is kept if so many documents of its language have it.
DOCUMENTS = 10
#: Each count is raised by so much; shares are parts of SCALE.
RAISED, SCALE = 2, 1_000_000_000
#: Terms listed for each group.
RANKS = 10
#: Leaves of one task's tries, rows of counters that are added up at once, terms of one piece, and cells (terms by sources) that are worked on at once.
FLUSH, ADDED, PIECE, CELLS = 450_000, 600_000, 4096, 1 << 20
#: Bytes that end a term become blanks, A-Z lower case.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
LEAF = "term string, source array<string>, n array<long>, docs array<long>"


class Trie:
    """A radix trie of byte strings with numbered leaves. A node: label, children by first byte, number of its leaf."""

    __slots__ = ("root", "leaves")

    def __init__(self) -> None:
        self.root: list = [b"", None, None]
        self.leaves = 0

    def add(self, key: bytes) -> int:
        """The number of the key's leaf, which is made if need be."""
        node, at, size = self.root, 0, len(key)
        while at < size:
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(key[at])
            if child is None:
                node = children[key[at]] = [key[at:], None, None]
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = 1  # the label is cut where the key leaves it
            while same < len(label) and at + same < size and label[same] == key[at + same]:
                same += 1
            node = children[key[at]] = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            at += same
        if node[2] is None:
            node[2] = self.leaves
            self.leaves += 1
        return node[2]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Keys and their leaves, in order of bytes."""
        todo = [(b"", self.root)]
        while todo:
            prefix, (label, children, leaf) = todo.pop()
            key = prefix + label
            if leaf is not None:
                yield key, leaf
            if children:
                todo += [(key, children[b]) for b in sorted(children, reverse=True)]


class Counts:
    """The trie of one language with counters by leaf and source: rows (leaf, source, n, docs), added up now and then."""

    def __init__(self) -> None:
        self.trie = Trie()
        self.known: dict[bytes, int] = {}
        self.sources: dict[str, int] = {}
        self.rows = [np.zeros((4, 0), np.int64)]
        self.size = 0

    def leaf(self, terms: list[bytes]) -> np.ndarray:
        """The terms' leaves; the way down the trie is taken once for each."""
        known, out = self.known, []
        for term in terms:
            leaf = known.get(term)
            if leaf is None:
                leaf = known[term] = self.trie.add(term)
            out.append(leaf)
        return np.array(out, np.int64)

    def source(self, name: str) -> int:
        return self.sources.setdefault(name, len(self.sources))

    def add(self, leaf: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.rows.append(np.stack((leaf, source, n, docs)).astype(np.int64))
        self.size += len(leaf)
        if self.size > ADDED + 2 * self.rows[0].shape[1]:
            self.added_up()

    def added_up(self) -> np.ndarray:
        x = np.concatenate(self.rows, 1)
        x = x[:, np.lexsort((x[1], x[0]))]
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, x.shape[1]), bool), (np.diff(x[0]) != 0) | (np.diff(x[1]) != 0))))
        if len(begin):
            x = np.concatenate((x[:2, begin], np.add.reduceat(x[2:], begin, 1)))
        self.rows, self.size = [x], x.shape[1]
        return x

    def merge(self, terms: list[bytes], sources: pa.ListArray, n: np.ndarray, docs: np.ndarray) -> None:
        """Adds leaves of another trie."""
        lengths = sources.value_lengths().to_numpy(zero_copy_only=False)
        leaf = np.repeat(self.leaf(terms), lengths)
        coded = sources.flatten().dictionary_encode()
        own = np.array([self.source(x) for x in coded.dictionary.to_pylist()], np.int64)
        self.add(leaf, own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else leaf, n, docs)

    def leaves(self, least: int = 0) -> Iterator[tuple[list[bytes], pa.ListArray, pa.ListArray, pa.ListArray]]:
        """Terms in order of bytes, PIECE at a time, with lists of sources, occurrences and documents; only those of ``least`` documents."""
        x = self.added_up()
        first = np.searchsorted(x[0], np.arange(self.trie.leaves + 1))
        enough = np.add.reduceat(x[3], first[:-1]) >= least if self.trie.leaves else np.zeros(0, bool)
        walked = [(term, leaf) for term, leaf in self.trie.walk() if enough[leaf]]
        names = pa.array(list(self.sources), pa.string())
        for begin in range(0, len(walked), PIECE):
            terms, some = zip(*walked[begin : begin + PIECE], strict=True)
            some = np.array(some)
            size = first[some + 1] - first[some]
            ends = np.concatenate(([0], np.cumsum(size)))
            at = np.repeat(first[some] - ends[:-1], size) + np.arange(ends[-1])
            lists = (names.take(pa.array(x[1, at])), pa.array(x[2, at]), pa.array(x[3, at]))
            yield list(terms), *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in lists)


def counted(counts: Counts, texts: list[bytes], sources: list[str]) -> None:
    """Adds the terms of some documents of one language."""
    split = [t.translate(_TERMS).split() for t in texts]
    coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
    if not len(coded):
        return
    leaf = counts.leaf(coded.dictionary.to_pylist())
    wide = len(leaf)
    doc = np.repeat(np.arange(len(split)), [len(s) for s in split])
    # once for each document, then for each source
    pair, n = np.unique(doc * wide + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    source = np.array([counts.source(s) for s in sources], np.int64)[pair // wide]
    counts.add(leaf[pair % wide], source, n, np.ones_like(n))


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, docs) with one array entry for each source: the leaves of every task's tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Counts] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in tries.items():
                for terms, *lists in counts.leaves():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()), *lists], names=["lang", "term", "source", "n", "docs"])
            tries.clear()

        for batch in batches:
            lang, source, text = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts_of(batch)
            of: dict[str, list[int]] = {}
            for row, name in enumerate(lang):
                of.setdefault(name, []).append(row)
            for name, rows in of.items():
                counted(tries.setdefault(name, Counts()), [text[r] for r in rows], [source[r] for r in rows])
            if sum(c.trie.leaves for c in tries.values()) > FLUSH:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, f"lang string, {LEAF}")


def kept(leaf: DataFrame) -> DataFrame:
    """(lang, piece, place, term, source, n): the kept terms; ``place`` is their order in a piece of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Counts] = {}
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = batch.filter(pa.array(lang.indices.to_numpy(zero_copy_only=False) == k))
                n, docs = (own.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("n", "docs"))
                tries.setdefault(name, Counts()).merge(texts_of(own, "term"), own.column("source"), n, docs)
        piece = TaskContext.get().partitionId() << 32
        for name, counts in tries.items():
            for terms, source, n, _ in counts.leaves(DOCUMENTS):
                size = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array([name] * size, pa.string()), pa.array(np.full(size, piece), pa.int64()), pa.array(np.arange(size), pa.int32()), pa.array([t.decode() for t in terms], pa.string()), source, n], names=["lang", "piece", "place", "term", "source", "n"])
                piece += 1

    dealt = leaf.repartitionByRange(partitions(leaf.sparkSession), "lang", "term")
    return dealt.mapInArrow(run, "lang string, piece long, place int, term string, source array<string>, n array<long>")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + RAISED) / total) by long division in base 1000, so nothing overflows below totals of 9 * 10^15."""
    rest, out = count + RAISED, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compared(terms: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of each piece: sums for pairs of sources, and the best terms of each source.

    totals: lang, source, total (occurrences of kept terms), kept (terms of the language); every group has a row.
    """
    pieces = terms.select("lang", "piece").distinct()
    known = saved(pieces.join(totals, "lang"), "totals")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("place")
        right = right.sort_values("source")
        names = right["source"].tolist()
        at = {s: k for k, s in enumerate(names)}
        size, lang = len(names), right["lang"].iloc[0]
        floor = RAISED * int(right["kept"].iloc[0])
        total = right["total"].to_numpy(np.int64)
        of_lang, total = total.sum() + floor, total + floor
        sums = np.zeros((size, size), np.int64)
        best: list[list[tuple[int, str]]] = [[] for _ in names]
        words = left["term"].tolist()
        sources, counts = left["source"].tolist(), left["n"].tolist()
        step = max(1, CELLS // size)
        for begin in range(0, len(words), step):
            some = slice(begin, begin + step)
            c = np.zeros((len(words[some]), size), np.int64)
            for row, (s, n) in enumerate(zip(sources[some], counts[some], strict=True)):
                c[row, [at[x] for x in s]] = n
            p = shares(c, total)
            q = shares(c.sum(1, keepdims=True), of_lang)
            for k in range(size):
                sums[k] += distance(p, p[:, k : k + 1]).sum(0)
            f = np.where((c > 0) & (p > q), distance(p, q), -1)
            for k in range(size):
                order = np.argsort(-f[:, k], kind="stable")[:RANKS]  # ties stay in the order of the walk
                found = best[k] + [(int(f[i, k]), words[begin + i]) for i in order if f[i, k] >= 0]
                best[k] = sorted(found, key=lambda x: -x[0])[:RANKS]
        pairs = [(lang, names[i], "pair", names[j], int(sums[i, j])) for i in range(size) for j in range(size) if i != j]
        listed = [(lang, names[k], "term", w, v) for k in range(size) for v, w in best[k]]
        return pd.DataFrame(pairs + listed, columns=["lang", "source", "part", "item", "value"])

    return terms.groupBy("lang", "piece").cogroup(known.groupBy("lang", "piece")).applyInPandas(work, "lang string, source string, part string, item string, value long")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: pairs of sources and leading terms, ranked within each group and part."""
    prepare(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), "text")
    groups = saved(docs.select("lang", "source").distinct(), "groups")
    terms = saved(kept(saved(leaves(docs), "leaves")), "terms")
    each = terms.select("lang", F.explode(F.arrays_zip("source", "n")).alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    number = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = groups.join(each, ["lang", "source"], "left").join(number, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept")
    found = saved(compared(terms, totals), "compared")
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    listed = ranked(found.where("part = 'term'")).where(F.col("rank") <= RANKS)
    return ranked(pairs).unionByName(listed)
