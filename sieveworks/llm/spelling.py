"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

A pair one edit apart shares the first or the last half of its longer word, so the
index is dealt by length, side and half: words of that length are indexed there,
words one shorter look themselves up. What is left of a word beside the shared
half has m letters and, with its two borders, m + 1 positional bigrams. One edit
spoils two of them at most, so near words share m - 1 at the same place (or, for
the shorter word, at that place or the next). Postings are kept in ascending order
of rows: of a word's grams the rarest few, one more than an edit may spoil, are
merged by a heap, the longer lists are looked up by binary search, and pairs that
reach the bound are compared letter by letter.

Groups are blocks of bounded size: crowded ones are split into parts, and each two
parts meet in a task of their own. Nothing is dropped.

Defined results: null texts have no runs; a null ``doc_id`` counts as the empty
string in the check sum; repeated rows count each; letters are U+0041 to U+005A,
U+0061 to U+007A and U+00C0 to U+00FF, only the first of which have lower case here.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import partitions, prepare, saved

#: Words have at least so many letters and occurrences; a form occurs at least so many times as often as the word.
LETTERS, OCCURRENCES, MORE = 7, 2, 10
#: One run in so many loses a letter.
SPOILED = 31
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000
#: Rows and letters of one part of a crowded group.
BLOCK, BLOCK_LETTERS = 4096, 4 << 20
#: Latin-1 bytes that end a word become blanks, A-Z lower case.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs(text: str) -> list[bytes]:
    """The lower-cased letter runs of a text, as Latin-1."""
    return text.encode("latin-1", "replace").translate(_WORDS).split()


def spoiled(prefix: int, run: bytes) -> bytes:
    """The run, less one letter if its check sum after ``prefix`` says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % SPOILED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of LETTERS letters or more and how often they occur, where that is often enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(total.items())
            total.clear()
            for begin in range(0, len(items), 20_000):
                cut = items[begin : begin + 20_000]
                yield pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w, _ in cut], "n": [n for _, n in cut]}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(runs(text or "")).items():
                    if len(run) >= LETTERS and len(word := spoiled(prefix, run)) >= LETTERS:
                        total[word] += n
                if len(total) > FLUSH:
                    yield from out()
        yield from out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def dealt(counted: DataFrame) -> DataFrame:
    """(key, side, half, visitor, word, n): each word in the two groups of its length and in those of the next length.

    ``half`` is the number of letters before the cut. In a group of side 0 the
    letters before it are shared, in one of side 1 those after it.
    """
    size = F.length("word")
    members = counted.select("word", "n", size.alias("len"), F.lit(False).alias("visitor"))
    visitors = counted.select("word", "n", (size + 1).alias("len"), F.lit(True).alias("visitor"))
    both = members.unionByName(visitors).withColumn("half", F.floor(F.col("len") / 2).cast("int")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    shared = F.when(F.col("side") == 0, F.expr("left(word, half)")).otherwise(F.expr("right(word, len - half)"))
    return both.select(F.xxhash64("len", "side", shared).alias("key"), "side", "half", "len", "visitor", "word", "n")


def grams(word: str, side: int, half: int, length: int) -> list[str]:
    """Bigrams of the part that is not shared, borders included, in order of place."""
    if side == 0:
        rest = word[half - 1 :] + "$"
    else:
        rest = "^" + word[: len(word) - (length - half) + 1]
    return [rest[i : i + 2] for i in range(len(rest) - 1)]


def one_edit(s: str, t: str) -> bool:
    """Whether ``t``, as long as ``s`` or one longer, is one edit from it."""
    low, high = 0, len(s)  # the longest common prefix, by halving
    while low < high:
        mid = (low + high + 1) // 2
        if s[low:mid] == t[low:mid]:
            low = mid
        else:
            high = mid - 1
    return (low < len(s) and s[low + 1 :] == t[low + 1 :]) if len(s) == len(t) else s[low:] == t[low + 1 :]


class Postings:
    """Rows of one group by (place, bigram), in the order in which they came."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int]] = []
        self.lists: dict[tuple[int, str], list[int]] = {}

    def add(self, word: str, n: int, own: list[str]) -> None:
        row = len(self.rows)
        self.rows.append((word, n))
        for place in enumerate(own):
            self.lists.setdefault(place, []).append(row)

    def near(self, own: list[str], shift: int) -> Iterator[int]:
        """Rows that share all but two of an indexed word's grams with ``own``, at the same place or up to ``shift`` later."""
        get = self.lists.get
        by_gram = []
        for place, gram in enumerate(own):
            found = get((place, gram), ())
            by_gram.append((found, get((place + 1, gram), ())) if shift else (found,))
        bound = len(own) + shift - 2
        spare = len(own) - bound
        by_gram.sort(key=lambda x: sum(map(len, x)))
        rare, rest = by_gram[: spare + 1], by_gram[spare + 1 :]
        lists = [x for g in rare for x in g if x]
        if not lists:
            return
        last, count = -1, 0
        for row in [*(lists[0] if len(lists) == 1 else heapq.merge(*lists)), -2]:
            if row == last:
                count += 1
                continue
            if last >= 0:
                for k, several in enumerate(rest):
                    if count + len(rest) - k < bound:
                        break
                    for held in several:
                        at = bisect_left(held, last)
                        if at < len(held) and held[at] == last:
                            count += 1
                            break
                if count >= bound:
                    yield last
            last, count = row, 1


def compare(group: list[tuple], i: int, j: int) -> Iterator[tuple[str, int, str, int]]:
    """Near pairs (a, n_a, b, n_b) of the block of parts i and j, across them if they differ; rows: side, half, len, visitor, word, n, part."""
    for indexed in {i, j}:
        index = Postings()
        for side, half, length, visitor, word, n, part in group:
            if part == indexed and not visitor:
                own = grams(word, side, half, length)
                if i == j:
                    yield from found(index, word, n, own, 0, side, half)
                index.add(word, n, own)
        for side, half, length, visitor, word, n, part in group:
            # members across are looked up once, in the index of part i
            if visitor if i == j else part != indexed and (visitor or indexed == i):
                yield from found(index, word, n, grams(word, side, half, length), int(visitor), side, half)


def found(index: Postings, word: str, n: int, own: list[str], shift: int, side: int, half: int) -> Iterator[tuple[str, int, str, int]]:
    for row in index.near(own, shift):
        other, m = index.rows[row]
        # an insertion that could be on either side is told on the first
        if one_edit(word, other) and not (side and shift and word[:half] == other[:half]):
            yield word, n, other, m


def near_pairs(counted: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of each two near words, once."""
    rows = dealt(counted)
    size = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum("len").alias("letters"), F.min("visitor").alias("no_member"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("letters") / BLOCK_LETTERS)).cast("int")
    # a group of one row, or without a member, has no pair
    size = size.where("rows > 1 AND NOT no_member").select("key", blocks.alias("parts"))
    rows = rows.join(size, "key").withColumn("part", F.pmod(F.xxhash64("word", "visitor"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        at = (0, 0, 0)
        pairs: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*pairs, strict=True)) or [()] * 4
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], names=["a", "n_a", "b", "n_b"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != at:
                    pairs += compare(group, *at[1:])
                    group, at = [], (key, i, j)
                    if len(pairs) > 20_000:
                        yield out()
                group.append(tuple(row))
        pairs += compare(group, *at[1:])
        yield out()

    block = rows.select("key", "i", "j", "side", "half", "len", "visitor", "word", "n", "part")
    return block.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a string, n_a long, b string, n_b long")


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near) of every word."""
    prepare(docs.sparkSession)
    counted = saved(words(docs), "words")
    pairs = near_pairs(counted)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    most = -F.col("best.less")
    good = most >= MORE * F.col("n")
    out = counted.join(best, "word", "left")
    return out.select("word", "n", F.when(good, F.col("best.near")).alias("form"), F.when(good, most).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of words (word, form): the last of the forms that follow one another, by doubling steps.

    Each form occurs MORE times as often as its word, so chains are as long as the logarithm of a count.
    """
    step = saved(formed.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("last"))
        new = saved(step.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")), "roots")
        step = new.select("word", "root")
        if new.where("moved").isEmpty():
            return step


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per word."""
    found_ = saved(variants(docs), "variants")
    last = roots(found_.where("form IS NOT NULL"))
    return found_.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

