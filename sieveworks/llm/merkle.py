"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are pieces of paragraphs (lines): a paragraph ends a piece, and so does,
within long ones, a word whose hash says so, so that an edit moves no other
boundary. Sections are runs of leaves, ended by a blank line or by a leaf whose
hash says so. Section hashes cover their leaves' hashes and the root covers the
sections'. The fingerprint is text: the root, then each section with its hash and
its leaves' hashes and lengths. Equal roots are equal texts; below differing
sections the leaves tell where they differ.

Edited texts need the next document by descending ``doc_id``. Documents are cut
into ranges of ids at quantiles, each range is sorted by itself, and each gets the
head of the next lower range as an extra last row, so no task sees all rows.

Defined results: a null text counts as empty, with the fingerprint of no leaves;
two empty texts are alike with 1.0; rows of equal ``doc_id`` follow each other by
the hash of their text; null ids come last.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import partitions, prepare, sha_hex

#: Characters a leaf has before a word may end it, characters after which any word does, and one word in so many that may.
LEAST = 32
MOST = 160
PIECE = 4
#: One leaf in so many ends a section.
SECTION = 8
WORD = re.compile(r"\S{1,32}\s{0,32}|\s{1,32}")


def leaves(text: str) -> list[str]:
    """The text cut into leaves; joined they are the text."""
    import xxhash

    out = []
    for paragraph in text.split("\n"):
        line = paragraph + "\n"
        if len(line) <= 2 * LEAST:
            out.append(line)
            continue
        begin = 0
        for m in WORD.finditer(line):
            if m.end() - begin >= MOST or m.end() - begin >= LEAST and xxhash.xxh3_64_intdigest(m[0]) % PIECE == 0:
                out.append(line[begin : m.end()])
                begin = m.end()
        if begin < len(line):
            out.append(line[begin:])
    out[-1] = out[-1][:-1]
    return [x for x in out if x]


def _hash(data: bytes, size: int) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def fingerprint(text: str) -> str:
    """``root|section:leaf.length,leaf.length|...``; hashes are hexadecimal, lengths in code points."""
    sections: list[list[tuple[str, int]]] = [[]]
    for leaf in leaves(text):
        h = _hash(leaf.encode(), 16)
        sections[-1].append((h, len(leaf)))
        if leaf == "\n" or int(h[:4], 16) % SECTION == 0:
            sections.append([])
    # nodes are hashed from whole digests; only the names that are written out are short
    rows = [(_hash(",".join(f"{h}.{n}" for h, n in s).encode(), 16), s) for s in sections if s]
    root = _hash("".join(h for h, _ in rows).encode(), 16)
    return "|".join([root, *(f"{h[:16]}:{','.join(f'{x[:10]}.{n}' for x, n in s)}" for h, s in rows)])


def likeness(a: str, b: str) -> float:
    """Share of two texts (by code points) under equal nodes: 1 for equal roots; equal sections are not opened."""
    if a.split("|", 1)[0] == b.split("|", 1)[0]:
        return 1.0

    def tree(x: str) -> dict[str, list[tuple[str, int]]]:
        out: dict[str, list] = {}
        for at, section in enumerate(x.split("|")[1:]):
            head, _, rest = section.partition(":")
            parts = [(h, int(n)) for h, _, n in (y.partition(".") for y in rest.split(","))]
            out[head if head not in out else f"{head}#{at}"] = parts
        return out

    left, right = tree(a), tree(b)
    size = sum(n for s in (*left.values(), *right.values()) for _, n in s)
    same = 0
    for head in left.keys() & right.keys():
        same += 2 * sum(n for _, n in left[head])
    open_left, open_right = ([x for h, s in mine.items() if h not in other for x in s] for mine, other in ((left, right), (right, left)))
    have: dict[tuple[str, int], int] = {}
    for x in open_left:
        have[x] = have.get(x, 0) + 1
    for x in open_right:
        if have.get(x, 0):
            have[x] -= 1
            same += 2 * x[1]
    return same / size if size else 1.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Spans of the first text (code points) under branches that the second lacks."""
    right = {x.partition(":")[0] for x in b.split("|")[1:]}
    known = {y for x in b.split("|")[1:] for y in x.partition(":")[2].split(",")}
    out: list[tuple[int, int]] = []
    at = 0
    for section in a.split("|")[1:]:
        head, _, rest = section.partition(":")
        for leaf in rest.split(","):
            size = int(leaf.partition(".")[2])
            if head not in right and leaf not in known:
                if out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + size)
                else:
                    out.append((at, at + size))
            at += size
    return out


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many first characters of the following one (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def ranges(docs: DataFrame, count: int) -> DataFrame:
    """``docs`` with ``range``: consecutive ids, highest in 0, null ids in the last; ``count`` ranges at most."""
    cuts = docs.select(F.expr(f"approx_percentile(doc_id, array({', '.join(str((i + 1) / count) for i in range(count - 1)) or '0.5'}), 10000)").alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    # a literal of as many numbers as there are ranges
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    return docs.withColumn("range", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(below))


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, range, tail): sorted ranges by descending id, each with the first row of the next as its tail."""
    spark = docs.sparkSession
    prepare(spark)
    docs = ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), partitions(spark))
    order = F.xxhash64("text")
    # one row for each range, found by id first; only texts of these ids are read
    top = docs.groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()
    first = {r["range"]: r["doc_id"] for r in sorted(top, key=lambda r: r["range"])}
    if not first:
        return docs.withColumn("tail", F.lit(False))
    numbers = list(first)
    heads = spark.createDataFrame([(first[numbers[(i + 1) % len(numbers)]], r, numbers[(i + 1) % len(numbers)]) for i, r in enumerate(numbers)], "head_id long, to_range int, from_range int")
    ids = [x for x in {*first.values()} if x is not None]
    wanted = docs.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()) if None in first.values() else docs.where(F.col("doc_id").isin(ids))
    # of equal ids, and of rows without one, the first in order is the head
    wanted = wanted.groupBy("range", "doc_id").agg(F.min(F.struct(order.alias("order"), F.col("text").alias("text"))).alias("least"))
    tails = wanted.join(F.broadcast(heads), (F.col("range") == F.col("from_range")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    tails = tails.select("doc_id", F.col("least.text").alias("text"), F.col("to_range").alias("range"), F.lit(True).alias("tail"))
    every = docs.withColumn("tail", F.lit(False)).unionByName(tails)
    return every.repartitionById(partitions(spark) + 1, F.col("range")).sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), order)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, with its fingerprint
        for batch in rows:
            out = []
            for doc, text, tail in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "tail")), strict=True):
                mine = fingerprint(text)
                if held:
                    changed = edited(held[1], text)
                    theirs = fingerprint(changed)
                    out.append((held[0], len(held[1]), sha_hex(changed.encode()), held[2], theirs, likeness(held[2], theirs), likeness(held[2], mine)))
                held = None if tail else (doc, text, mine)
            yield pa.RecordBatch.from_pydict({k: [x[i] for x in out] for i, k in enumerate(schema.names)}, schema)

    return followed(docs).select("doc_id", "text", "tail").mapInArrow(run, RESULT)
