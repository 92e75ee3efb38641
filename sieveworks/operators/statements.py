"""Ordered statements: neighbours in a block, and taint that flows through a function's assignments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.session import ship


def adjacent(statements: DataFrame, block: Sequence[str], order: str, *columns: str) -> DataFrame:
    """``statements`` with ``next_<column>`` of the following statement of the block; null at its end."""
    window = Window.partitionBy(*block).orderBy(order)
    return statements.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})


def independent_awaits(statements: DataFrame) -> DataFrame:
    """Awaits right after another whose result they do not read.

    statements: file, block, idx, line, is_await, defines array<string>, uses array<string>.
    """
    pairs = adjacent(statements, ["file", "block"], "idx", "is_await", "uses", "line")
    free = ~F.arrays_overlap(F.coalesce("defines", F.array().cast("array<string>")), F.coalesce("next_uses", F.array().cast("array<string>")))
    return pairs.where(F.col("is_await") & F.coalesce("next_is_await", F.lit(False)) & free).select("file", "block", "idx", "line", "next_line")


def late_guards(statements: DataFrame) -> DataFrame:
    """Awaits right before an early return that does not read what they wait for.

    statements: file, block, idx, line, is_await, is_guard, defines, uses.
    """
    pairs = adjacent(statements, ["file", "block"], "idx", "is_guard", "uses")
    free = ~F.arrays_overlap(F.coalesce("defines", F.array().cast("array<string>")), F.coalesce("next_uses", F.array().cast("array<string>")))
    return pairs.where(F.col("is_await") & F.coalesce("next_is_guard", F.lit(False)) & free).select("file", "block", "idx", "line")


def write_then_read(statements: DataFrame) -> DataFrame:
    """Loops in which a layout write comes right before a layout read: the first such place of each.

    statements: file, loop, idx, line, writes boolean, reads boolean.
    """
    pairs = adjacent(statements, ["file", "loop"], "idx", "reads")
    return pairs.where(F.col("writes") & F.coalesce("next_reads", F.lit(False))).groupBy("file", "loop").agg(F.min("line").alias("line"))


def tainted_sinks(statements: DataFrame) -> DataFrame:
    """Sinks that a tainted expression reaches, with where the taint came from.

    statements: fn, idx, line, target (assigned variable or null), is_source,
    reads array<string>, sink (kind or null). In order of idx a source taints the
    target and so does reading a tainted variable; nothing cleans a variable.
    Functions are sorted within their partition and streamed through in Arrow
    batches: a task holds the tainted variables of one function at a time.
    """
    spark = statements.sparkSession
    ship(spark)
    schema = pa.schema([("fn", pa.string()), ("line", pa.int32()), ("sink", pa.string()), ("source_line", pa.int32())])
    columns = ["fn", "line", "target", "is_source", "reads", "sink"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, origin = None, {}
        for batch in batches:
            out = []
            for fn, line, target, is_source, reads, sink in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if fn != current:
                    current, origin = fn, {}
                lines = [origin[x] for x in reads or () if x in origin]
                came = line if is_source else min(lines) if lines else None
                if came is None:
                    continue
                if sink is not None:
                    out.append((fn, line, sink, came))
                if target is not None:
                    origin.setdefault(target, came)
            yield pa.RecordBatch.from_pydict({k: [x[i] for x in out] for i, k in enumerate(schema.names)}, schema)

    rows = statements.select("fn", "idx", F.col("line").cast("int").alias("line"), "target", "is_source", "reads", "sink")
    dealt = rows.repartition("fn").sortWithinPartitions("fn", "idx").select(*columns)
    return dealt.mapInArrow(walk, "fn string, line int, sink string, source_line int")


#: Kinds of sinks in the order in which they are tried, with what their callee looks like.
SINKS = (
    ("prompt-injection", r"(?i)(chat\.completions|messages|responses|completions)\.create|generateText|streamText|generateContent"),
    ("nosql-query", r"\.(find|findOne|findOneAndUpdate|updateOne|updateMany|deleteOne|deleteMany|aggregate)$"),
    ("mass-assignment", r"\.(create|insertOne|insertMany|update|save)$|^Object\.assign$"),
    ("command-injection", r"^(child_process\.)?(exec|execSync|spawn|spawnSync|execFile)$"),
    ("code-injection", r"^(eval|Function|setTimeout|vm\.runInContext|vm\.runInNewContext)$"),
    ("ssrf", r"^(fetch|axios|got|request)$|^(axios|got)\."),
)


def sink_kind(callee: Column, sinks: Sequence[tuple[str, str]] = SINKS) -> Column:
    """The first kind whose pattern the callee matches; null for none."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(sinks):
        out = F.when(callee.rlike(pattern), kind).otherwise(out)
    return out
