"""Rules that compare sizes and counts with limits: complexity, repeated literals, splitting, risk.

Rules are relations too; they are few, so a rule table is a broadcast side of a
checked kind: the functions take rules as Python rows and build literals of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of a limit that count as near it.
NEAR, SOME = 0.6, 0.25


@dataclass(frozen=True)
class ComplexityRule:
    id: str
    type: str
    max_lines: int = 0
    max_inputs: int = 0
    max_deps: int = 0
    message: str = ""


def _part(limit: int, share: float) -> int:
    return int(limit * share)


def too_complex(rule: ComplexityRule, lines: Column, inputs: Column, deps: Column, kind: Column) -> Column:
    """A count over its limit fires; size fires only where a count is near its limit too."""
    over = F.lit(False)
    near = F.lit(False)
    if rule.max_inputs > 0:
        over = over | (inputs >= rule.max_inputs)
        near = near | (inputs >= _part(rule.max_inputs, NEAR))
    if rule.max_deps > 0:
        long_enough = F.lit(True) if rule.max_lines <= 0 else lines >= _part(rule.max_lines, SOME)
        over = over | ((deps >= rule.max_deps) & (~kind.isin("function", "component") | long_enough))
        near = near | (deps >= _part(rule.max_deps, NEAR))
    large = lines >= _part(rule.max_lines, NEAR) if rule.max_lines > 0 else F.lit(False)
    return over | (large & near)


def complexity(entities: DataFrame, rules: Sequence[ComplexityRule]) -> DataFrame:
    """(rule_id, file, name, type, line, line_count, inputs, deps) of entities that a rule of their type (or ``all``) flags."""
    fired = F.filter(
        F.array(*(F.when((F.col("type").isin(r.type) | F.lit(r.type == "all")) & too_complex(r, F.col("line_count"), F.col("inputs"), F.col("deps"), F.col("type")), F.lit(r.id)) for r in rules)),
        lambda x: x.isNotNull(),
    )
    return entities.withColumn("rule_id", F.explode(fired)).select("rule_id", "file", "name", "type", F.col("start_line").alias("line"), "line_count", "inputs", "deps")


def duplication(literals: DataFrame, string_from: int = 4, number_from: int = 3, other_from: int = 0, most: int = 5) -> DataFrame:
    """(file, kind, value, count, line): literals repeated in a file often enough, the first ``most`` by line.

    Ties of lines go by kind and value. Counting is by (file, kind, value) with
    partial sums; only what is over its threshold is ranked within a file.
    """
    counted = literals.groupBy("file", "kind", "value").agg(F.count("*").alias("count"), F.min("line").alias("line"))
    enough = F.when(F.col("kind") == "string", string_from).when(F.col("kind") == "number", number_from).otherwise(other_from)
    kept = counted.where((enough > 0) & (F.col("count") >= enough))
    if most <= 0:
        return kept
    place = F.row_number().over(Window.partitionBy("file").orderBy("line", "kind", "value"))
    return kept.withColumn("place", place).where(F.col("place") <= most).drop("place")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once for each row wherever the optimizer puts the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def duplication_by_row(files: DataFrame, kind: Callable[[Column], Column], may_be: Callable[[Column], Column], string_from: int = 4, number_from: int = 3, most: int = 5) -> DataFrame:
    """``duplication`` of files that are one row each, (file, words by line), counted within the row, so nothing is shuffled.

    Words that ``may_be`` literals are sorted as plain strings: one that begins a run
    is repeated often enough if the one so many places on equals it. Only such a word
    is asked for its ``kind`` (null: none), and only the first ``most`` of a file for
    count and line.
    """
    least = min(string_from, number_from)

    def often(words: Column) -> Column:
        equal = lambda i, x: F.coalesce(F.get(words, i) == x, F.lit(False))
        enough = lambda x, i: F.coalesce(equal(i + F.when(kind(x) == "string", string_from - 1).when(kind(x) == "number", number_from - 1), x), F.lit(False))
        return F.filter(words, lambda x, i: equal(i + (least - 1), x) & ~equal(i - 1, x) & enough(x, i))

    def first(words: Column, literals: Column) -> Column:
        count = lambda x: F.size(F.filter(literals, lambda y: y == x)).cast("long")
        told = lambda x: F.struct(kind(x).alias("kind"), x.alias("value"), count(x).alias("count"), F.array_position(words, x).cast("int").alias("line"))
        # an intersection keeps the order of words, which is that of lines
        return F.transform(F.slice(F.array_intersect(words, often(literals)), 1, most), told)

    found = once(F.col("words"), lambda words: once(F.sort_array(F.filter(words, may_be)), lambda literals: first(words, literals)))
    # the outer form, since the optimizer has the plain one worked out twice
    return files.select("file", F.inline_outer(found)).where("value IS NOT NULL")


def splitting(files: DataFrame, components: DataFrame, max_file_lines: int = 300, max_component_lines: int = 150, allowed: int = 1) -> DataFrame:
    """(file, total_lines, large, line): long files with more than ``allowed`` large exported components; line of the first one too many."""
    large = components.where(F.col("is_exported") & (F.col("line_count") >= max_component_lines)).select("file", "start_line", "name")
    place = large.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("start_line", "name")))
    found = place.groupBy("file").agg(F.count("*").alias("large"), F.max(F.when(F.col("place") == allowed + 1, F.col("start_line"))).alias("line")).where(F.col("large") > allowed)
    return files.where(F.col("total_lines") >= max_file_lines).join(found, "file").select("file", "total_lines", "large", "line")


def risky_files(commits: DataFrame, scope: DataFrame | None = None, least: int = 3, about: str = "(?i)fix|bug|security|vuln|cve") -> DataFrame:
    """(file, commits): files that at least ``least`` commits with such a message touch, within ``scope`` (file)."""
    touched = commits.where(F.col("message").rlike(about)).select("sha", F.explode("files").alias("file"))
    counted = touched.groupBy("file").agg(F.count("*").alias("commits")).where(F.col("commits") >= least)
    return counted if scope is None else counted.join(scope.select("file").distinct(), "file", "left_semi")
