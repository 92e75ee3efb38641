"""From findings to a report: union, order, deduplication, snippets, counts, score, text and JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS = 2
TOP_FILES = 5


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """All analyzers' findings, with the place of the analyzer that gave them."""
    return reduce(DataFrame.unionByName, (p.withColumn("analyzer_seq", F.lit(i)) for i, p in enumerate(parts)))


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, file, line; ties by analyzer, then by rule and message, so the order is total."""
    last = [c for c in ("analyzer_seq", "rule_id", "message") if c in findings.columns]
    return findings.orderBy("severity", F.col("file").asc_nulls_first(), F.col("line").asc_nulls_first(), *last)


def deduplicated(findings: DataFrame, *keys: str) -> DataFrame:
    """One finding for each key (by default rule, file, line and message): the first in order."""
    keys = keys or ("rule_id", "file", "line", "message")
    order = [c for c in ("analyzer_seq", "line", "message") if c in findings.columns]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return findings.withColumn("__place", place).where("__place = 1").drop("__place")


def per_line(findings: DataFrame) -> DataFrame:
    """One finding for each rule and line."""
    return deduplicated(findings, "rule_id", "file", "line")


def health(errors: Column, warnings: Column, rest: Column, files: Column) -> Column:
    """0 to 100: findings weighed against ten a file; 100 without files; halves round up."""
    load = (5.0 * errors + 2.0 * warnings + 0.5 * rest) / (10.0 * files)
    return F.when(files == 0, 100).otherwise(F.floor((1.0 - F.least(F.lit(1.0), load)) * 100.0 + 0.5)).cast("int")


def score(findings: DataFrame, file_count: int | Column) -> DataFrame:
    """One row: the health score of findings over so many files. Levels other than error and warning weigh least."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = findings.agg(
        F.coalesce(n(F.col("level") == "error"), F.lit(0)).alias("errors"), F.coalesce(n(F.col("level") == "warning"), F.lit(0)).alias("warnings"),
        F.coalesce(n(~F.col("level").isin("error", "warning")), F.lit(0)).alias("rest"), F.count("*").alias("total"),
    )
    files = F.lit(file_count) if isinstance(file_count, int) else file_count
    return sums.withColumn("score", health(F.col("errors"), F.col("warnings"), F.col("rest"), files))


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level").agg(F.count("*").alias("n"))


def top_files(findings: DataFrame, most: int = TOP_FILES) -> DataFrame:
    """Files with the most findings; a top-k, so each task keeps ``most`` rows only."""
    named = findings.where(F.col("file").isNotNull() & (F.col("file") != ""))
    return named.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "file").limit(most)


def failed(findings: DataFrame) -> DataFrame:
    """One row: exit status 1 if a finding is an error."""
    return findings.agg(F.coalesce(F.max(F.when(F.col("severity") == 0, 1).otherwise(0)), F.lit(0)).alias("exit_status"))


def snippet(lines: Column, line: Column, radius: int = RADIUS) -> Column:
    """Numbered lines around ``line`` of an array of lines; the line itself is marked. Outside the file: empty."""
    first, last = F.greatest(line - radius, F.lit(1)), F.least(line + radius, F.size(lines))
    mark = lambda i: F.concat(F.when(i == line, F.lit("> ")).otherwise(F.lit("  ")), i.cast("string"), F.lit(" | "), F.try_element_at(lines, i))
    shown = F.transform(F.sequence(first, last), mark)
    return F.when((line >= 1) & (first <= last), F.array_join(shown, "\n")).otherwise(F.lit(""))


def with_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the text around their line. Files (file, content) are split once, and only those with findings."""
    wanted = findings.where("line IS NOT NULL").select("file").distinct()
    text = F.regexp_replace("content", r"\r?\n\z", "")
    lines = files.join(wanted, "file", "left_semi").select("file", F.split(text, r"\r?\n", -1).alias("__lines"))
    return findings.drop("snippet").join(lines, "file", "left").withColumn("snippet", F.coalesce(snippet(F.col("__lines"), F.col("line")), F.lit(""))).drop("__lines")


def summary(findings: DataFrame, file_count: int) -> dict:
    """Counts, score and top files as a small dictionary."""
    row = score(findings, file_count).first()
    by_level = {r["level"]: r["n"] for r in counts(findings).collect()}
    return {"total": row["total"], "counts": by_level, "score": row["score"], "top_files": [{"file": r["file"], "count": r["n"]} for r in top_files(findings).collect()]}


def as_json(findings: DataFrame, file_count: int) -> str:
    """The report of all findings as one JSON text, row by row from the executors (for very many, write the relation itself)."""
    told = ordered(findings).select(F.to_json(F.struct(*[c for c in findings.columns if c != "analyzer_seq"])))
    rows = [json.loads(r[0]) for r in told.toLocalIterator()]
    return json.dumps({"findings": rows, "summary": summary(findings, file_count)}, indent=2, ensure_ascii=False)


def as_text(findings: DataFrame, file_count: int) -> str:
    """The report of all findings for a terminal."""
    told = summary(findings, file_count)
    out = [f"Health {told['score']}/100, findings: {told['total']}"]
    out += [f"  {level}: {n}" for level, n in sorted(told["counts"].items())]
    out += ["Hotspots:"] * bool(told["top_files"]) + [f"  {x['file']} ({x['count']})" for x in told["top_files"]]
    for r in ordered(findings).toLocalIterator():
        tag = f"{r['level']}/{r['category']}" if r["category"] else r["level"]
        hint = " hint" if r["confidence"] == "hint" else ""
        place = f"{r['file']}:{r['line']}" if r["line"] else r["file"] or "-"
        out.append(f"[{tag}{hint}] {r['rule_id']} {place}\n    {r['message']}" + (f"\n    fix: {r['fix']}" if r["fix"] else ""))
    return "\n".join(out)
