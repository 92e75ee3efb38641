import json

from pyspark.sql import functions as F

from sieveworks.operators import report
from sieveworks.plans.schema import findings


def made(spark, rows):
    df = spark.createDataFrame(rows, "rule string, level string, file string, line int")
    return findings(df, "t", F.col("rule"), F.col("level"), "quality", F.lit("m"), "file", F.col("line"))


def score(spark, levels, files):
    rows = [("r", x, "f", 1) for x in levels]
    return report.score(made(spark, rows) if rows else made(spark, [("r", "info", "f", 1)]).where("false"), files).first()["score"]


def test_scores(spark):
    assert score(spark, [], 0) == 100
    assert score(spark, ["error"], 0) == 100
    assert score(spark, [], 10) == 100
    assert score(spark, ["error"], 10) == 95
    assert score(spark, ["error"] * 20, 10) == 0
    assert score(spark, ["warning"] * 5 + ["info"], 10) == 90
    assert score(spark, ["warning"] * 3 + ["info"] * 3, 10) == 93


def test_order_and_top_files(spark):
    df = made(spark, [("b", "info", "a", 1), ("a", "error", "b", 9), ("c", "error", "b", 2), ("d", "warning", None, None)])
    assert [r["rule_id"] for r in report.ordered(df).collect()] == ["c", "a", "d", "b"]
    assert [tuple(r) for r in report.top_files(df).collect()] == [("b", 2), ("a", 1)]
    assert report.failed(df).first()["exit_status"] == 1


def test_duplicates_keep_the_first(spark):
    df = report.union([made(spark, [("a", "info", "f", 1), ("a", "info", "f", 1)]), made(spark, [("a", "info", "f", 1), ("b", "info", "f", 1)])])
    assert report.deduplicated(df).count() == 2
    assert report.per_line(df).count() == 2


def test_snippets_are_clipped_and_marked(spark):
    files = spark.createDataFrame([("f", "one\ntwo\nthree\r\nfour\n")], "file string, content string")
    got = {r["line"]: r["snippet"] for r in report.with_snippets(made(spark, [("a", "info", "f", n) for n in (1, 4, 6, 9)] + [("a", "info", "gone", 1)]), files).where("file = 'f'").collect()}
    assert got[1] == "> 1 | one\n  2 | two\n  3 | three"
    assert got[4] == "  2 | two\n  3 | three\n> 4 | four"
    assert got[6] == "  4 | four"
    assert got[9] == ""


def test_text_and_json(spark):
    df = made(spark, [("a", "error", "f", 3)])
    assert "Health 95/100" in report.as_text(df, 10)
    assert json.loads(report.as_json(df, 10))["summary"]["top_files"] == [{"file": "f", "count": 1}]


def test_reports_hold_every_finding(spark):
    n = 1500
    raw = spark.range(n).select(F.lit("r").alias("rule"), F.concat(F.lit("f"), "id").alias("path"))
    df = findings(raw, "a", F.col("rule"), F.lit("error"), F.lit("bug"), F.lit("m"), "path", F.lit(1))
    assert len(json.loads(report.as_json(df, 10))["findings"]) == n and report.as_text(df, 10).count("[error/bug]") == n
