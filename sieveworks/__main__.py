"""``python -m sieveworks scan|context|explain|doctor``: the command line."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import context, report
from sieveworks.plans.patterns import load_rules
from sieveworks.plans.scan import Corpus, scan
from sieveworks.sources import files as sources
from sieveworks.sources import payloads


#: Bytes of source text for each shuffle partition.
PARTITION_BYTES = 4 << 20


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("sieveworks").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _corpus(args: argparse.Namespace, *more, **known) -> Corpus:
    """The files of a folder, with as many shuffle partitions as their size calls for: a loop's rounds cost as much as their tasks."""
    spark = _session()
    files = sources.files(spark, args.path)
    size = files.agg(F.sum("n_bytes")).first()[0] or 0
    spark.conf.set("spark.sql.shuffle.partitions", str(max(4, -(-size // PARTITION_BYTES))))
    return Corpus(files, *more, **known)


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in df.select(F.to_json(F.struct(*df.columns))).toPandas().iloc[:, 0]]


def run_scan(args: argparse.Namespace) -> int:
    spark = _session()
    changed = sources.changed(spark.read.text(args.status), deletions=True) if args.status else None
    commits = sources.commits(spark.read.text(args.log)) if args.log else None
    rules = [rule for folder in args.rules for rule in load_rules(folder)]
    reports = payloads.reports(spark, [tuple(r.split("=", 1)) for r in args.report]) if args.report else None
    corpus = _corpus(args, commits, changed, code_rules=rules, reports=reports)
    found = scan(corpus).cache()
    as_json = args.json or not sys.stdout.isatty()
    print((report.as_json if as_json else report.as_text)(found, corpus.file_count))
    return report.failed(found).first()["exit_status"]


def run_context(args: argparse.Namespace) -> int:
    corpus = _corpus(args)
    f, edges = corpus.facts, corpus.facts.edges()
    if not args.target:
        hot = _rows(context.imported_by(edges).orderBy(F.col("imported_by").desc(), "file").limit(10))
        print(json.dumps({"files": _rows(context.repo_map(corpus.scripts, edges, f.defs(), f.imports()).orderBy("path")), "hot_files": hot}, indent=2))
        return 0
    paths = [r["path"] for r in corpus.scripts.where(F.col("path").isin(args.target, args.target.rpartition(":")[0])).select("path").collect()]
    kind, file, symbol = context.target_kind(args.target, paths)
    out: dict = {"target": args.target, "kind": kind}
    if kind == "file":
        out |= {"imports": _rows(f.imports().where(F.col("file") == file)), "imported_by": _rows(context.importers(edges).where(F.col("file") == file)), "defs": _rows(f.defs().where(F.col("file") == file))}
    else:
        from sieveworks.operators.graph import reachable

        defs = context.definitions(f.defs(), symbol, file)
        # only what is reached from files that name the symbol, and from what those import
        node = lambda rows, column="file": rows.select(F.col(column).alias("node"))
        near = node(f.calls().where(F.col("name") == symbol)).distinct()
        bound = f.bindings().where("target IS NOT NULL")
        starts = near.unionByName(node(bound.join(near.withColumnRenamed("node", "file"), "file", "left_semi"), "target"))
        starts = starts.unionByName(node(bound.where(F.col("imported") == symbol), "target")).unionByName(node(f.default_exports().where(F.col("name") == symbol)))
        reach = reachable(edges, starts.distinct()).toDF("src", "dst")
        out |= {"definitions": _rows(defs), "callees": _rows(context.callees(defs, f.calls())), "callers": _rows(context.callers(defs, f.calls(), f.bindings(), reach, f.default_exports()))}
    print(json.dumps(out, indent=2))
    return 0


def run_explain(args: argparse.Namespace) -> int:
    row = sources.catalog(_session(), args.catalog).where(F.col("id") == args.rule).first()
    print(json.dumps({"id": args.rule, "found": row is not None} | (row.asDict() if row else {}), indent=2))
    return 0 if row else 1


def run_doctor(args: argparse.Namespace) -> int:
    needed = {"pyspark": True, "pyarrow": True, "pandas": True, "numpy": True, "regex": False, "xxhash": False, "tokenizers": False}
    checks = [{"name": n, "type": "required" if must else "optional", "status": "ok" if importlib.util.find_spec(n) else "error" if must else "warning"} for n, must in needed.items()]
    worst = max((("ok", "warning", "error").index(c["status"]) for c in checks), default=0)
    print(json.dumps({"status": ("ok", "warning", "error")[worst], "checks": checks}, indent=2))
    return int(worst == 2)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sieveworks")
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("scan", help="findings of a source tree")
    one.add_argument("path")
    one.add_argument("--json", action="store_true")
    one.add_argument("--status", help="file with the short status of changed files: scan these only")
    one.add_argument("--log", help="file with commits as JSON lines: sha, message, files")
    one.add_argument("--rules", action="append", default=[], metavar="FOLDER", help="folder of YAML rules of code patterns; may be given again")
    one.add_argument("--report", action="append", default=[], metavar="TOOL=FILE", help=f"another tool's output, of {', '.join(payloads.READERS)}; may be given again")
    one.set_defaults(run=run_scan)
    one = commands.add_parser("context", help="a repository's map, or a file's or symbol's surroundings")
    one.add_argument("path")
    one.add_argument("target", nargs="?")
    one.set_defaults(run=run_context)
    one = commands.add_parser("explain", help="what a rule is about")
    one.add_argument("rule")
    one.add_argument("--catalog", required=True)
    one.set_defaults(run=run_explain)
    one = commands.add_parser("doctor", help="whether what is needed is installed")
    one.set_defaults(run=run_doctor)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
