import json

from sieveworks.functions import paths
from sieveworks.operators import context, gates, resolve, statements
from sieveworks.plans.rules import RegexRule, matches
from sieveworks.sources import files as sources
from sieveworks.sources import payloads
from pyspark.sql import functions as F


def test_files_skip_folders_and_large_ones(spark, tmp_path):
    for name, text in {"a/b.ts": "x", "node_modules/c.ts": "x", "big.js": "y" * 2000, "d.JS": "1\n2"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = sources.files(spark, str(tmp_path), most_bytes=1000)
    assert {(r["path"], r["ext"]) for r in rows.collect()} == {("a/b.ts", "ts"), ("d.JS", "js")}
    assert [(r["line_no"], r["text"]) for r in sources.lines(rows).where("path = 'd.JS'").orderBy("line_no").collect()] == [(1, "1"), (2, "2")]


def test_changed_files(spark):
    status = spark.createDataFrame([(x,) for x in (" M a.ts", "D  b.ts", "R  old.ts -> new.ts", "?? c", "x")], "value string")
    assert {r["path"] for r in sources.changed(status).collect()} == {"a.ts", "new.ts", "c"}
    assert {r["path"] for r in sources.changed(status, True).collect()} == {"a.ts", "b.ts", "new.ts", "c"}


def test_packages_and_commented_config(spark):
    rows = spark.createDataFrame([("package.json", '{"dependencies":{"react":"^19.1.0"},"devDependencies":{"vite":"5"}}'), ("a/tsconfig.json", '{ // c\n "compilerOptions": {"strict": false, "baseUrl": "src//x", /* d */ },}')], "path string, content string")
    assert {tuple(r) for r in sources.packages(rows).collect()} == {("", "dependencies", "react", "^19.1.0"), ("", "devDependencies", "vite", "5")}
    config = sources.compiler_options(rows).first()
    assert (config["dir"], config["strict"], config["base_url"]) == ("a", False, "src//x")


def test_relative_imports_by_candidate_order(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b.js", "src/b.ts", "src/lib/index.ts", "top.ts")], "path string")
    imports = spark.createDataFrame([("src/a.ts", s, i) for i, s in enumerate(("./b", "./lib", "../top", "./b.ts", "react", "./gone", "./b/"))], "file string, source string, line int")
    got = {r["source"]: r["target"] for r in resolve.relative(imports, files).collect()}
    assert got == {"./b": "src/b.js", "./lib": "src/lib/index.ts", "../top": "top.ts", "./b.ts": "src/b.ts", "react": None, "./gone": None, "./b/": "src/b.js"}
    assert resolve.edges(resolve.relative(imports, files)).count() == 5


def test_aliases_most_specific_first(spark):
    files = spark.createDataFrame([("src/ui/x.ts",), ("lib/x.ts",)], "path string")
    aliases = spark.createDataFrame([("@/", "", "src/*", 0), ("@/ui/", "", "lib/*", 0)], "prefix string, suffix string, base string, order int")
    imports = spark.createDataFrame([("a.ts", "@/ui/x", 1)], "file string, source string, line int")
    assert resolve.aliased(imports, aliases, files).first()["target"] == "lib/x.ts"
    bare = spark.createDataFrame([("", "", "src/*", 0), ("@/", "", "lib/*", 0)], "prefix string, suffix string, base string, order int")
    more = spark.createDataFrame([("a.ts", s, i) for i, s in enumerate(("ui/x", "@/x", "gone"))], "file string, source string, line int")
    assert {(r["source"], r["target"]) for r in resolve.aliased(more, bare, files).collect()} == {("ui/x", "src/ui/x.ts"), ("@/x", "lib/x.ts")}


def test_nearest_config_and_major(spark):
    files = spark.createDataFrame([("a/b/c.ts",), ("d.ts",)], "path string")
    assert {tuple(r) for r in resolve.nearest(files, spark.createDataFrame([("a",), ("a/b/x",)], "dir string")).collect()} == {("a/b/c.ts", "a")}
    packages = spark.createDataFrame([("", "react", "^18.2.0"), ("a", "react", "19")], "dir string, dep string, version string")
    assert {tuple(r) for r in resolve.with_major(files, packages, "react").collect()} == {("a/b/c.ts", 19), ("d.ts", 18)}


def test_names_through_barrels_and_cycles(spark):
    exports = spark.createDataFrame([("impl", "A"), ("impl", "B")], "file string, name string")
    again = spark.createDataFrame([("barrel", "impl", "*", None), ("outer", "barrel", "C", "A"), ("x", "y", "*", None), ("y", "x", "*", None)], "file string, target string, name string, original string")
    got = {(r["file"], r["name"]): (r["origin"], r["origin_name"]) for r in resolve.chased(exports, again).collect()}
    assert got == {("barrel", "A"): ("impl", "A"), ("barrel", "B"): ("impl", "B"), ("outer", "C"): ("impl", "A")}


def test_path_functions(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",)], "p string")
    assert [r[0] for r in df.select(paths.clean(F.col("p"))).collect()] == ["a/c", "../x"]
    names = spark.createDataFrame([(x,) for x in ("node:fs", "@s/p/q", "lodash/x", "./a", "@/a", "~b")], "p string")
    assert [r[0] for r in names.select(paths.package(F.col("p"))).collect()] == ["fs", "@s/p", "lodash", "", "", ""]


def test_test_files_and_globs(spark):
    df = spark.createDataFrame([(x,) for x in ("a/x.test.ts", "tests/x.ts", "src/latest.ts", "src/x.ts")], "p string")
    assert [r[0] for r in df.select(gates.is_test(F.col("p"))).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(gates.on_path(F.col("p"), ("src/**",), ("**/x.ts",))).collect()] == [False, False, True, False]


def test_regex_rules_in_one_pass(spark):
    files = spark.createDataFrame([("a.ts", "x\neval(y)\neval(z) // ok"), ("b.css", "eval(q)")], "path string, content string")
    found = matches(files, (RegexRule("r.eval", r"eval\(", "error", "security", "No eval.", include=("*.ts",), unless="ok"),)).collect()
    assert [(r["rule_id"], r["file"], r["line"], r["severity"]) for r in found] == [("r.eval", "a.ts", 2, 0)]
    assert [r["line"] for r in matches(files, (RegexRule("r.m", r"x\neval"),), by_line=False).collect()] == [1]


def test_callers_resolve_through_imports(spark):
    defs = spark.createDataFrame([("a", "run", "function", 1, 5, True), ("b", "run", "function", 1, 5, True)], "file string, name string, kind string, line int, end_line int, exported boolean")
    calls = spark.createDataFrame([("a", "run", None, 3), ("a", "run", None, 9), ("c", "run", None, 2), ("d", "run", "res", 4), ("e", "go", None, 7)], "file string, name string, recv string, line int")
    bindings = spark.createDataFrame([("c", "run", "a", "run"), ("e", "go", "b", "run")], "file string, local string, target string, imported string")
    reach = spark.createDataFrame([("c", "a"), ("d", "b"), ("e", "b")], "src string, dst string")
    got = {(r["def_file"], r["file"], r["line"], r["resolved"]) for r in context.callers(defs, calls, bindings, reach).collect()}
    assert got == {("a", "a", 9, True), ("a", "c", 2, True), ("b", "d", 4, False), ("b", "e", 7, True)}


def test_signature_balances_parentheses(spark):
    df = spark.createDataFrame([("export function f(\n  a,\n  b\n) {\n  return 1",)], "content string")
    assert df.select(context.signature(F.split("content", "\n"), F.lit(1))).first()[0] == "export function f( a, b )"


def test_taint_and_neighbours(spark):
    rows = [("f", 1, 1, "q", True, [], None), ("f", 2, 2, "r", False, ["q"], None), ("f", 3, 3, None, False, ["r"], "code"), ("f", 4, 4, None, False, ["z"], "code")]
    df = spark.createDataFrame(rows, "fn string, idx int, line int, target string, is_source boolean, reads array<string>, sink string")
    assert [tuple(r) for r in statements.tainted_sinks(df).collect()] == [("f", 3, "code", 1)]
    awaits = spark.createDataFrame([("f", "b", 1, 1, True, ["a"], []), ("f", "b", 2, 2, True, ["b"], ["a"]), ("f", "b", 3, 3, True, ["c"], [])], "file string, block string, idx int, line int, is_await boolean, defines array<string>, uses array<string>")
    assert [r["line"] for r in statements.independent_awaits(awaits).collect()] == [2]
    kinds = spark.createDataFrame([(x,) for x in ("eval", "db.users.find", "child_process.exec", "client.chat.completions.create", "log")], "callee string")
    assert [r[0] for r in kinds.select(statements.sink_kind(F.col("callee"))).collect()] == ["code-injection", "nosql-query", "command-injection", "prompt-injection", None]


def payload(spark, value):
    return spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "payload string")


def test_payloads(spark):
    one = lambda df: [(r["rule_id"], r["level"], r["category"], r["confidence"], r["file"], r["line"]) for r in df.collect()]
    got = payloads.pattern_matcher(payload(spark, {"results": [{"check_id": "opt.rules.js.x", "path": "a.js", "start": {"line": 3}, "extra": {"message": "m", "severity": "ERROR", "metadata": {"category": "correctness", "cwe": ["CWE-1"]}}}], "errors": [{"type": ["PartialParsing", []], "message": "e", "path": "", "spans": [{"file": "b.js", "start": {"line": 2}}]}, {"type": "Timeout", "message": "t", "path": "c.js"}, {"type": "SyntaxError", "message": "t", "path": "c.ts"}]}), ["/opt/rules"])
    assert one(got) == [("js.x", "error", "security", "rule", "a.js", 3), ("syntax-or-parse-error", "warning", "bug", "hint", "b.js", 2)]
    got = payloads.advisories(payload(spark, {"results": [{"source": {"path": "/r/p.json"}, "packages": [{"package": {"name": "n", "version": "1"}, "vulnerabilities": [{"id": "V1", "summary": "s"}]}]}]}), "/r")
    assert one(got) == [("V1", "error", "security", "rule", "p.json", None)]
    got = payloads.linter(payload(spark, {"diagnostics": [{"message": "m", "code": "react-perf(x)", "severity": "warning", "filename": "a", "labels": [{"span": {"line": 4}}]}, {"message": "m", "code": "eslint(no-shadow)", "severity": "error", "filename": "a", "labels": []}]}))
    assert one(got) == [("x", "warning", "performance", "rule", "a", 4)]
    got = payloads.compiler(payload(spark, "src/a.ts(3,5): error TS1: bad\r\nerror TS2: no\nnoise"), "pkg")
    assert one(got) == [("TS1", "error", "bug", "rule", "pkg/src/a.ts", 3), ("TS2", "error", "bug", "rule", None, None)]
    message = lambda rule, level: {"ruleId": rule, "severity": level, "message": "m", "line": 1}
    files = [{"filePath": "a", "messages": [message("@typescript-eslint/x", 2), message(None, 1), {"ruleId": "y", "severity": 2, "message": "Definition for rule 'y' was not found.", "line": 1}]}]
    assert one(payloads.typed_lint(payload(spark, files))) == [("x", "error", "bug", "rule", "a", 1), ("parser-error", "warning", "quality", "hint", "a", 1)]
    files = [{"filePath": "a", "messages": [message("tailwindcss/no-contradicting-classname", 2), message("tailwindcss/z", 1)]}]
    assert one(payloads.style_lint(payload(spark, files))) == [("no-contradicting-classname", "error", "bug", "rule", "a", 1), ("z", "warning", "quality", "hint", "a", 1)]
    files = [{"filePath": "a", "messages": [message("svelte/no-at-html-tags", 1), message("svelte/a11y", 2), message("svelte/k", 2)]}]
    assert [x[2] for x in one(payloads.component_lint(payload(spark, files)))] == ["security", "quality", "bug"]
    got = payloads.dead_code(payload(spark, {"files": ["dead.ts"], "issues": [{"file": "p", "exports": [{"name": "e", "line": 7}], "types": [], "dependencies": [{"name": "d"}], "unlisted": [{"name": "u"}]}]}))
    assert [x[0] for x in one(got)] == ["unused-file", "unused-export", "unused-dependency", "unlisted-dependency"]
    assert payloads.linter(payload(spark, "not json")).count() == 0
