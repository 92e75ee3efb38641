"""Other tools' output as findings: each function takes (payload string) rows and returns the findings relation.

Payloads are JSON documents (or compiler text); schemas are fixed, malformed
payloads give null structs and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.plans.schema import findings

#: How payload words map to levels and categories.
CATEGORY = {"security": "security", "performance": "performance", "correctness": "bug", "best-practice": "quality", "maintainability": "quality", "portability": "quality", "compatibility": "quality"}
PLUGIN_CATEGORY = {"react-perf": "performance", "react": "bug", "react-hooks": "bug", "typescript": "bug", "oxc": "bug"}
PARSE_ERRORS = ("PartialParsing", "SyntaxError", "LexicalError")
CORE_NOISE = ("no-unused-vars", "no-shadow", "no-underscore-dangle")


def chosen(value: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def named_level(word: Column) -> Column:
    low = F.lower(word)
    return F.when(low == "error", "error").when(low == "warning", "warning").otherwise("info")


def numbered_level(number: Column) -> Column:
    return F.when(number == 2, "error").when(number == 1, "warning").otherwise("info")


def category(word: Column, has_tag: Column) -> Column:
    """A CWE or OWASP tag makes it security whatever is declared; unknown words give ''."""
    return F.when(has_tag, "security").otherwise(chosen(word, CATEGORY, ""))


def pattern_matcher(payloads: DataFrame, rule_dirs: Sequence[str] = ()) -> DataFrame:
    """Results and parse errors of a pattern matcher."""
    kind = (
        "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<message:string,severity:string,fix:string,"
        "metadata:struct<category:string,confidence:string,cwe:string,owasp:string>>>>,"
        "errors:array<struct<type:string,message:string,path:string,spans:array<struct<file:string,start:struct<line:int>>>>>>"
    )
    parsed = payloads.select(F.from_json("payload", kind).alias("p"))
    r = parsed.select(F.explode("p.results").alias("r"))
    rule = F.col("r.check_id")
    for folder in reversed(list(rule_dirs)):
        prefix = folder.lstrip("/").replace("/", ".") + "."
        rule = F.when(F.startswith(F.col("r.check_id"), F.lit(prefix)), F.substring(F.col("r.check_id"), len(prefix) + 1, 1 << 20)).otherwise(rule)
    present = lambda c: F.coalesce(~F.col(c).isin("", "[]", "null"), F.lit(False))
    tag = present("r.extra.metadata.cwe") | present("r.extra.metadata.owasp")
    confidence = F.when(F.col("r.extra.metadata.confidence") == "hint", "hint").otherwise("rule")
    good = findings(r, "patterns", rule, named_level(F.col("r.extra.severity")), category(F.col("r.extra.metadata.category"), tag), F.col("r.extra.message"), F.col("r.path"), F.col("r.start.line"), confidence, F.col("r.extra.fix"))
    e = parsed.select(F.explode("p.errors").alias("e"))
    # the kind is a word or a tuple that begins with it
    word = F.regexp_extract("e.type", r'^\[?"?([^"\],]+)', 1)
    span = F.try_element_at("e.spans", F.lit(1))
    file = F.coalesce(F.nullif("e.path", F.lit("")), span["file"])
    e = e.where(word.isin(*PARSE_ERRORS)).where(~F.coalesce(F.lower(file), F.lit("")).rlike(r"\.[mc]?tsx?$"))
    bad = findings(e, "patterns", "syntax-or-parse-error", "warning", "bug", F.col("e.message"), file, span["start"]["line"], "hint", F.lit("Confirm that this file parses."))
    return good.unionByName(bad)


def advisories(payloads: DataFrame, root: str = "") -> DataFrame:
    """Vulnerabilities of locked dependencies: three levels of arrays."""
    kind = "struct<results:array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string>,vulnerabilities:array<struct<id:string,summary:string>>>>>>>"
    r = payloads.select(F.explode(F.from_json("payload", kind)["results"]).alias("r"))
    p = r.select(F.col("r.source.path").alias("path"), F.explode("r.packages").alias("p"))
    v = p.select("path", F.col("p.package.name").alias("name"), F.col("p.package.version").alias("version"), F.explode("p.vulnerabilities").alias("v"))
    prefix = root.rstrip("/") + "/"
    file = F.when(F.startswith("path", F.lit(prefix)), F.substring(F.col("path"), len(prefix) + 1, 1 << 20)).otherwise(F.col("path"))
    told = F.concat(F.col("name"), F.lit("@"), F.col("version"), F.lit(": "), F.coalesce("v.summary", F.lit("")))
    return findings(v, "advisories", F.col("v.id"), "error", "security", told, file, None, "rule", F.concat(F.lit("Upgrade "), F.col("name"), F.lit(" to a version without "), F.col("v.id")))


def vulnerable(locked: DataFrame, known: DataFrame) -> DataFrame:
    """The same without the tool: locked (file, name, version) joined with known (name, version, id, summary)."""
    rows = locked.join(known, ["name", "version"])
    told = F.concat(F.col("name"), F.lit("@"), F.col("version"), F.lit(": "), F.coalesce("summary", F.lit("")))
    return findings(rows, "advisories", F.col("id"), "error", "security", told, "file", None, "rule", F.concat(F.lit("Upgrade "), F.col("name"), F.lit(" to a version without "), F.col("id")))


def linter(payloads: DataFrame) -> DataFrame:
    """Diagnostics with codes like ``plugin(rule)``."""
    kind = "struct<diagnostics:array<struct<message:string,code:string,severity:string,help:string,filename:string,labels:array<struct<span:struct<line:int>>>>>>"
    d = payloads.select(F.explode(F.from_json("payload", kind)["diagnostics"]).alias("d"))
    named = r"^([^(]*)\((.*)\)$"
    plugin = F.when(F.col("d.code").rlike(named), F.regexp_extract("d.code", named, 1)).otherwise("")
    rule = F.when(F.col("d.code").rlike(named), F.regexp_extract("d.code", named, 2)).otherwise(F.col("d.code"))
    d = d.where(~(plugin.isin("", "eslint", "oxc") & rule.isin(*CORE_NOISE)))
    return findings(d, "linter", rule, named_level(F.col("d.severity")), chosen(plugin, PLUGIN_CATEGORY, "quality"), F.col("d.message"), F.col("d.filename"), F.try_element_at("d.labels", F.lit(1))["span"]["line"], "rule", F.col("d.help"))


def dead_code(payloads: DataFrame) -> DataFrame:
    """Unused files, exports and dependencies, and dependencies nobody declared."""
    issue = "array<struct<name:string,line:int>>"
    kind = f"struct<files:array<string>,issues:array<struct<file:string,dependencies:{issue},devDependencies:{issue},optionalPeerDependencies:{issue},unlisted:{issue},exports:{issue},types:{issue}>>>"
    p = payloads.select(F.from_json("payload", kind).alias("p"))
    files = p.select(F.explode("p.files").alias("file"))
    i = p.select(F.explode("p.issues").alias("i"))
    empty = F.array().cast(issue)
    several = lambda *names: i.select(F.col("i.file").alias("file"), F.explode(F.concat(*(F.coalesce(f"i.{n}", empty) for n in names))).alias("x"))
    told = lambda before, after: F.concat(F.lit(before), F.col("x.name"), F.lit(after))
    return (
        findings(files, "dead-code", "unused-file", "warning", "quality", F.lit("No entry point reaches this file."))
        .unionByName(findings(several("exports", "types"), "dead-code", "unused-export", "warning", "quality", told("Nothing imports the export '", "'."), "file", F.col("x.line")))
        .unionByName(findings(several("dependencies", "devDependencies", "optionalPeerDependencies"), "dead-code", "unused-dependency", "warning", "quality", told("The dependency '", "' is declared and never imported.")))
        .unionByName(findings(several("unlisted"), "dead-code", "unlisted-dependency", "warning", "bug", told("'", "' is imported and not declared.")))
    )


#: The compiler's lines, for a file and for the whole program.
FILE_LINE = r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)$"
GLOBAL_LINE = r"^(error|warning) (TS\d+): (.+)$"


def compiler(payloads: DataFrame, folder: str = "") -> DataFrame:
    """Diagnostics of a type checker's text output; paths are relative to ``folder``."""
    lines = payloads.select(F.explode(F.split("payload", r"\r?\n", -1)).alias("l"))
    part = lambda p, n: F.regexp_extract("l", p, n)
    own = lines.where(F.col("l").rlike(FILE_LINE))
    path = part(FILE_LINE, 1)
    path = path if not folder else F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))
    whole = lines.where(~F.col("l").rlike(FILE_LINE) & F.col("l").rlike(GLOBAL_LINE))
    a = findings(own, "compiler", part(FILE_LINE, 5), part(FILE_LINE, 4), "bug", part(FILE_LINE, 6), path, part(FILE_LINE, 2).cast("int"))
    return a.unionByName(findings(whole, "compiler", part(GLOBAL_LINE, 2), part(GLOBAL_LINE, 1), "bug", part(GLOBAL_LINE, 3), F.lit(None).cast("string")))


def _messages(payloads: DataFrame) -> DataFrame:
    kind = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int>>>>"
    f = payloads.select(F.explode(F.from_json("payload", kind)).alias("f"))
    m = f.select(F.col("f.filePath").alias("file"), F.explode("f.messages").alias("m")).select("file", F.coalesce("m.ruleId", F.lit("")).alias("rule"), "m.severity", "m.message", "m.line")
    absent = F.startswith("message", F.lit("Definition for rule ")) & F.endswith("message", F.lit("was not found."))
    return m.withColumn("level", numbered_level(F.col("severity"))).withColumn("absent", F.coalesce(absent, F.lit(False)))


def typed_lint(payloads: DataFrame) -> DataFrame:
    """Type-aware lint: prefix cut off; a message without a rule is a parser's."""
    m = _messages(payloads).where("NOT absent")
    rule = F.regexp_replace("rule", "^@typescript-eslint/", "")
    none = rule == ""
    return findings(m, "typed-lint", F.when(none, "parser-error").otherwise(rule), F.col("level"), F.when(F.col("level") == "error", "bug").otherwise("quality"), F.col("message"), "file", F.col("line"), F.when(none, "hint").otherwise("rule"))


def style_lint(payloads: DataFrame) -> DataFrame:
    """Class-name lint: contradictions are bugs for certain, the rest is style."""
    m = _messages(payloads).where("rule <> ''")
    clash = F.contains("rule", F.lit("no-contradicting-classname"))
    return findings(m, "style-lint", F.regexp_replace("rule", "^tailwindcss/", ""), F.col("level"), F.when(clash, "bug").otherwise("quality"), F.col("message"), "file", F.col("line"), F.when(clash, "rule").otherwise("hint"))


def component_lint(payloads: DataFrame) -> DataFrame:
    """Component lint: raw HTML is security, accessibility quality, other errors bugs."""
    m = _messages(payloads).where("rule <> '' AND NOT absent")
    kind = F.when(F.contains("rule", F.lit("no-at-html-tags")), "security").when(F.contains("rule", F.lit("a11y")), "quality").when(F.col("level") == "error", "bug").otherwise("quality")
    return findings(m, "component-lint", F.col("rule"), F.col("level"), kind, F.col("message"), "file", F.col("line"))


#: Normalisers by the name under which a report is handed in.
READERS = {
    "patterns": pattern_matcher, "advisories": advisories, "linter": linter, "dead-code": dead_code,
    "compiler": compiler, "typed-lint": typed_lint, "style-lint": style_lint, "component-lint": component_lint,
}


def reports(spark, named: Sequence[tuple[str, str]]) -> DataFrame:
    """(tool, payload) of report files given as (tool, path); each file is one payload."""
    out = spark.createDataFrame([], "tool string, payload string")
    for tool, path in named:
        if tool not in READERS:
            raise ValueError(f"no reader for reports of {tool!r}; there are {', '.join(READERS)}")
        out = out.unionByName(spark.read.text(path, wholetext=True).select(F.lit(tool).alias("tool"), F.col("value").alias("payload")))
    return out


#: Notices that part of an analysis did not run.
NOTICES = ("toolchain-not-installed", "type-check-skipped", "type-check-output-unparsed", "type-aware-skipped", "type-aware-lint-failed", "dead-code-skipped", "dead-code-failed", "semgrep-registry-unavailable")


def notices(spark, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(analyzer, notice, detail): failures of analyzers are errors, notices of partial coverage are infos."""
    df = spark.createDataFrame(list(rows), "analyzer string, notice string, detail string")
    failed = F.col("notice").isin("analyzer-unavailable", "analyzer-error")
    out = findings(df, "notice", F.col("notice"), F.when(failed, "error").otherwise("info"), F.when(failed, "bug").otherwise("quality"), F.col("detail"), F.lit(None).cast("string"), None, "rule", None, F.col("analyzer"))
    return out.withColumn("analyzer", F.col("context")).withColumn("context", F.lit(None).cast("string"))
