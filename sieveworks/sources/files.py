"""Files, lines, changes, history, manifests and catalogs as relations."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.paths import dir_of, skipped

MOST_BYTES = 1 << 20


def files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, content, ext, n_bytes) of the files under a folder; large ones and those in skipped folders are left out before they are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    base = root.rstrip("/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    own = F.regexp_replace(F.lit(base), "^[a-z]+:/*", "/")
    rows = raw.withColumn("path", F.when(F.startswith(path, F.concat(own, F.lit("/"))), F.substring(path, F.length(own) + 2, F.length(path))).otherwise(path))
    rows = rows.where(~skipped(F.col("path")))
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.col("length").alias("n_bytes"))


def from_texts(docs: DataFrame, path: Column, text: Column) -> DataFrame:
    """Rows of any table as files."""
    return docs.select(path.alias("path"), text.alias("content"), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("ext"), F.octet_length(text).cast("long").alias("n_bytes"))


def lines(rows: DataFrame) -> DataFrame:
    """(path, line_no, text): every line of every file, numbered from 1."""
    return rows.select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).select("path", (F.col("at") + 1).alias("line_no"), "text")


def is_code(text: Column) -> Column:
    """Whether a line is neither blank nor a comment."""
    bare = F.trim(text)
    return (F.length(bare) > 0) & ~F.startswith(bare, F.lit("//")) & ~F.startswith(bare, F.lit("/*")) & ~F.startswith(bare, F.lit("*"))


def code_lines(rows: DataFrame) -> DataFrame:
    """(path, code_lines), counted within each row: no line leaves its file."""
    return rows.select("path", F.size(F.filter(F.split("content", "\n", -1), is_code)).alias("code_lines"))


def changed(status: DataFrame, deletions: bool = False) -> DataFrame:
    """(path, status) of lines (value) of a short status: renames by their new path, deletions only if asked for."""
    rows = status.where(F.length("value") >= 4).select(F.substring("value", 1, 2).alias("xy"), F.substring(F.col("value"), 4, 1 << 20).alias("rest"))
    gone = F.contains("xy", F.lit("D"))
    out = rows.select(F.element_at(F.split("rest", " -> "), -1).alias("path"), F.when(gone, "D").otherwise(F.trim("xy")).alias("status"))
    return out if deletions else out.where("status <> 'D'")


def commits(log: DataFrame) -> DataFrame:
    """(sha, message, files) of JSON lines (value)."""
    return log.select(F.from_json("value", "struct<sha:string,message:string,files:array<string>>").alias("c")).select("c.*").where("sha IS NOT NULL")


def packages(rows: DataFrame) -> DataFrame:
    """(dir, section, dep, version) of all package.json among files."""
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    kind = f"struct<{','.join(f'{s}:map<string,string>' for s in sections)}>"
    p = rows.where(F.col("path").rlike(r"(^|/)package\.json$")).select(dir_of(F.col("path")).alias("dir"), F.from_json("content", kind).alias("p"))
    all_ = F.concat(*map(_entries, sections))
    return p.select("dir", F.inline(all_))


def _entries(section: str) -> Column:
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.transform(F.coalesce(F.map_entries(f"p.{section}"), none), lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("dep"), e["value"].alias("version")))


def without_comments(text: Column) -> Column:
    """JSON with comments as JSON: comments outside strings and commas before a closing bracket go."""
    plain = F.regexp_replace(text, r"""("(?:[^"\\]|\\.)*+")|//[^\n]*+|/\*(?s:.*?)\*/""", "$1")
    return F.regexp_replace(plain, r"""("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])""", "$1")


def compiler_options(rows: DataFrame) -> DataFrame:
    """(dir, extends, strict, base_url, paths) of all tsconfig.json among files."""
    kind = "struct<extends:string,compilerOptions:struct<strict:boolean,baseUrl:string,paths:map<string,array<string>>>>"
    c = rows.where(F.col("path").rlike(r"(^|/)tsconfig\.json$")).select(dir_of(F.col("path")).alias("dir"), F.from_json(without_comments(F.col("content")), kind).alias("c"))
    return c.select("dir", F.col("c.extends").alias("extends"), F.col("c.compilerOptions.strict").alias("strict"), F.col("c.compilerOptions.baseUrl").alias("base_url"), F.col("c.compilerOptions.paths").alias("paths"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(id, why, bad, good, fix) of a JSON list of rules; of equal ids the last wins."""
    rows: dict[str, dict] = {r["id"]: r for r in json.loads(Path(path).read_text())}
    return spark.createDataFrame([tuple(r.get(k, "") for k in ("id", "why", "bad", "good", "fix")) for r in rows.values()], "id string, why string, bad string, good string, fix string")
