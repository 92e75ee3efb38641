"""A folder of small tables with awkward rows, and the queries over it."""

from __future__ import annotations

import random

import pytest

WORDS = "the and of tree river stone light Cloud dog cat house blue green run jump café naïve über 42 x1".split()
INSULTS = ["idiot", "scum"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, block string, n_words string, node string, range string"


def texts(seed: int = 5) -> list[str | None]:
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))
    passage, base = line(70), [line(12) for _ in range(12)]
    common = "This very line stands in many of them."
    out: list[str | None] = [None, "", " \t\n ", "one", "1234 5678", "a b c d", "a b c d", "é" * 30, "x" * 3000]
    for i in range(25):
        rows = [line(r.randint(3, 25)) for _ in range(r.randint(1, 9))]
        if i % 3 == 0:
            rows.insert(0, common)
        if i % 5 == 0:
            rows.append(passage + " " + line(5))
        out.append("\n".join(rows))
    for i in range(8):  # near copies of each other
        rows = list(base)
        for _ in range(i % 4):
            k = r.randrange(len(rows))
            rows[k] = rows[k].replace(rows[k].split()[0], "changed", 1)
        out.append("\n".join(rows))
    out += ["\n".join(base)] * 3
    out.append(" ".join(line(400) for _ in range(20)))  # very long
    out.append(f"{common}  \n\t{common.upper()}\nmail me: jane.doe@mail.example.com or +1 (377) 555-0271, host 10.0.0.1, card 4111 1111 1111 1111, iban GB82 WEST 1234 5698 7654 32")
    return out


def items(seed: int = 6) -> list[str | None]:
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))
    return [line(25), line(14), "short item", None, "...", line(10), "one"]


@pytest.fixture(scope="session")
def data(spark, tmp_path_factory):
    """(folder, documents as tuples, items)."""
    folder = tmp_path_factory.mktemp("tables")
    found, tests = texts(), items()
    found[12] = f"{found[12]} {tests[0]}, {tests[1]}"
    found[15] = f"{tests[5].upper()}; Short, ITEM!"
    ids = [3 * i + 1 for i in range(len(found))]
    docs = [(k, t, ["en", "de", None][k % 3], f"s{k % 2}", len(t or ""), "b", "w", "n", "r") for k, t in zip(ids, found, strict=True)]
    spark.createDataFrame(docs, DOC).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(tests, 5)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in ids[:20]] + [(None, 1, 1), (ids[3], None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), [(k, t) for k, t, *_ in docs], list(enumerate(tests, 5))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, kind in {"documents": DOC, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}.items():
        spark.createDataFrame([], kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null texts, in one small frame with an extra column."""
    rows = [(None, "some words here that are long enough to be a line", 1), (7, None, 2), (7, "same text twice here", 3), (7, "same text twice here", 4), (2, "", 5), (None, None, 6), (9, "same text twice here", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, extra int")
