"""The pipeline's stages on the small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from sieveworks.llm.byte_bpe import load_ranks


def test_stages_keep_columns_and_take_effect(spark, data):
    folder, docs, _ = data
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = frame.columns, [frame.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder).cache()
        assert frame.columns == columns, name
        sizes.append(frame.count())
        assert frame.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] >= sizes[4]
    ids = {r["doc_id"] for r in frame.select("doc_id").collect()}
    assert ids < {d for d, _ in docs}


def test_run_gives_ids_of_what_is_left(spark, data, empty):
    folder, _, _ = data
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(rows[0].asDict())
    assert corpus_pipeline.run(spark, empty).collect() == []


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lettered(rows, _):
    return {d: t for d, t in rows.items() if any(c.isalpha() for c in t or "")}


def deduplicated(rows, _):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(UPPER)
    first, several = {}, set()
    for d in sorted(rows):
        for k in {key(x) for x in (rows[d] or "").split("\n")}:
            several |= {k} if k in first else set()
            first.setdefault(k, d)
    gone = lambda d, x: len(key(x)) >= 10 and key(x) in several and first[key(x)] != d
    return {d: "\n".join(x for x in (t or "").split("\n") if not gone(d, x)) for d, t in rows.items()}


def representatives(rows, _):
    sets = {}
    for d, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: t for d, t in rows.items() if find(d) == d}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def uncontaminated(rows, items):
    windows = set()
    for text in items:
        w = words(text)
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    out = {}
    for d, t in rows.items():
        w = words(t)
        hit = {j for i in range(len(w)) for k in {len(x) for x in windows} if i + k <= len(w) and tuple(w[i : i + k]) in windows for j in range(i, i + k)}
        if len(hit) <= 0.5 * len(w):
            out[d] = [x for i, x in enumerate(w) if i not in hit]
    return out


def test_each_stage_against_brute_force_on_its_own_input(spark, data):
    folder, docs, items = data
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [t for _, t in items]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], (lettered, deduplicated, representatives, uncontaminated), strict=True):
        rows = {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}
        frame = stage(spark, frame, folder).cache()
        got = {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}
        want = brute(rows, texts)
        if name == "decontamination":
            assert {d: words(t) for d, t in got.items()} == want and any(got[d] != rows[d] for d in got)
        else:
            assert got == want, name
    rows = {r["doc_id"]: r["text"] or "" for r in frame.select("doc_id", "text").collect()}
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.STAGES[-1][1](spark, frame, folder).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {d: (len(ids := e.encode_ordinary(t)), sha(np.asarray(ids, "<u4").tobytes()), sha(t.encode())) for d, t in rows.items()}


def test_stages_take_odd_rows_and_empty_tables(spark, data, empty):
    """Repeated and null ids, null texts, clashing names; each stage on the same input."""
    folder, _, _ = data
    rows = [(None, "some words here that are long enough", "en", "s", 36, 1), (7, None, "de", None, None, 2), (7, "same text twice here", "en", "s", 20, 3), (7, "same text twice here", None, "s", 20, 4), (2, "", "en", "s", 0, 5), (9, "x" * 50_000, "en", "s", 50_000, 6)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int").withColumnsRenamed({"node": "__block"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns and out.count() >= 3
        assert stage(spark, odd.limit(0), empty).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, odd, folder).count() == len(rows)
