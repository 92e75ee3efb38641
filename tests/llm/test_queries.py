"""Every query against a plain reference over the small tables, and over empty ones."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest

from sieveworks.llm import queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows(spark, name, folder):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, folder).collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_decontamination(spark, data):
    folder, docs, items = data
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = cut(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    got = rows(spark, "op1_decontamination", folder)
    assert any(r["contaminated"] for r in got.values())
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for i in range(len(w)):
            for k in {len(x) for x in windows}:
                if tuple(w[i : i + k]) in windows and i + k <= len(w):
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == sha(",".join(sorted(map(str, found))))


def test_ngram_jaccard(spark, data):
    folder, docs, _ = data
    sets = {}
    for doc, text in docs:
        w = WORD.findall((text or "").translate(UPPER))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = rows(spark, "op2_ngram_jaccard", folder)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: (len(s), find(d)) for d, s in sets.items()}
    assert len({r["component_id"] for r in got.values()}) < len(got)


def test_pii(spark, data):
    folder, docs, _ = data

    def luhn(d):
        return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    for doc, r in (got := rows(spark, "op3_pii", folder)).items():
        text = dict(docs)[doc] or ""
        found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
        found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r["base_sha256"] == sha(joined)
        assert r["spans"].startswith(joined)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(f[0] == k for f in found) for k in ("email", "ip", "card", "phone")]
    last = got[docs[-1][0]]
    assert (last["n_email"], last["n_ip"], last["n_card"], last["n_phone"]) == (1, 1, 1, 1)
    assert "iban:" in last["spans"] and max(last["scores"]) == 1.0


def test_substring_dedup(spark, data):
    folder, docs, _ = data
    first: dict[tuple, int] = {}
    cut = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(cut):
        for i in range(len(cut[d]) - 49):
            first.setdefault(tuple(cut[d][i : i + 50]), d)
    got = rows(spark, "op4_substring_dedup", folder)
    for d, w in cut.items():
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(w), len(gone))
        assert got[d]["kept_sha256"] == sha(" ".join(x for j, x in enumerate(w) if j not in gone))
    assert sum(r["n_removed"] for r in got.values()) > 0


def test_substring_dedup_with_all_anchors_hot(spark, data):
    from sieveworks.llm import substring_dedup

    folder, docs, _ = data
    df = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r["doc_id"]: r for r in queries.QUERIES["op4_substring_dedup"](spark, folder).collect()}
    assert {r["doc_id"]: r for r in substring_dedup.report(df, hot=0).collect()} == want


def test_token_counts(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, docs, _ = data
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, r in rows(spark, "op5_token_counts", folder).items():
        text = dict(docs)[d] or ""
        n = len(t.encode(text, add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_line_dedup(spark, data):
    folder, docs, _ = data
    key = lambda x: x.strip(" \t\n\v\f\r").translate(UPPER)
    held: dict[str, set] = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    got = rows(spark, "op6_line_dedup", folder)
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(held[key(x)]) == d]
        assert (got[d]["n_lines"], got[d]["n_dropped"], got[d]["kept_sha256"]) == (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    assert sum(r["n_dropped"] for r in got.values()) > 0


def test_byte_bpe(spark, data):
    import numpy as np
    import public_tokenizers
    import tiktoken

    from sieveworks.llm.byte_bpe import load_ranks

    folder, docs, _ = data
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, r in rows(spark, "op7_byte_bpe", folder).items():
        text = dict(docs)[d] or ""
        ids = e.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), sha(text))


def test_toxicity_columns(spark, data):
    folder, docs, _ = data
    got = rows(spark, "op8_toxicity", folder)
    assert len(got) == len(docs)
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_language_columns(spark, data):
    folder, docs, _ = data
    got = rows(spark, "op9_language_id", folder)
    assert len(got) == len(docs)
    for d, t in docs:
        letters = any(c.isalpha() for c in t or "")
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert (got[d]["lang_pred"] in ("en", "de")) == letters and (got[d]["lang_pred"] == "und") == (not letters)
        assert 0 <= got[d]["score"] <= 1


def test_fingerprints(spark, data):
    from sieveworks.llm import merkle

    folder, docs, _ = data
    got = rows(spark, "op10_fingerprints", folder)
    order = sorted(((d, t or "") for d, t in docs), reverse=True)
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), sha(edited), merkle.fingerprint(t), merkle.fingerprint(edited))
        assert r["near_edited"] == merkle.likeness(r["fingerprint"], r["edited_fingerprint"]) and 0 <= r["near_next"] <= 1
