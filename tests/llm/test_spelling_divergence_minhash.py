"""Operators 11 to 13 against brute force over small tables, awkward rows and blocks of few rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sieveworks.llm import divergence, minhash, queries, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, word string, n long, term string, node long, rank int, key long"


def frame(spark, rows):
    """rows: doc_id, text, lang, source; with columns of clashing names."""
    return spark.createDataFrame([(*r, "w", 1, "t", 2, 3, 4) for r in rows], DOC).repartition(3)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def spelled(rows):
    total = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(UPPER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in total.items() if len(w) >= 7 and k >= 2}
    form, count = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        count[w] = len(own)
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], count[w], n[form[w]] if form[w] else None)
    return out


def words(seed, count):
    r = random.Random(seed)
    base = ["".join(r.choice("abéÀ÷") for _ in range(r.randint(7, 9))) for _ in range(6)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "x" * 3000, "x" * 3001]
    out = []
    for _ in range(count):
        w = r.choice(base)
        if r.random() < 0.3:
            i = r.randrange(len(w))
            w = r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice("abÉ") + w[i:], w[:i] + r.choice("ab") + w[i + 1 :]))
        out.append(w.upper() if r.random() < 0.1 else w)
    return out


@pytest.fixture(scope="module")
def misspelled():
    r = random.Random(8)
    rows = [(i, " ".join(words(i, r.randint(0, 60))), "en", "s") for i in range(40)]
    return [*rows, (None, "aaaaaaa1aaaaaaaĀaaaaaaa", None, None), (7, None, "en", "s"), (7, "", "en", "s"), rows[3], (99, "b" * 200_000, "en", "s"), (98, "b" * 200_000, "en", "s")]


@pytest.mark.parametrize("block", [4096, 3])
def test_spelling(spark, misspelled, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    want = spelled(misspelled)
    rows = spelling.report(frame(spark, misspelled)).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(rows) == len(got) and got == want
    assert any(v[0] for v in want.values()) and max(v[3] for v in want.values()) > 3


def test_roots_follow_long_ways(spark):
    steps = [(f"w{i}", f"w{i + 1}") for i in range(19)]
    got = {tuple(r) for r in spelling.roots(spark.createDataFrame(steps, "word string, form string")).collect()}
    assert got == {(f"w{i}", "w19") for i in range(19)}


def diverging(rows):
    groups, docs, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, k in docs[lang].items() if k >= 10]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = share(counts[lang, source]), share(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            o = share(counts[lang, other])
            pairs.append((-sum(f(p[t], o[t]) for t in kept), other.encode(), other))
        terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out |= {(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


@pytest.fixture(scope="module")
def sources():
    r = random.Random(5)
    vocabulary = [w + str(i % 3) * (i % 2) + t for i, w in enumerate(["the", "Of", "été", "straße", "x" * 5000, "ab", "abc", "abd", "b", "中文", "zoo"]) for t in ("", "s", "é")]
    rows = [(i, " ".join(r.choice(vocabulary[: r.choice((5, 33))]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", "", None]), r.choice(["a", "b", "ä", "c", None])) for i in range(120)]
    return [*rows, (1, None, "en", "a"), (None, "", "fr", "lone"), (2, "one word", "fr", None), rows[0], rows[0]]


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, sources, monkeypatch, small):
    if small:
        for name, value in {"FLUSH": 5, "ADDED": 7, "PIECE": 3, "CELLS": 4}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.report(frame(spark, sources)).collect()]
    want = diverging(sources)
    assert len(rows) == len(set(rows)) and set(rows) == want, set(rows) ^ want
    assert {r[0] for r in want if r[2] == "term"} >= {"en", "de", ""}


def test_shares_of_large_counts_are_exact():
    count, total = np.array([0, 3, 10**12, 7 * 10**15]), np.array([9 * 10**15] * 4)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


def test_trie_walks_in_order_of_bytes():
    r = random.Random(2)
    keys = {"".join(r.choice("abé中") for _ in range(r.randint(1, 7))).encode() for _ in range(500)}
    trie = divergence.Trie()
    first = {k: trie.add(k) for k in keys}
    assert all(trie.add(k) == v for k, v in first.items()) and trie.leaves == len(keys)
    assert list(trie.walk()) == [(k, first[k]) for k in sorted(keys)]


def components(rows):
    sets = {}
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


@pytest.mark.parametrize("block", [2048, 2])
def test_minhash(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(9)
    base = [[f"w{r.randrange(900)}" for _ in range(size)] for size in (6, 40, 120, 300)]
    texts = [None, "", " \n", "a b", "A  b", "a b c d e", "x" * 100_000]
    for words_ in base:
        for k in range(24):  # a drift: neighbours are linked, far ones are not
            w = list(words_)
            for i in range(k * len(w) // 90 + (k > 0)):
                w[(i * 7) % len(w)] = f"n{i // 2 * 2}"
            texts.append(" ".join(w).upper() if k % 5 == 0 else " ".join(w))
        texts += [texts[-1]] * 3
    rows = [(3 * i + 1, t, "en", "s") for i, t in enumerate(texts)]
    r.shuffle(rows)
    want = components(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.report(frame(spark, rows)).collect()}
    assert got == want and 20 < len({v[1] for v in want.values()}) < len(want)


def test_minhash_of_odd_rows(spark, odd):
    rows = minhash.report(odd).collect()
    assert len(rows) == 7
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert by[9, 1] == (7, False) and by[7, 1] == (7, True) and by[2, 0] == (2, True) and by[None, 0] == (None, True)
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["extra"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6]


def test_estimates_are_corrected_for_chance():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    errors = []
    for both in (0, 1000, 2000, 2700):
        a, b = pool[:3000], np.concatenate((pool[:both], pool[3000 : 3000 + 1000], r.integers(0, 1 << 63, 2000 - min(2000, both), dtype=np.uint64)))
        x, y = (minhash.signature(minhash.minima(s)) for s in (a, b))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(float(minhash.similarity(minhash.agreeing(x, y))) - true)
    assert max(map(abs, errors)) < 0.2
    assert minhash.agreeing(x, x) == minhash.HASHES and 0 < minhash.fewest() < minhash.HASHES


def test_new_queries_have_their_columns(spark, data):
    folder, docs, _ = data
    assert queries.QUERIES["op11_spelling"](spark, folder).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert queries.QUERIES["op12_divergence"](spark, folder).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert queries.QUERIES["op13_minhash"](spark, folder).columns == ["doc_id", "n_shingles", "component_id", "kept"]
