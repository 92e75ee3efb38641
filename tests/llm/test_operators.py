"""Parts of the operators: structures against brute force, odd rows, general interfaces."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import byte_bpe, decontaminate, language_id, line_dedup, merkle, ngram_jaccard, pii, substring_dedup, token_counts, toxicity
from sieveworks.llm.common import Words
from sieveworks.llm.fm_index import BitVector, FMIndex, WaveletMatrix
from sieveworks.llm.graph import components


def test_automaton_finds_all_windows_of_random_texts():
    r = random.Random(1)
    for _ in range(60):
        draw = lambda n: [bytes([97 + r.randrange(3)]) for _ in range(n)]
        items = [(i, draw(r.randint(0, 12))) for i in range(4)]
        automaton = decontaminate.SuffixAutomaton(items, 4)
        words = draw(40)
        flags, found = automaton.stream(words)
        want, who = np.zeros(40, bool), set()
        for i, w in items:
            k = min(4, len(w))
            for a in range(len(w) - k + 1 if w else 0):
                for b in range(40 - k + 1):
                    if words[b : b + k] == w[a : a + k]:
                        want[b : b + k] = True
                        who.add(i)
        assert (flags == want).all() and found == who


def test_decontamination_shards_agree_and_cut(spark, data):
    folder, _, _ = data
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.scan(docs, items).drop("clean_text").select("doc_id", "n_hit", F.array_join(F.col("items").cast("array<string>"), ",")).collect()}
    shards = decontaminate.automata(spark, items, shard_words=20)
    assert len(shards) > 1
    before, decontaminate.automata.__defaults__ = decontaminate.automata.__defaults__, (10, 20)
    try:
        many = {tuple(r) for r in decontaminate.scan(docs, items).select("doc_id", "n_hit", F.array_join(F.col("items").cast("array<string>"), ",")).collect()}
    finally:
        decontaminate.automata.__defaults__ = before
    assert one == many
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() < docs.count()  # what is nothing but an item goes
    assert decontaminate.report(clean, items.where("item_id = 5")).where("contaminated").count() == 0


def test_word_hashes_do_not_depend_on_place():
    w = Words()
    text = "  aé b\tccc aé\n\x0bb ".encode()
    begin, end, h = w.scan(text)
    words = [text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    assert words == text.split() and len(set(h.tolist())) == len(set(words)) and h[0] == h[3]
    long = b"word " * 5000
    whole = w.scan(long)[2]
    w.CHUNK = 1000
    assert (w.scan(long)[2] == whole).all()
    assert len(w.scan(b"")[0]) == 0


def test_sketch_distance_bounds_the_difference():
    r = np.random.default_rng(3)
    for _ in range(200):
        both = r.integers(0, 2**63, int(r.integers(1, 300)), np.uint64)
        a, b = (np.unique(np.concatenate((both, r.integers(0, 2**63, int(r.integers(0, 60)), np.uint64)))) for _ in range(2))
        difference = len(np.setxor1d(a, b))
        assert ngram_jaccard.distance(ngram_jaccard.sketch_of(a), ngram_jaccard.sketch_of(b)) <= difference
        shared = len(a) + len(b) - difference
        if 4 * shared >= 3 * (len(a) + len(b) + difference):
            (ka, la), (kb, lb) = ngram_jaccard.bands_of(a), ngram_jaccard.bands_of(b)
            common = len(set(np.concatenate(ka).tolist()) & set(np.concatenate(kb).tolist()))
            assert common >= max(la, lb) >= 1


def test_linked_pairs_always_share_bands():
    r = np.random.default_rng(4)
    for n in [*range(1, 40), 63, 64, 65, 100, 127, 128, 400, 1000]:
        for _ in range(8):
            base = np.unique(r.integers(0, 2**63, n, np.uint64))
            keep = -(-3 * len(base) // 4)
            part = np.sort(r.permutation(base)[: int(r.integers(keep, len(base) + 1))])
            (ka, la), (kb, lb) = ngram_jaccard.bands_of(base), ngram_jaccard.bands_of(part)
            assert len(set(np.concatenate(ka).tolist()) & set(np.concatenate(kb).tolist())) >= max(la, lb)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_chains_with_shuffled_labels(spark):
    r = random.Random(4)
    labels = [r.getrandbits(64) - (1 << 63) for _ in range(1000)]
    links = spark.createDataFrame(list(zip(labels, labels[1:], strict=False)), "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == dict.fromkeys(labels, min(labels))


def test_anchors_beyond_24_bits_of_places():
    from sieveworks.llm.substring_dedup import Anchors

    class Scan:
        def __init__(self, hashes):
            self.hashes = hashes

        def scan(self, text):
            places = np.arange(len(self.hashes))
            return places, places, self.hashes

    words = np.random.default_rng(8).integers(0, 1 << 64, (1 << 24) + 3000, np.uint64)
    cut = (1 << 24) - 500
    whole, tail = Anchors(b"", Scan(words), 50), Anchors(b"", Scan(words[cut:]), 50)
    last = whole.first >= cut + 100  # the window at the cut has an anchor that began before it
    assert set(zip((whole.place[last] - cut).tolist(), whole.last[last].tolist(), whole.key[last].tolist())) <= set(zip(tail.place.tolist(), (tail.last + cut).tolist(), tail.key.tolist()))
    assert whole.place[-1] == cut + tail.place[-1] > 1 << 24


def test_every_link_of_a_component_is_counted(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(words)
        for _ in range(1 + i % 3):
            w[r.randrange(120)] = f"n{r.randrange(5)}"
        rows.append((i, " ".join(w)))
    rows += [(50, rows[0][1]), (51, rows[0][1]), (52, "few words"), (53, ""), (54, None)]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for d, t in rows}
    linked = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = {a: sum(bool(linked(a, b)) for b in sets if a != b) for a in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in ngram_jaccard.clusters(docs, counted=True).collect()}
    assert {d: x["n_links"] for d, x in got.items()} == want and len(set(want.values())) > 5
    assert {d: x["component_id"] for d, x in got.items()} == {x["doc_id"]: x["component_id"] for x in ngram_jaccard.clusters(docs).collect()}


def test_sets_apart_from_their_hub_are_still_linked(spark):
    # many texts around one theme, of which only some pairs are linked
    r = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(words)
        for _ in range(2 + i % 3):
            w[r.randrange(120)] = f"n{r.randrange(5)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in rows}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}


def test_odd_rows(spark, odd):
    assert odd.count() == decontaminate.scan(odd, spark.createDataFrame([(1, "words here")], "item_id long, text string")).count()
    got = ngram_jaccard.clusters(odd).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (0, 7, 0), (2, 0, 2), (7, 0, 7), (7, 1, 7), (7, 1, 7), (9, 1, 7)]
    assert {r["doc_id"] for r in ngram_jaccard.one_of_each(odd).collect()} == {None, 7, 2}
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in line_dedup.report(odd).collect()) == [(0, 0), (0, 0), (2, 0), (7, 0), (7, 0), (7, 0), (9, 1)]
    kept = line_dedup.dedup(odd)
    assert kept.columns == odd.columns and {r["extra"]: r["text"] for r in kept.collect()}[7] == ""
    assert substring_dedup.report(odd).count() == 7
    assert pii.report(odd).count() == 7 and pii.mask(odd).columns == odd.columns
    assert merkle.report(odd).count() == 7
    assert language_id.report(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred = 'und'").count() == 7
    assert language_id.keep_known(odd.withColumn("lang", F.lit("en"))).columns == [*odd.columns, "lang"]


def test_wavelet_matrix_and_fm_index():
    r = np.random.default_rng(2)
    bits = r.integers(0, 2, 500).astype(np.uint8)
    assert (BitVector(bits).rank(np.arange(501)) == np.concatenate(([0], np.cumsum(bits)))).all()
    row = r.integers(0, 37, 400)
    m = WaveletMatrix(row, 37)
    for c in range(37):
        assert (m.rank(np.full(401, c), np.arange(401)) == np.concatenate(([0], np.cumsum(row == c)))).all()
    for _ in range(20):
        texts = [r.integers(1, 4, int(r.integers(1, 30))) for _ in range(12)]
        flat = np.concatenate([np.append(t, 0) for t in texts])
        fm = FMIndex(flat, 5)
        value = np.repeat(np.arange(12), [len(t) + 1 for t in texts])
        least = fm.least(value)
        end = np.flatnonzero(flat == 0)
        begin = np.concatenate(([0], end[:-1] + 1))
        place = fm.statistics(begin, end, flat)
        for i, (a, b) in enumerate(zip(begin, end, strict=True)):
            for at in range(a, b):
                if at + 5 > b:
                    assert place[at] == -1
                else:
                    want = min(j for j, t in enumerate(texts) for k in range(len(t) - 4) if (t[k : k + 5] == flat[at : at + 5]).all())
                    assert least[place[at]] == want <= i


def test_fm_index_streams_foreign_texts():
    fm = FMIndex(np.array([1, 2, 3, 1, 2, 0]), 2)
    found = fm.statistics(np.array([0]), np.array([6]), np.array([9, 1, 2, 2, 3, 7]))
    assert (found >= 0).tolist() == [False, True, False, True, False, False]
    r = np.random.default_rng(8)
    for _ in range(30):
        text, other = np.append(r.integers(1, 4, 60), 0), r.integers(1, 5, 40)
        got = FMIndex(text, 4).statistics(np.array([0]), np.array([40]), other) >= 0
        known = {tuple(text[i : i + 4]) for i in range(57)}
        assert got.tolist() == [tuple(other[i : i + 4]) in known for i in range(40)]


def test_cuckoo_filter_keeps_what_is_added():
    r = np.random.default_rng(5)
    h = r.integers(0, 2**63, 5000, np.uint64)
    f = line_dedup.CuckooFilter(3000)  # too small: the rest goes to the spare table
    f.add(h)
    f.add(h[:10])
    assert f.contains(h).all() and f.added == 5010
    g = line_dedup.CuckooFilter.load(f.dump())
    assert g.contains(h).all()
    g.remove(h[:10])
    assert g.contains(h[:10]).all()  # one copy of two is left
    big = line_dedup.CuckooFilter(20_000)
    big.add(h)
    assert big.contains(r.integers(0, 2**63, 20_000, np.uint64)).mean() < 0.01
    big.remove(h)
    assert big.cells.sum() == 0


def test_line_index_is_reversible(spark):
    line = "a line that many documents hold"
    batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=2)
    index.insert(batch((1, line), (2, f"{line}\nown text of two here")))
    index.insert(batch((3, line.upper() + "  ")))
    one = lambda: {(r["n_docs"], r["keep_doc"]) for r in index.counts().collect()}
    assert one() == {(3, 1), (1, 2)}
    index.delete(batch((1, None)).select("doc_id"))
    assert one() == {(2, 2), (1, 2)}
    index.delete(batch((2, None), (3, None)).select("doc_id"))
    assert one() == set()
    assert all(line_dedup.CuckooFilter.load(r["filter"]).cells.sum() == 0 for r in index.filters.collect())


def test_merges_of_long_words_and_native_fold(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["the", " river", "é", " naïveté", "aaaaaaaaaaaa", "日本語", "\n\n", "x" * 700]
    merges = byte_bpe.Merges(ranks)
    assert [x.tolist() for x in merges.fold([w.encode() for w in words])] == [byte_bpe.merge_long(w.encode(), ranks) for w in words]
    assert merges.fold([b" river"])[0].tolist() == e.encode_ordinary(" river")
    df = spark.createDataFrame([([w.encode().decode("latin-1") for w in words[:7]],)], "words array<string>")
    row = byte_bpe.with_codes(df, ranks).first()
    assert row["codes"] == [e.encode_ordinary(w) for w in words[:7]]
    assert [x.encode("latin-1").decode() for x in row["decoded"]] == words[:7]


@pytest.mark.parametrize("text", ["a  b", "a \n b", "x\x1cy z", " a", "a　 b", "don't  WE'LL", "\n\n a", "a\x85b", ""])
def test_chunks_do_not_change_ids(text):
    import public_tokenizers
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    assert [w for c in byte_bpe.chunks_of(text) for w in find(c)] == find(text)


@pytest.mark.parametrize("text", ["", "a b c d", "a  b \n c d\te f", " x y\u3000z w ", "don't we'll  they've", "1 22 333 \x1c4444 5", "xxxxxxxxxxxxxxxx"])
def test_pieces_do_not_change_ids(text):
    import public_tokenizers
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    for size in (1, 2, 5):
        assert [w for c in byte_bpe.pieces_of(text, size) for w in find(c)] == find(text)
        rows = [x for held in byte_bpe.slices_of([text, "", text], size) for x in held]
        assert [r for r, _ in rows] == sorted(r for r, _ in rows) and {r for r, _ in rows} == {0, 1, 2}
        assert "".join(piece for r, piece in rows if r == 2) == text


def test_long_texts_are_encoded_in_bounded_slices(spark, monkeypatch):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    r = random.Random(3)
    texts = [" ".join(f"word{r.randrange(10**6)}" for _ in range(300_000)), "  \n".join("ab" * r.randrange(9) for _ in range(50_000)), None, "", "z" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for row in byte_bpe.encode(docs, path, public_tokenizers.PATTERN, with_bytes=True).collect():
        text = texts[row["doc_id"]] or ""
        assert np.frombuffer(row["ids"], "<u4").tolist() == e.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode() and row["n_tokens"] * 4 == len(row["ids"])


def test_special_strings_and_white_space_in_token_counts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, counts = Tokenizer.from_file(path), token_counts.PieceCounts(path)
    for text in ("a<|endoftext|>b", "x\x1cy z", "ΑΣ ας. İ", "é ́", "a　 b", "12 3!!"):
        words = token_counts.pre_tokens(text)
        counts.learn(set(words))
        assert sum(counts[w] for w in words) == len(t.encode(text, add_special_tokens=False))


def test_factorization_machine_learns_a_pair():
    r = np.random.default_rng(1)
    samples, labels = [], []
    for i in range(3000):
        has = r.random(2) < 0.5
        samples.append(np.unique(np.concatenate(([0], np.flatnonzero(has) + 1, r.integers(10, 60, 5)))).astype(np.int32))
        labels.append(float(has.all()))
    m = toxicity.fit(samples, np.array(labels), bits=6, epochs=20)
    n = np.array([len(x) for x in samples])
    predicted = m.margin(np.concatenate(samples), np.cumsum(n) - n) >= 0
    assert (predicted == np.array(labels, bool)).mean() > 0.97


def test_network_separates_languages():
    r = random.Random(3)
    make = lambda w: " ".join(r.choice(w) for _ in range(60)).encode()
    words = {0: ["the", "and", "with", "thing"], 1: ["der", "und", "mit", "schön"]}
    texts = [(make(words[i % 2]), i % 2) for i in range(400)]
    windows = np.concatenate([language_id.windows_of(t)[:1] for t, _ in texts])
    labels = np.array([y for _, y in texts])
    net = language_id.fit(windows[:300], labels[:300], ["en", "de"], epochs=6)
    assert (net.log_odds(windows[300:]).argmax(1) == labels[300:]).mean() > 0.97
    assert language_id.windows_of(b"").shape == (1, language_id.WINDOW)


def test_merkle_locates_edits():
    text = "\n".join(f"line {i} of a text that is long enough to have leaves {i * i}" for i in range(60))
    changed = text.replace("line 30 of", "line thirty of")
    a, b = merkle.fingerprint(text), merkle.fingerprint(changed)
    assert "".join(merkle.leaves(text)) == text
    assert merkle.likeness(a, a) == 1.0 and 0.85 < merkle.likeness(a, b) < 1.0
    (begin, end), *rest = merkle.differing(a, b)
    assert not rest and begin <= text.index("line 30 of") < end and end - begin < 200
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1.0
    assert "".join(merkle.leaves("日" * 5000)) == "日" * 5000


def test_luhn_and_mod97(spark):
    df = spark.createDataFrame([("4111111111111111", "DE89370400440532013000"), ("4111111111111112", "DE89370400440532013001")], "card string, iban string")
    assert [tuple(r) for r in df.select(pii.luhn(F.col("card")), pii.mod97(F.col("iban"))).collect()] == [(True, True), (False, False)]


def test_items_with_null_and_string_ids(spark):
    words = lambda a: " ".join(f"w{i}" for i in range(a, a + 12))
    docs = spark.createDataFrame([(1, words(0)), (2, words(50)), (3, words(100) + " " + words(0))], "doc_id long, text string")
    rows = [("b", words(0)), (None, words(50)), ("a", words(0)), (None, None)]
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.report(docs, spark.createDataFrame(rows, "item_id string, text string")).collect()}
    assert got == {1: (12, 2, decontaminate.digest(["a", "b"])), 2: (12, 1, decontaminate.digest([])), 3: (12, 2, decontaminate.digest(["a", "b"]))}


def test_columns_named_like_inner_ones(spark):
    rows = [(1, "a line that is long enough\nown", "x", "y", 0.5, "z"), (2, "a line that is long enough", "x", "y", 0.5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __block string, __lang_pred string, __lang_score double, __pii_email string").withColumn("lang", F.lit("en"))
    assert line_dedup.dedup(docs).columns == docs.columns and line_dedup.report(docs).count() == 2
    assert {r["__block"] for r in line_dedup.dedup(docs).collect()} == {"x"}
    assert [tuple(r) for r in language_id.keep_known(docs).orderBy("doc_id").collect()] == [(*r, "en") for r in rows]
    assert pii.mask(docs).columns == docs.columns


def test_blocks_are_dealt_evenly(spark):
    from sieveworks.llm.blocks import BLOCK, into_blocks, labels

    for n, split in ((1, 1), (4, 3), (51, 2), (211, 4)):
        assert len(set(labels(n, split))) == n * split
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = into_blocks(docs, "doc_id", split=3).groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct(BLOCK).alias("n")).collect()
    assert sorted((r["p"], r["n"]) for r in rows) == [(i, 3) for i in range(4)]


def test_roots_cover_whole_digests():
    """Against a tree built anew from the leaves."""
    import hashlib

    h = lambda x: hashlib.blake2b(x, digest_size=16).hexdigest()
    for text in ("", "one", "a\n\nb c d\n" + "word " * 200, "x" * 500 + "\n"):
        sections, open_ = [], []
        for leaf in merkle.leaves(text):
            open_.append((h(leaf.encode()), len(leaf)))
            if leaf == "\n" or int(open_[-1][0][:4], 16) % merkle.SECTION == 0:
                sections.append(open_)
                open_ = []
        sections += [open_] * bool(open_)
        names = [h(",".join(f"{x}.{n}" for x, n in s).encode()) for s in sections]
        assert merkle.fingerprint(text).split("|")[0] == h("".join(names).encode())
        assert "".join(merkle.leaves(text)) == text and merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text)) == 1.0
