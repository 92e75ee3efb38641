"""What the learned operators are worth on rows they have not seen, and their formulas by plain loops."""

from __future__ import annotations

import random
import zlib

import pytest

from sieveworks.llm import language_id, toxicity


@pytest.fixture(scope="module")
def spoken(spark):
    r = random.Random(12)
    parts = {"en": ["th", "ing", "er", "wh", "ou", "sh", "ed"], "de": ["sch", "ung", "ei", "ich", "ö", "ver", "en"], "fr": ["eau", "é", "tion", "ou", "qu", "ê", "ai"]}
    rows = []
    for i in range(360):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(15, 60))), lang if i % 7 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), {i: ("en", "de", "fr")[i % 3] for i in range(360)}


def test_languages_of_held_out_rows(spoken):
    docs, want = spoken
    rows = [r for r in language_id.report(docs).collect() if r["held_out"]]
    assert len(rows) > 60 and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_toxicity_of_held_out_rows(spark):
    r = random.Random(3)
    plain = [f"w{i}" for i in range(120)]
    rows, toxic = [], {}
    for i in range(900):
        w = [r.choice(plain) for _ in range(r.randint(10, 40))]
        insult, group = r.random() < 0.5, r.random() < 0.5
        w += ["scum"] * insult + ["strangers"] * group
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        toxic[i] = int(insult and group)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int")
    scores = [(x["score"], toxic[x["doc_id"]]) for x in toxicity.report(docs, labels).collect() if x["held_out"]]
    good, bad = [s for s, t in scores if not t], [s for s, t in scores if t]
    assert len(good) > 50 and len(bad) > 20
    better = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert better >= 0.9, better
