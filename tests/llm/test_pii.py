"""PII spans against Python's ``re``: texts made of the patterns' own characters, and very long runs."""

from __future__ import annotations

import random
import re

import pytest

from sieveworks.llm import pii


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans, by kind, then start."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    small = lambda x: len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(map(small, m[0].split(".")))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def found(spark, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] != "iban"] for r in pii.spans(docs).collect()}
    return [rows[i] for i in range(len(texts))]


CARDS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "4111111111111111", "6304000000000000000"]


def test_random_texts(spark):
    r = random.Random(11)
    parts = ["a", "b-", "@", ".", "..", "1", "22", "255", "256", "007", " ", "  ", "-", "--", "+", "+1", "(", ")", "é", "𝒳", "\n", "x@y.z", "a@b", "1.2.3.4", "+49 30 1234567", *CARDS]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)] + [None, ""]
    assert found(spark, texts) == [plain(t) for t in texts]


#: Unit, repeats, and spans of each unit: kind, start and end in it.
LONG = [
    ("7", 10**6, []), ("7 ", 500_000, []), ("7-", 500_000, []), (".c", 500_000, []), ("a@", 300_000, []), ("+1(", 330_000, []), ("1.", 400_000, None), ("(", 10**6, []),
    ("1.2.3.4 ", 50_000, [("ip", 0, 7)]), ("x@y.zz, ", 50_000, [("email", 0, 6)]), ("4111 1111 1111 1111, ", 20_000, [("card", 0, 19)]),
    ("4111 1111 1111 1111  ", 20_000, [("card", 0, 19)]), ("+49 30 1234567; ", 30_000, [("phone", 0, 14)]),
]


@pytest.mark.parametrize("lead", ["", "a@b"])
def test_long_texts(spark, lead):
    """Against the shorter text's spans by ``re``, which is quadratic itself; every text of the list is a row."""
    for row, (unit, n, spans) in zip(found(spark, [lead + unit * n for unit, n, _ in LONG]), LONG, strict=True):
        assert len(row) == len(set(row))
        if not lead and spans is not None:
            assert row == [(k, a + len(unit) * i, b + len(unit) * i) for i in range(n) for k, a, b in spans]
    few = [lead + unit * 300 for unit, _, _ in LONG]
    assert found(spark, few) == [plain(t) for t in few]


def test_mask(spark):
    texts = ["é call +1 (377) 555-0271 or mail a.b@c.de now", "4111 1111 1111 1111", None, "", "none here", "+4111 1111 1111 1111 x", "𝒳 a@b.c" + " a@b.c" * 2000]
    docs = spark.createDataFrame([(i, "own", t) for i, t in enumerate(texts)], "doc_id long, pii string, text string")
    rows = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert docs.columns == pii.mask(docs).columns and {r["pii"] for r in rows.values()} == {"own"}
    assert rows[0]["text"] == "é call [phone] or mail [email] now" and rows[1]["text"] == "[card]"
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[4]["text"] == "none here"
    # the phone number's span holds that of the card: both go, under the first one's name
    assert rows[5]["text"] in ("[phone] x", "+[card] x") and rows[6]["text"] == "𝒳 [email]" + " [email]" * 2000
