"""PII in DataFrame functions only: regular expressions propose spans, checksums confirm them, context scores them.

A kind's matches and the gaps between them come from the same expression
(``regexp_extract_all`` and ``split``), so running lengths of both give the code
points of every match without a user function. Running sums double their reach
in each pass over the array, so a text's cost grows with n log n of its matches.
No expression repeats a group without bound, which Java would do by recursion:
cards are proposed as runs of digits, blanks and dashes and then cut where two of
those meet, e-mail domains as runs of one class up to the first dot that no label
follows. Cards must pass Luhn and IBANs mod 97; what a checksum rejects is
dropped. A span's score starts from its kind's weight and rises when one of the
kind's context words stands in the text between it and its neighbours, within
``CONTEXT`` code points. Every expression is row-local: there is no shuffle.

Defined results: a null text counts as empty; repeated rows are each judged; a
null ``doc_id`` stays null. Spans of different kinds may overlap; in masked
texts, spans that overlap become one, named by the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import free_name

#: Code points before and after a span in which context words count.
CONTEXT = 40
KINDS = ("email", "ip", "card", "phone", "iban")
#: Runs that cannot start a match are passed over in one step: \G keeps what follows a match reachable.
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
#: Where a run of digits, blanks and dashes falls into cards.
CUT = r"[\x20-]{2,}+|[\x20-]\z"
#: What a text must hold for a kind to be searched at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
WEIGHT = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95}
WORDS = {
    "email": "mail|contact|kontakt|correo|courriel|write",
    "ip": "ip|host|server|address|adresse|serveur",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|telefon|appel",
    "iban": "iban|bank|account|konto|compte|cuenta",
}


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, F.ascii(d) - 48).otherwise((F.ascii(d) - 48) * 2))
    total = F.aggregate(value, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return (F.length(number) > 0) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN (letters and digits) leaves 1 when read as a number, its first four characters at the end."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)
    return F.aggregate(F.transform(F.split(turned, ""), F.ascii), F.lit(0), step) == 1


def small(part: Column) -> Column:
    """Whether a string of digits, of any length, is at most 255."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def confirmed(kind: str, match: Column) -> Column:
    """Whether a match stands (of a card's run: whether it has digits enough for one)."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return (F.length(match) >= 16) & (F.length(digits(match)) >= 16)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    return F.lit(True)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join) -> Column:
    """The array of ``join`` over the first 1, 2, 3, ... values; each pass doubles how many are joined."""
    passes = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
    step = lambda a, reach: F.transform(a, lambda v, i: join(v, F.coalesce(F.get(a, i - reach), F.lit(0))))
    return F.when(F.size(values) > 1, F.aggregate(passes, values, step)).otherwise(values)


def begins(found: Column, gaps: Column) -> Column:
    """Code points before each match; ``gaps`` are the strings around the matches, one more than them."""
    ends = running(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), lambda a, b: a + b)
    return F.transform(ends, lambda e, i: e - F.length(F.get(found, i)))


def _span(kind: str, start: Column, match: Column, score: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), (start + F.length(match)).cast("int").alias("end"), score.alias("score"))


def _cards(run: Column, start: Column, score: Column) -> Column:
    """Spans of the cards of one run of digits, blanks and dashes."""

    def of(s: Column) -> Column:
        number = lambda m: digits(m)
        # here the parts are the matches and the cuts the gaps between them, after an empty one
        return let(begins(s["parts"], F.concat(F.array(F.lit("")), s["cuts"])), lambda at: F.filter(F.transform(s["parts"], lambda m, i: F.when(F.length(number(m)).between(16, 19) & luhn(number(m)), _span("card", start + F.get(at, i), m, score))), lambda x: x.isNotNull()))

    return let(F.struct(F.split(run, CUT, -1).alias("parts"), F.regexp_extract_all(run, F.lit(CUT), F.lit(0)).alias("cuts")), of)


def proposed(kind: str, text: Column) -> Column:
    """array<struct<kind,start,end,score>> of the confirmed ones of all matches, which go leftmost first and do not overlap.

    Positions are summed only in texts with a confirmed match, so a text full of numbers stays cheap.
    """
    none = F.expr("array()").cast("array<struct<kind:string,start:int,end:int,score:double>>")
    usual, raised = F.lit(WEIGHT[kind]), F.lit(min(1.0, WEIGHT[kind] + 0.2))

    def score(gaps: Column, i: Column) -> Column:
        near = F.lower(F.concat(F.substring(F.get(gaps, i), -CONTEXT, CONTEXT), F.lit(" "), F.substring(F.get(gaps, i + 1), 1, CONTEXT)))
        return F.when(near.rlike(rf"\b(?:{WORDS[kind]})"), raised).otherwise(usual)

    def of(s: Column) -> Column:
        hits = F.filter(F.transform(s["found"], lambda m, i: F.when(confirmed(kind, m), i)), lambda i: i.isNotNull())
        one = lambda at, i: _span(kind, F.get(at, i), F.get(s["found"], i), score(s["gaps"], i))
        run = lambda at, i: _cards(F.get(s["found"], i), F.get(at, i), score(s["gaps"], i))

        def placed(chosen: Column) -> Column:
            all_ = lambda at: F.flatten(F.transform(chosen, lambda i: run(at, i))) if kind == "card" else F.transform(chosen, lambda i: one(at, i))
            return F.when(F.size(chosen) > 0, let(begins(s["found"], s["gaps"]), all_)).otherwise(none)

        return let(hits, placed)

    matches = F.struct(F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0)).alias("found"), F.split(text, PATTERN[kind], -1).alias("gaps"))
    wanted = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]{2}" if kind == "iban" else "[0-9]")
    return F.when(wanted, let(matches, of)).otherwise(none)


def spans(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with ``name``: array<struct<kind,start,end,score>>, by kind as listed, then start."""
    plain = F.coalesce(F.col(text), F.lit(""))
    out, names = docs, []
    for kind in KINDS:
        names.append(free_name(f"__pii_{kind}", docs.columns))
        out = out.withColumn(names[-1], proposed(kind, plain))
    return out.withColumn(name, F.concat(*names)).drop(*names)


def _joined(pii: Column) -> Column:
    return F.array_join(F.transform(pii, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns and the spans' scores, one row per document."""
    found = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"] != "iban")
    return found.select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"), F.transform("pii", lambda s: s["score"]).alias("scores"),
    )


def mask(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """``docs`` with every span of at least ``least_score`` replaced by its kind in brackets (same columns, ``text`` changed; null stays null)."""
    name = free_name("pii", docs.columns)
    found = spans(docs, name=name)
    chosen = F.array_sort(F.transform(F.filter(name, lambda s: s["score"] >= least_score), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def of(s: Column) -> Column:
        # last[i]: the furthest end of the spans up to i; a span that begins there or later starts a new gap in the text
        first = F.filter(F.transform(s["all"], lambda x, i: F.when((i == 0) | (x["start"] >= F.get(s["last"], i - 1)), i)), lambda i: i.isNotNull())
        end = lambda heads, k: F.get(s["last"], F.coalesce(F.get(heads, k + 1), F.size(s["all"])) - 1)
        cut = lambda begin, stop: F.array_join(F.slice(s["chars"], begin + 1, stop - begin), "")
        piece = lambda heads, i, k: F.concat(cut(F.when(k == 0, 0).otherwise(end(heads, k - 1)), F.get(s["all"], i)["start"]), F.lit("["), F.get(s["all"], i)["kind"], F.lit("]"))
        rest = lambda heads: cut(end(heads, F.size(heads) - 1), F.size(s["chars"]))
        return let(first, lambda heads: F.concat(F.array_join(F.transform(heads, lambda i, k: piece(heads, i, k)), ""), rest(heads)))

    parts = lambda c: F.struct(c.alias("all"), running(F.transform(c, lambda x: x["end"]), F.greatest).alias("last"), F.split(F.col("text"), "").alias("chars"))
    text = let(chosen, lambda c: F.when(F.size(c) > 0, let(parts(c), of)).otherwise(F.col("text")))
    return found.withColumn("text", text).select(*docs.columns)
