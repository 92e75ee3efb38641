"""Queries over the driver's tables, one for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveworks.llm import byte_bpe, decontaminate, divergence, language_id, line_dedup, merkle, minhash, ngram_jaccard, pii, spelling, substring_dedup, token_counts, toxicity
from sieveworks.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.report(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return token_counts.count(table(spark, sf_dir, "documents"), vocabularies.path("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.report(table(spark, sf_dir, "documents"), path, vocabularies.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_pii": op3_pii,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_fingerprints": op10_fingerprints,
    "op11_spelling": op11_spelling,
    "op12_divergence": op12_divergence,
    "op13_minhash": op13_minhash,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components_sql(share: int, columns: str) -> str:
    """Components of documents that share ``share`` of a hundred shingles."""
    return f"""
        WITH RECURSIVE docs AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
          SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
          FROM docs
        ), items AS (
          SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
        ), links AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id
          HAVING 100 * count(*) >= {share} * (any_value(a.n) + any_value(b.n) - count(*))
        ), reach AS (
          SELECT doc_id AS a, doc_id AS b FROM docs
          UNION
          SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least AS (
          SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, len(s)::BIGINT AS n_shingles, {columns} FROM sets JOIN least USING (doc_id)"""


SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (
          SELECT row_number() OVER () AS row_id, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
          FROM documents
        ), b AS (
          SELECT item_id, least(10, len(w)) AS k, w FROM (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark) WHERE len(w) > 0
        ), item_windows AS (
          SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
          FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b)
        ), doc_windows AS (
          SELECT row_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
          FROM (SELECT row_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)
        ), found AS (
          SELECT row_id, i, k, item_id FROM doc_windows JOIN item_windows USING (k, s)
        ), hit AS (
          SELECT row_id, count(*) AS n_hit
          FROM (SELECT DISTINCT row_id, unnest(range(i, i + k)) AS pos FROM found) GROUP BY row_id
        ), items AS (
          SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
          FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM found) GROUP BY row_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (row_id) LEFT JOIN items USING (row_id)""",
    "op2_ngram_jaccard": _components_sql(75, "component_id"),
    "op4_substring_dedup": """
        WITH docs AS (
          SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), starts AS (
          SELECT row_id, doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
          FROM (SELECT row_id, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)
        ), first_doc AS (
          SELECT s, min(doc_id) AS least FROM starts GROUP BY s HAVING count(DISTINCT doc_id) > 1
        ), gone AS (
          SELECT DISTINCT row_id, unnest(range(i, i + 50)) AS pos
          FROM starts JOIN first_doc USING (s) WHERE least < doc_id
        ), words AS (
          SELECT row_id, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs
        ), kept AS (
          SELECT row_id, count(*) AS n_words, count(g.pos) AS n_removed,
                 string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE g.pos IS NULL) AS joined
          FROM words LEFT JOIN gone g USING (row_id, pos) GROUP BY row_id
        )
        SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
               sha256(coalesce(joined, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (row_id)""",
    "op6_line_dedup": f"""
        WITH docs AS (
          SELECT row_number() OVER () AS row_id, doc_id, str_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ), lines AS (
          SELECT row_id, doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line FROM docs
        ), keyed AS (
          SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM lines
        ), shared AS (
          SELECT key, min(doc_id) AS keep_doc FROM keyed WHERE length(key) >= 10
          GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), judged AS (
          SELECT k.*, keep_doc IS NOT NULL AND keep_doc <> doc_id AS gone FROM keyed k LEFT JOIN shared USING (key)
        )
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY row_id""",
    "op11_spelling": f"""
        WITH RECURSIVE bits AS (
          SELECT i, i AS c, 0 AS k FROM range(256) t(i)
          UNION ALL
          SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
        ), crc AS MATERIALIZED (
          SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
        ), runs AS (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
        ), each AS (
          SELECT coalesce(doc_id::VARCHAR, '') AS doc, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
        ), bytes AS (
          SELECT doc, run, n, hex(encode(doc || ':' || run)) AS x FROM each
        ), hashed AS (
          SELECT run, n, xor(list_reduce(list_transform(range(1, length(x), 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
          FROM bytes, crc
        ), spoiled AS (
          SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
        ), words AS MATERIALIZED (
          SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), cut AS MATERIALIZED (
          SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 100000) t(i) WHERE i <= length(word)
        ), near AS (
          SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION
          SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
          UNION
          SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
        ), best AS (
          SELECT word, count(*) AS n_near, max(m) AS most, arg_min(other, (-m, other)) AS other FROM near GROUP BY word
        ), formed AS MATERIALIZED (
          SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN other END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
          FROM words LEFT JOIN best USING (word)
        ), ways AS (
          SELECT word, word AS root, 0 AS d FROM formed
          UNION ALL
          SELECT w.word, f.form, d + 1 FROM ways w JOIN formed f ON w.root = f.word WHERE f.form IS NOT NULL
        ), last AS (
          SELECT word, arg_max(root, d) AS root FROM ways GROUP BY word
        )
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)""",
    "op12_divergence": f"""
        WITH d AS (
          SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), tokens AS (
          SELECT row_id, lang, source, unnest(w) AS term FROM d
        ), kept AS MATERIALIZED (
          SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10
        ), groups AS MATERIALIZED (
          SELECT DISTINCT lang, source FROM d
        ), occurring AS MATERIALIZED (
          SELECT lang, source, term, count(*)::HUGEINT AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), number AS (
          SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang
        ), total AS (
          SELECT lang, source, sum(n)::HUGEINT AS total FROM occurring GROUP BY ALL
        ), group_p AS MATERIALIZED (
          SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) AS p
          FROM groups JOIN kept USING (lang) JOIN number USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN occurring USING (lang, source, term)
        ), lang_n AS (
          SELECT lang, term, sum(n)::HUGEINT AS n FROM occurring GROUP BY ALL
        ), lang_total AS (
          SELECT lang, sum(total)::HUGEINT AS total FROM total GROUP BY lang
        ), lang_p AS (
          SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q FROM lang_n JOIN number USING (lang) JOIN lang_total USING (lang)
        ), sums AS (
          SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM group_p a JOIN group_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), rows AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM group_p JOIN lang_p USING (lang, term) WHERE n > 0 AND p > q
        ), ranked AS (
          SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op13_minhash": _components_sql(85, "component_id, doc_id = component_id AS kept"),
}
