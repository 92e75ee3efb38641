import random

from sieveworks.operators import thresholds as t
from sieveworks.plans import queries

ENTITY = "file string, name string, type string, line_count int, inputs int, deps int, start_line int"
CLASS = t.ComplexityRule("god-class", "class", 200, 10, 8)
FUNCTION = t.ComplexityRule("large-function", "function", 100, 5, 6)


def fired(spark, *rows):
    df = spark.createDataFrame([("f", f"e{i}", *r, 1) for i, r in enumerate(rows)], ENTITY)
    return {(r["name"], r["rule_id"]) for r in t.complexity(df, [CLASS, FUNCTION]).collect()}


def test_below_limits_and_size_alone_do_not_fire(spark):
    assert fired(spark, ("class", 50, 2, 1), ("class", 900, 1, 0)) == set()


def test_counts_over_their_limit_fire(spark):
    assert fired(spark, ("class", 10, 10, 0), ("class", 10, 0, 8)) == {("e0", "god-class"), ("e1", "god-class")}


def test_dependencies_of_a_function_need_some_size(spark):
    assert fired(spark, ("function", 24, 0, 6), ("function", 25, 0, 6)) == {("e1", "large-function")}


def test_size_near_its_limit_fires_with_a_count_near_its_own(spark):
    assert fired(spark, ("class", 120, 6, 0), ("class", 119, 6, 0), ("class", 120, 5, 3), ("function", 60, 3, 0)) == {("e0", "god-class"), ("e3", "large-function")}


def test_repeated_literals_by_kind_and_top_k(spark):
    rows = [("f", "alpha", "string", n) for n in (5, 7, 9, 11)] + [("f", "42", "number", n) for n in (12, 13, 20)] + [("f", "rare", "string", 1)]
    df = spark.createDataFrame(rows, "file string, value string, kind string, line int")
    assert [(r["value"], r["line"], r["count"]) for r in t.duplication(df).orderBy("line").collect()] == [("alpha", 5, 4), ("42", 12, 3)]
    assert [r["value"] for r in t.duplication(df, most=1).collect()] == ["alpha"]


def test_splitting_counts_large_exported_components_of_long_files(spark):
    files = spark.createDataFrame([("a", 400), ("b", 400), ("c", 200), ("d", 400)], "file string, total_lines int")
    rows = [(f, n, 160, True, i) for f in "abc" for i, n in enumerate(("x", "y"), 1)] + [("d", "x", 160, True, 1), ("d", "y", 160, False, 9)]
    parts = spark.createDataFrame(rows, "file string, name string, line_count int, is_exported boolean, start_line int")
    assert sorted((r["file"], r["large"], r["line"]) for r in t.splitting(files, parts).collect()) == [("a", 2, 2), ("b", 2, 2)]


def test_risky_files_within_scope(spark):
    log = spark.createDataFrame([(str(i), m, f) for i, (m, f) in enumerate([("Fix a", ["x", "y"]), ("bugs", ["x"]), ("CVE-1", ["x", "y"]), ("docs", ["y"]), ("security", ["y", "z"])])], "sha string, message string, files array<string>")
    assert sorted(map(tuple, t.risky_files(log).collect())) == [("x", 3), ("y", 3)]
    assert [tuple(r) for r in t.risky_files(log, spark.createDataFrame([("y",)], "file string")).collect()] == [("y", 3)]


def test_words_of_documents_are_counted_where_their_file_is(spark, tmp_path):
    """One shuffle by file, before the words are taken apart; none by word."""
    text = "same same same same 77 77 77 once"
    spark.createDataFrame([(1, text, "en", "src"), (2, text, "en", "src"), (2, text, "en", "src"), (3, None, "en", "src")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.duplication_topk(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["file"], r["value"], r["count"]) for r in found.collect()) == [("src/1.en", "77", 3), ("src/1.en", "same", 4), ("src/2.en", "77", 6), ("src/2.en", "same", 8)]


def test_repeated_words_are_the_same_within_a_row_and_by_shuffle(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    texts = [" ".join(r.choice(("same", "words", "77", "1234", "of", "")) for _ in range(r.randint(0, 60))) for _ in range(30)] + ["7\n 7\n 7\n", None, "ab\u00e9\u00e9 " * 5]
    spark.createDataFrame([(i, t, "en", "src") for i, t in enumerate(texts)] + [(3, texts[3], "en", "src")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, queries.duplication_topk(spark, str(tmp_path)).collect()))
    assert queries.in_rows(queries.doc_files(spark, str(tmp_path))).where("NOT whole").select("path").distinct().collect() == [("src/3.en",)]
    monkeypatch.setattr(queries, "LONG_TEXT", -1)
    assert len(found) > 50 and found == sorted(map(tuple, queries.duplication_topk(spark, str(tmp_path)).collect()))
    # digits and a line break are neither a number nor four characters
    assert not [x for x in found if x[0] == "src/30.en"] and ("src/32.en", "string", "ab\u00e9\u00e9", 5, 1) in found


def test_orders_are_shuffled_once_for_sums_and_distinct_suppliers(spark, tmp_path):
    lines = [(1, 150.0, 5), (1, 50.0, None), (1, 1.0, None), (3, 10.0, 1), *((6, 1.0, s) for s in (9, 8, 9, 7, 6, 5, 4, 3)), (9, 150.0, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    entities = queries.order_entities(spark, str(tmp_path))
    assert entities._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["file"], r["line_count"], r["inputs"], r["deps"]) for r in entities.collect()) == [("1", 201, 3, 1), ("3", 10, 1, 1), ("6", 8, 8, 7), ("9", 150, 1, 1)]


def test_words_of_a_row_are_sorted_once(spark, tmp_path):
    """The optimizer must not copy the work into a filter, and sorts plain strings."""
    spark.createDataFrame([(1, "same same same same", "en", "src")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.duplication_topk(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and plan.count("transform(split(") == 0


def test_first_five_repeated_words_of_odd_texts(spark, tmp_path):
    r = random.Random(11)
    words = ["abcd", "éé", "éééé", "\U0001f600" * 4, "12", "999", "1000", "9", "9a", "12b", "12\n", "\t", "", "of", "0", ":", "/", "word\n", "same", "١٢٣", "zzzz", "Abcd"]
    texts = [" ".join(r.choice(words[: r.randint(1, len(words))]) for _ in range(r.randint(0, 90))) for _ in range(60)] + ["", " ", "    ", None, "9 9 9", "1 1 aaaa aaaa aaaa", " 7 7 7 "]
    spark.createDataFrame([(i, t, "en", "src") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in enumerate(texts):
        lines = {}
        for line, word in enumerate((text or "").split(" "), 1):
            lines.setdefault(word, []).append(line)
        number = lambda w: w != "" and all("0" <= c <= "9" for c in w)
        often = [(x[0], w, len(x)) for w, x in lines.items() if (number(w) and len(x) >= 3) or (not number(w) and len(w) >= 4 and len(x) >= 4)]
        want += [(f"src/{i}.en", "number" if number(w) else "string", w, n, line) for line, w, n in sorted(often)[:5]]
    assert len(want) > 100 and sorted(map(tuple, queries.duplication_topk(spark, str(tmp_path)).collect())) == sorted(want)
