import pytest
from pyspark.sql import functions as F

from labelprism.functions.lexicon import lemma_table, stopword_table
from labelprism.operators import clean, text
from labelprism.sources import tables


def test_blank_rule_uses_unicode_whitespace(spark):
    rows = [(1, "a"), (2, " "), (3, "\t\n"), (4, " 　"), (5, None), (6, " x "), (7, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    kept = {r.id for r in clean.drop_blank(df, "text").collect()}
    assert kept == {1, 6}
    rep = clean.cleaning_report(df, "text", "blank").first()
    assert (rep.rows_in, rep.rows_removed, rep.rows_kept) == (7, 5, 2)


def test_empty_rule_keeps_whitespace_only(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "id long, text string")
    out = clean.drop_empty(clean.fill_text(df, "text"), "text")
    assert [r.id for r in out.collect()] == [3]


def test_word_tokens_are_unicode_and_two_chars(spark):
    df = spark.createDataFrame([(1, "Ça va? I am ÉTÉ-2024 a_b x")], "id long, text string")
    toks = text.add_word_tokens(df, "text").first().tokens
    assert toks == ["ça", "va", "am", "été", "2024", "a_b"]


def test_ws_tokens_keep_case(spark):
    df = spark.createDataFrame([(1, " A  b　C\t")], "id long, text string")
    assert text.add_ws_tokens(df, "text").first().tokens == ["A", "b", "C"]


def test_normalise_text(spark):
    df = spark.createDataFrame([(1, "The children went home, 42 times! Seven cats3 ran."),
                                (2, "the and of")], "id long, text string")
    out = {r.id: r.norm_text for r in
           text.normalise_text(df, "id", "text", stopword_table(spark), lemma_table(spark)).collect()}
    assert out == {1: "child go home times ran"[:0] + "child go home times run"}


def test_vocabulary_limits_inclusive(spark):
    rows = [(i, ["common"] + (["mid"] if i < 3 else []) + (["rare"] if i == 0 else [])) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    v = {r.term: r.df for r in text.vocabulary(df, "id", "tokens", 3, 0.8).collect()}
    assert v == {"mid": 3}   # common is in 5 of 5 > 80 %, rare in 1 < 3


def test_dictionary_dense_sorted(spark):
    df = spark.createDataFrame([(t,) for t in ["b", "a", "c", "a", "é", "B"]], "term string")
    got = [(r.term, r.term_id) for r in text.dictionary(df).orderBy("term_id").collect()]
    assert got == [("B", 0), ("a", 1), ("b", 2), ("c", 3), ("é", 4)]


def test_require_columns_and_rows(spark):
    df = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(ValueError):
        tables.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError):
        tables.require_rows(df.where(F.col("a") > 5))


def test_union_and_rename(spark):
    a = spark.createDataFrame([(1, "x")], "id long, text string")
    b = spark.createDataFrame([("y", "L")], "text string, labels string")
    u = tables.rename(tables.union_splits([a, b]), {"text": "Sentence", "labels": "Label", "zzz": "q"})
    assert sorted(u.columns) == ["Label", "Sentence", "id"]
    assert u.count() == 2


def test_normalise_text_keeps_columns(spark):
    df = spark.createDataFrame([(1, "x", "Went WENT gone said"), (2, "y", "the and of")],
                               "id long, lab string, text string")
    got = {(r.id, r.lab): r.norm_text for r in
           text.normalise_text(df, "id", "text", stopword_table(spark), lemma_table(spark), keep=["lab"]).collect()}
    assert got == {(1, "x"): "go go go say"}


def test_report_and_label_sinks(spark, tmp_path):
    lines = spark.createDataFrame([(0, 2, "  2. b (1.000)"), (0, 1, "  1. a (2.000)"), (1, 1, "  1. c (3.000)")],
                                  "topic int, rank int, line string")
    tables.write_report(lines, str(tmp_path / "rep"), ["topic", "rank"])
    got = [r.value for r in spark.read.text(str(tmp_path / "rep")).collect()]
    assert got == ["  1. a (2.000)", "  2. b (1.000)", "  1. c (3.000)"]
    kw = spark.createDataFrame([("a b/c:d", "w", 1.0)], "label string, term string, score double")
    tables.write_by_label(kw, str(tmp_path / "kw"), "label")
    import os
    assert os.listdir(str(tmp_path / "kw")).count("file_label=a_b_c_d") == 1


def test_normalise_makes_no_row_per_token_and_equals_the_joins(spark):
    """Repeated keys, null keys and texts, words that are dropped, İ and Σ, a lemma of two words."""
    rows = [(1, "The cats RAN abc123 self-driving", "x"), (1, "dogs ran 7 far", "x"), (2, None, "x"), (3, "the the", "x"), (None, "Children went", None),
            (None, "home", None), (4, "İstanbul ΣΑΣ Straße 二", "y"), (4, "İstanbul ΣΑΣ Straße 二", "y"), (5, "", "y"), (6, "wrote", None)]
    df = spark.createDataFrame(rows, "id long, text string, lab string")
    stop, lemmas = stopword_table(spark, ["the", "far"]), lemma_table(spark, [("ran", "run off"), ("children", "child"), ("σας", "sas"), ("wrote", None)])
    got = text.normalise_text(df, "id", "text", stop, lemmas, keep=["lab"])
    assert "Generate" not in got._jdf.queryExecution().toString()
    want = text._normalise_by_joins(df, "id", "text", stop.select(F.col("form").alias("_lw")), lemmas.select(F.col("form").alias("_lw"), F.col("lemma").alias("_lemma")), "norm_text", ["lab"])
    order = lambda rows: sorted(map(str, rows))
    assert order(got.collect()) == order(want.collect()) and got.count() == 4
