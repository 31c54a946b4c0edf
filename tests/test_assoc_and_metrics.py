import math

from labelprism.operators import assoc, evaluate


def _lo(a, b, c, d):
    return math.log(((a + .5) / (b + .5)) / ((c + .5) / (d + .5)))


def test_log_odds_hand_worked_with_zero_cells(spark):
    rows = [("x", "p")] * 3 + [("x", "q")] + [("y", "p")]
    df = spark.createDataFrame(rows, "label string, cat string")
    got = {(r.label, r.cat): (r.n, r.log_odds) for r in assoc.log_odds(df, "label", "cat", ["p", "q", "r"]).collect()}
    assert got[("x", "r")][0] == 0                       # never observed category kept
    assert math.isclose(got[("x", "p")][1], _lo(3, 1, 1, 0))
    assert math.isclose(got[("y", "q")][1], _lo(0, 1, 1, 3))
    assert math.isclose(got[("x", "r")][1], _lo(0, 4, 0, 1))
    assert len(got) == 6


def test_term_log_odds_counts_documents_not_occurrences(spark):
    rows = [(1, "a", ["w", "w", "v"]), (2, "a", ["v"]), (3, "b", []), (4, None, ["w"])]
    df = spark.createDataFrame(rows, "id long, label string, tokens array<string>")
    got = {(r.label, r.term): r for r in assoc.term_log_odds(df, "id", "label", "tokens").collect()}
    assert got[("a", "w")].a == 1 and got[("a", "w")].df == 1
    assert got[("b", "w")].a == 0                        # zero cell present
    # n_a = 2, n_b = 1 (empty doc counts), N = 3; null label excluded
    assert math.isclose(got[("b", "v")].score, _lo(0, 1, 2, 0))
    assert math.isclose(got[("a", "w")].score, _lo(1, 1, 0, 1))


def test_label_keywords_positive_ties_alphabetical(spark):
    rows = [("a", "z", 1.0), ("a", "b", 1.0), ("a", "c", 2.0), ("a", "d", -1.0), ("b", "e", -0.5)]
    df = spark.createDataFrame(rows, "label string, term string, score double")
    got = [(r.label, r.term, r.rank) for r in assoc.label_keywords(df, "label", 2).orderBy("label", "rank").collect()]
    assert got == [("a", "c", 1), ("a", "b", 2)]


def test_macro_f1_hand_worked(spark):
    # truth/pred: class 2 never predicted, class 3 never true
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (1, 3)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    f1 = evaluate.macro_f1(df).first().macro_f1
    # class0: tp2 t3 p2 -> 0.8; class1: tp1 t2 p3 -> 0.4; class2: 0; class3: 0
    assert math.isclose(f1, (0.8 + 0.4) / 4)
    assert math.isclose(evaluate.accuracy(df).first().accuracy, 3 / 6)


def test_baselines_published_figures(spark):
    # 13 classes, majority share 0.238 -> majority macro F1 about 0.0296
    n = 1000
    counts = [238] + [int((n - 238) / 12)] * 12
    rows = [(str(i),) for i, c in enumerate(counts) for _ in range(c)]
    b = evaluate.baselines(spark.createDataFrame(rows, "label string"), "label").first()
    assert b.n_classes == 13
    assert abs(b.majority_macro_f1 - 0.0296) < 5e-4
    assert math.isclose(b.random_accuracy, 1 / 13)


def test_folds_partition_and_balance(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label string")
    f = evaluate.stratified_folds(df, "label", "id", 3, 42, slice_rows=7)
    assert f.count() == 300
    per = {}
    for r in f.groupBy("label", "fold").count().collect():
        per.setdefault(r.label, []).append(r["count"])
    for counts in per.values():
        assert len(counts) == 3 and max(counts) - min(counts) <= 1


def test_grouping_sets_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "label string, cluster int")
    got = {(r.level, r.label, r.cluster): r.n for r in assoc.label_cluster_counts(df, "label", "cluster").collect()}
    assert got[("label", "a", None)] == 2 and got[("cluster", None, 1)] == 2
    assert got[("label_cluster", "b", 1)] == 1


def test_deviation_reindexes_empty_cluster(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (None, "a")], "cluster int, label string")
    dom = spark.range(3).selectExpr("cast(id as int) as cluster")
    got = {(r.cluster, r.label): r for r in assoc.deviation(df, "cluster", "label", dom).collect()}
    assert len(got) == 6                                     # clusters 0, 1, 2 × labels a, b
    assert got[(2, "a")].n == 0 and got[(2, "a")].row_pct == 0.0
    assert math.isclose(got[(0, "a")].row_pct, 50.0)
    # global shares count every row with a label (3 of 4 are "a")
    assert math.isclose(got[(1, "a")].global_pct, 75.0)
    assert math.isclose(got[(1, "a")].deviation, 25.0)


def test_term_log_odds_reads_the_documents_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(i, "ab"[i % 2], ["x", f"t{i % 5}", None] if i % 7 else None) for i in range(40)], "id long, label string, toks array<string>")
    got = assoc.term_log_odds(docs.mapInArrow(counted, docs.schema), "id", "label", "toks").collect()
    assert seen.value == 40 and {r.term for r in got} == {"x", "t0", "t1", "t2", "t3", "t4"} and len(got) == 12
    assert {(r.label, r.a, r.df) for r in got if r.term == "x"} == {("a", 17, 34), ("b", 17, 34)}


def test_the_bag_of_words_sends_the_vocabulary_to_the_pairs(spark, tmp_path, monkeypatch):
    """And pairs are made where a document is: one exchange, of the texts."""
    from labelprism.plans import queries
    rows = [(i, f"common word w{i % 2} w{i % 3}", "en", "s") for i in range(12)] + [(None, "common word", None, "s"), (3, "common word", "en", "s"), (50, None, "en", None)] + [(i, "other text", "fr", "s") for i in range(60, 70)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plans = []
    real = queries.text.count_vectorise
    monkeypatch.setattr(queries.text, "count_vectorise", lambda *a: plans.append((a[0], real(*a))) or plans[-1][1])
    got = {(r.doc_id, r.term): r.tf for r in queries._fixed_bow(spark, str(tmp_path)).collect()}
    assert got[3, "word"] == 2 and got[3, "common"] == 2 and (None, "word") in got
    full, kept = plans[0]
    assert "strategy=broadcast" in kept._jdf.queryExecution().optimizedPlan().toString()
    assert full._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_the_grid_is_made_from_one_count(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(f"r{i % 3}", f"c{i % 4}", i) for i in range(10)] + [("r9", "c9", 7), ("r1", None, 1)], "row string, col string, w long")
    columns = spark.createDataFrame([("c0",), ("c1",), ("c2",), ("c3",), ("c8",), ("c9",)], "col string")
    rows = spark.createDataFrame([("r1",), ("r7",), (None,)], "row string")
    got = assoc.complete_counts(df.mapInArrow(counted, df.schema), "row", "col", weight="w", row_domain=rows, col_domain=columns).collect()
    assert seen.value == 12 and len(got) == 5 * 6
    want = {}
    for i in range(10):
        want[f"r{i % 3}", f"c{i % 4}"] = want.get((f"r{i % 3}", f"c{i % 4}"), 0) + i
    want["r9", "c9"] = 7
    assert {(r.row, r.col): r.n for r in got if r.n} == {k: v for k, v in want.items() if v}
