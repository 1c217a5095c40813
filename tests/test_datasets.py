"""Dataset builders on small tables."""

from pyspark.sql import functions as F

from threadloom.operators import datasets as D


def test_contexts_and_labels(spark):
    m = D.context_map(spark.createDataFrame([("Evil Corp", "c1"), ("evil  corp", "c2"), ("Other", "c3"), (None, "c4")], "name string, context string"))
    assert {r.key: r.contexts for r in m.collect()} == {"evil corp": ["c1", "c2"], "evilcorp": ["c1", "c2"], "other": ["c3"]}
    scored = spark.createDataFrame([("s1", "EvilCorp", "T1.1", 0.9), ("s1", "EvilCorp", "T9", 0.8), ("s2", "Other", "T9", 0.9), ("s2", "Other", "T1", 0.1)], "source string, name string, candidate string, cosine double")
    gold = spark.createDataFrame([("T1",)], "id string")
    rows = {(r.source, r.candidate): (r.label, r.contexts) for r in D.labelled_candidates(scored, gold, m, 0.5, roll_up=True).collect()}
    assert rows == {("s1", "T1.1"): (1, ["c1", "c2"]), ("s1", "T9"): (0, ["c1", "c2"]), ("s2", "T9"): (0, ["c3"])}
    assert D.labelled_candidates(scored, gold, m, 0.5, roll_up=True, only_with_gold=True).select("source").distinct().count() == 1
    assert D.labelled_candidates(scored, gold, m, 0.5).where("label = 1").count() == 0


def test_negatives_exclude_every_gold_id(spark):
    q = spark.createDataFrame([("q", [1, 2, 3, 3]), ("r", [5]), ("none", [])], "query string, gold array<int>")
    v = spark.createDataFrame([(k,) for k in range(12)], "id int")
    rows = D.pairs_with_negatives(q, v, 4, 3).collect()
    for query, gold in (("q", {1, 2, 3}), ("r", {5})):
        for g in gold:
            negatives = [r.candidate for r in rows if (r.query, r.positive, r.label) == (query, g, 0)]
            assert len(negatives) == len(set(negatives)) == 4 and not gold & set(negatives)
    assert sum(r.label for r in rows) == 4 and not [r for r in rows if r.query == "none"]
    few = D.pairs_with_negatives(spark.createDataFrame([("q", [0])], "query string, gold array<int>"), v.limit(3), 10, 1)
    assert few.where("label = 0").count() == 2


def test_labels_replay_and_comparison(spark):
    one = lambda x: spark.range(1).select(D.parse_labels(F.lit(x)).alias("v")).first().v
    assert one("['T1', 'T2']") == ["T1", "T2"] and one("a, b,,c") == ["a", "b", "c"] and one(None) == []
    single = lambda xs: spark.range(1).select(D.single_label(F.array(*[F.lit(x) for x in xs])).alias("v")).first().v
    assert single(["S1", "T1", "T2"]) == "T2" and single(["S1", "G2"]) == "S1"
    q = spark.createDataFrame([(k, 10) for k in range(50)], "query int, n_pairs int")
    assert D.replay_sample(q, 0.5, 95, 1).count() == 10
    rows = lambda x: spark.createDataFrame(x, "query int, best int, score double")
    out = {(r.state, r.bucket): r.n for r in D.compare_runs(rows([(1, 1, 0.5), (2, 1, 0.5), (3, 1, 0.1)]), rows([(1, 1, 0.5), (2, 2, 0.9), (4, 1, 0.2)]), [0.0, 0.1, 1.0]).collect()}
    assert out == {("same", 1): 1, ("changed", 2): 1, ("new_only", None): 1, ("old_only", None): 1}


def test_means_by_each_key(spark):
    t = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("b", 1, 1.0)], "x string, y int, v double")
    out = {(r.key_0, r.key_1): (r.n, r.value_0) for r in D.answer(t, [F.col("x"), F.col("y")], [F.col("v")]).collect()}
    assert out == {(None, None): (3, 2 / 3), ("a", None): (2, 0.5), ("b", None): (1, 1.0), (None, 1): (2, 0.5), (None, 2): (1, 1.0)}


def test_contexts_flatten(spark):
    r = spark.createDataFrame([("r", [" ", "x", "", "y"]), ("e", [])], "report string, contexts array<string>")
    assert [(x.row_id, x.query, x.context) for x in D.flatten_contexts(r, "report", "contexts").collect()] == [("r:0001", "x", "x"), ("r:0003", "x", "y")]
