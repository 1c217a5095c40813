import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import stats
from threadloom.operators import chunking, inference, pools, prose, records, running, store


def test_fair_coins_to_full_precision():
    for n in (1, 2, 7, 40, 200, 1000):
        total = 0.0
        for k in range(n // 2 + 1):
            exact = math.comb(n, k) / 2**n if n < 1000 else math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
            total += exact
            assert stats.fair_coin_pmf(k, n) == pytest.approx(exact, rel=1e-11 if n < 1000 else 1e-9, abs=1e-300)
            assert stats.fair_coin_cdf(k, n) == pytest.approx(total, rel=1e-9, abs=1e-300)


def test_sign_places_are_exact_at_every_size():
    for n in [*range(1, 60), 99, 100, 500, 1000]:
        below, k = 0, 0
        for j in range((n - 1) // 2 + 1):
            below += math.comb(n, j)
            if 2 * below <= 0.05 * 2**n:
                k = j
        assert stats.sign_place(n, 0.05) == k
    for n in (30_000, 10**7, 10**10):  # both sides of the place
        k = stats.sign_place(n, 0.05)
        assert 2 * stats.fair_coin_cdf(k, n) <= 0.05 < 2 * stats.fair_coin_cdf(k + 1, n)
        assert abs(k - (n - 1.959964 * math.sqrt(n)) / 2) < 2


def test_sign_flips_exact_and_drawn(spark):
    import itertools

    rnd = random.Random(3)
    small, large = [rnd.gauss(0.4, 1) for _ in range(9)], [rnd.gauss(0.2, 1) for _ in range(40)]
    rows = [("a", k, d) for k, d in enumerate(small)] + [("b", k, d) for k, d in enumerate(large)] + [("c", 0, None)]
    got = {r.g: r for r in inference.sign_flip_tests(spark.createDataFrame(rows, "g string, id int, d double"), ["g"], 400).collect()}
    want = np.mean([abs(np.dot(s, small)) >= abs(sum(small)) - 1e-12 for s in itertools.product((-1, 1), repeat=9)])
    assert got["a"].method == "exact" and got["a"].p == pytest.approx(want) and got["b"].method == "monte_carlo" and 0 < got["b"].p < 1 and set(got) == {"a", "b"}


def test_sign_tests(spark):
    rows = [("a", d) for d in (1, 2, 3, -1, 0)] + [("z", 0)]
    got = {r.g: r for r in inference.sign_tests(spark.createDataFrame(rows, "g string, d int"), ["g"]).collect()}
    assert (got["a"].n_pos, got["a"].n_neg, got["a"].n_zero, got["a"].p_value) == (3, 1, 1, 0.625) and got["z"].p_value == 1.0


def test_paired_rates(spark):
    a = spark.createDataFrame([(k, 0.5 + k % 2) for k in range(20)] + [(99, 9.0)], "query int, rate double")
    b = spark.createDataFrame([(k, 0.25) for k in range(20)], "query int, rate double")
    r = inference.paired_risk_difference(a, b, 300).first()
    assert r.n_queries == 20 and r.risk_diff == pytest.approx(0.75) and r.ci_lo < 0.75 < r.ci_hi


def test_paired_differences_skip_holes(spark):
    rows = [(1, "swap", 1.0), (1, "swap", 3.0), (1, "mask", 0.5), (2, "swap", None), (2, "mask", 1.0), (3, "swap", float("nan")), (3, "mask", 1.0), (4, "swap", 2.0)]
    got = records.paired_differences(spark.createDataFrame(rows, "query int, intervention string, m double"), "m", "swap", "mask").collect()
    assert [(r.query, r.d) for r in got] == [(1, 1.5)]


def test_precision_recall_ends_at_one(spark):
    p = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "score double, label int")
    got = [(r.threshold, round(r.precision, 6), r.recall) for r in pools.precision_recall(p).orderBy("threshold").collect()]
    assert got == [(0.1, 0.5, 1.0), (0.5, 0.666667, 1.0), (0.9, 0.5, 0.5), (float("inf"), 1.0, 0.0)]
    assert [tuple(r) for r in pools.precision_recall(p.where("label = 0")).collect()] == [(float("inf"), 1.0, 0.0)]


def test_pool_verdicts(spark):
    kinds = "query int, item string, score double, label int"
    rows = [(1, "T1.001", 0.9, 0), (1, "T1", 0.8, 1), (2, "A", 0.5, 0), (2, "B", 0.5, 1), (3, "X", 0.1, 0), (4, "T2.001", 0.9, 0), (4, "TA1", 0.1, 1)]
    parent = spark.createDataFrame([("T1.001", "T1"), ("T2.001", "T2")], "id string, parent string")
    tactics = spark.createDataFrame([("T2", "TA1")], "id string, tactic string")
    v = pools.evaluate_pool(spark.createDataFrame(rows, kinds), parent, tactics)
    got = {r.query: (r.correct, r.correct_plus, r.hit3, r.gold_rank, r.rr) for r in v.collect()}
    assert got == {1: (False, True, True, 2, 0.5), 2: (False, False, True, 2, 0.5), 3: (False, False, False, None, 0.0), 4: (False, True, True, 2, 0.5)}
    all_of = pools.aggregate(v).first()
    assert (all_of.group, all_of.n, all_of.p1, all_of.p1_plus, all_of.mrr) == ("all", 4, 0.0, 0.5, 0.375)
    assert {r.group: r.n for r in pools.aggregate(v, F.col("hit3").cast("string")).collect()} == {"true": 3, "false": 1}


def test_metrics_by_depth(spark):
    top = spark.createDataFrame([(1, 1, " t1 "), (1, 2, "x"), (2, 1, "y"), (2, 2, "T2"), (3, 1, " ")], "query int, rank int, item string")
    gold = spark.createDataFrame([("T1",), ("t2",), ("T3",)], "item string")
    got = {r.k: (r.hit, r.precision, r.spurious, round(r.recall, 6), r.queries) for r in pools.metrics_by_k(top, gold, [1, 2]).collect()}
    assert got == {1: (0.5, 0.5, 0.5, 0.333333, 2), 2: (1.0, 0.5, 0.5, 0.666667, 2)}
    assert {r.hit for r in pools.metrics_by_k(top.limit(0), gold, [1]).collect()} == {0.0}


RECORD = "query int, actor string, predicted_id string, predicted_score double, correct boolean, primary_gold_id string, confidence string, margin double, alternatives array<struct<rank:int,id:string,score:double,is_gold:boolean,text_preview:string>>, evidence array<string>, overlap array<string>, hierarchy_type string, hierarchy_parent string"


def test_prose_of_each_case(spark):
    alt = lambda rank, item, gold, name: (rank, item, round(1 - rank / 10, 2), gold, f"{item} — {name}: text")
    rows = [
        (1, "apt29", "T1059.001", 0.9, True, "T1059.001", "HIGH", 0.4, [alt(1, "T1059.001", True, "PowerShell"), alt(2, "T1059", True, "COMMAND AND SCRIPTING")], ["powershell", "script"], ["script", "command", "s"], "sub-technique", "T1059"),
        (2, "", "T2", 0.5, True, "T1", "MEDIUM", 0.2, [alt(1, "T2", True, "Two"), alt(2, "T1", True, "One")], ["x"], [], "technique", None),
        (3, "fin7", "T2", 0.5, True, "T9", "LOW", 0.01, [alt(1, "T2", True, "Two"), alt(2, "T3", False, "Three")], [], ["net"], "tactic", None),
        (4, "fin7", "S1", 0.5, False, "T9", "HIGH", 0.4, [alt(1, "S1", False, "Tool"), alt(2, "T9", True, "Nine")], [], [], "software", None),
        (5, "fin7", "Q1", 0.5, False, None, "LOW", 0.0, [alt(1, "Q1", False, "Q")], [], [], "unknown", None),
    ]
    out = {r.query: r for r in prose.explained(spark.createDataFrame(rows, RECORD), {"apt29": "APT29"}).collect()}
    assert [out[k].matched_via for k in range(1, 6)] == ["primary_gold", "alternative_gold", "alternative_gold", "error", "error"]
    assert out[1].explanation == (
        "In a report attributed to APT29, the reranker assigned **T1059.001 (PowerShell)** as its top-ranked candidate with high certainty (confidence score 0.90, score gap of 0.40 over the next candidate). "
        "The strongest token-level evidence comes from the terms powershell and script, with additional lexical overlap against the candidate description on command. "
        "**T1059.001** is one of 2 ATT&CK techniques annotated as a valid mapping for this query. "
        "The next-ranked candidate was **T1059 (Command and Scripting)** at confidence score 0.80; in structural terms, T1059.001 is a sub-technique of **T1059 (Command and Scripting)**. "
        "This is a high-certainty assignment suitable for downstream automation with light spot-checking."
    )
    assert "an unspecified threat actor" in out[2].explanation and "; the primary annotation is **T1 (One)**. In structural terms, T2 is a top-level" in out[2].explanation
    assert "though the dataset's primary annotation does not appear in the top-5 candidates" in out[3].explanation and "lexical overlap with the candidate description on net." in out[3].explanation
    assert "However, the annotated technique **T9 (Nine)** ranked 2nd in the model's candidate list with confidence score 0.80." in out[4].explanation and "Despite the model's high certainty" in out[4].explanation
    assert "ranked lower in the model's candidate list." in out[5].explanation and "Q1 sits in the ATT&CK framework" in out[5].explanation
    assert all(r.n_sentences == 5 for k, r in out.items() if k in (1, 2))
    told = {r.label: r.query for r in prose.examples(prose.explained(spark.createDataFrame(rows, RECORD))).collect()}
    assert told == {"right, moderately sure": 2, "wrong, gold second": 4}


def test_hierarchy(spark):
    ids = spark.createDataFrame([(x,) for x in ("T1059 x", "T1059.001", "T1059.002 y", "T1059.002 z", "TA0001", "S0002", "other", "T1001.001", None)], "id string")
    got = {r.id: (r.type, r.parent, r.children, r.siblings) for r in records.hierarchy(ids).collect()}
    assert got["T1059"] == ("technique", None, ["T1059.001", "T1059.002"], []) and got["T1059.001"] == ("sub-technique", "T1059", [], ["T1059.002"])
    assert got["T1001.001"] == ("sub-technique", "T1001", [], []) and got["TA0001"][0] == "tactic" and got["S0002"][0] == "software" and len(got) == 6


def test_store(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "d", "a", "t", ["X"]), (2, "d", "b", "t", ["Y"]), (3, "e", "c", "t", ["X", "Target"])], "id int, doc_id string, name string, type string, labels array<string>")
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, embedding array<double>")
    n = store.with_embeddings(nodes, vectors)
    got = {r.id: (r.embedding, r.labels) for r in n.collect()}
    assert got == {1: ([0.6, 0.8], ["X", "Vectorized"]), 2: ([0.0, 0.0], ["Y", "Vectorized"]), 3: (None, ["X", "Target"])}
    assert store.vector_dimension(n) == 2
    with pytest.raises(ValueError):
        store.vector_dimension(nodes.withColumn("embedding", F.lit(None).cast("array<double>")))
    marked = store.with_label(store.without_label(n, "Target"), "Target", ["X"])
    assert {r.id for r in marked.where("array_contains(labels, 'Target')").collect()} == {1}
    index = store.vector_index(marked, "Target", str(tmp_path / "index"))
    assert [(r.id, r.dimension) for r in index.collect()] == [(1, 2)]
    mentions = spark.createDataFrame([("d", 1), ("d", 1), ("e", 3), ("e", 1)], "doc_id string, id int")
    assert sorted((r.doc_id, r.id) for r in store.sources(n, mentions).collect()) == [("d", 1), ("e", 1)] and store.sources(n, mentions, "d").count() == 1
    edges = spark.createDataFrame([(1, 2), (9, 8), (1, 8)], "src int, dst int")
    docs = spark.createDataFrame([(8,)], "id int")
    assert [x.count() for x in store.cleared(nodes, docs, edges)] == [0, 1, 1] and [x.count() for x in store.cleared(nodes, docs, edges, True)] == [0, 0, 0]
    assert store.require_unique(nodes, ["id"]).count() == 3
    with pytest.raises(ValueError):
        store.require_unique(nodes, ["doc_id"])


def test_ranges_by_halves_and_two_levels(spark):
    rnd = random.Random(2)
    values = [rnd.choice((rnd.random(), 0.5, None)) for _ in range(900)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v double")
    for ranges in (1, 3, 40, 300):
        for descending in (False, True):
            order = [F.desc("v") if descending else F.asc_nulls_last("v"), F.col("id")]
            got = {r.id: r.n for r in running.running(df, "v", order, {"n": ("sum", F.lit(1))}, descending, ranges=ranges).collect()}
            key = (lambda k: (values[k] is None, -(values[k] or 0), k)) if descending else (lambda k: (values[k] is None, values[k] or 0, k))
            assert got == {k: n for n, k in enumerate(sorted(range(len(values)), key=key), 1)}


def test_chunks_of_rows_are_those_of_groups(spark):
    texts = ["One two three. Four five six! Seven. " * 4, "Alone.", "x y. x y. p q r. p q r s. " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    from threadloom.functions.text import sentences

    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("k", "sentence"))
    kw = {"least": 0.3, "most_words": 12, "ahead": 2, "overlap_words": 3}
    want = sorted(map(tuple, chunking.chunked(rows.withColumn("vec", chunking.hashed_vector(F.col("sentence"))), "doc_id", **kw).collect()))
    got = sorted(map(tuple, chunking.chunked_texts(docs.select("doc_id", sentences(F.col("text")).alias("sentences")), "doc_id", **kw).collect()))
    assert got == want and len(got) > 10
