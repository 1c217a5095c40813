"""Operators on small vectors: perfect, inverted and tied rankings, degenerate tables, closed forms, kernels."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import stats
from threadloom.functions import text as X
from threadloom.operators import chunking, confusion, curves, explain, graph, inference, kernels, propagate, ranking, retrieval, sampling, taxonomy, triples
from threadloom.operators.running import running


def pairs(spark, scores, labels):
    return spark.createDataFrame([("q", k, float(s), y) for k, (s, y) in enumerate(zip(scores, labels))], "query string, item int, score double, label int")


def column(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_perfect_and_inverted_classifiers(spark):
    y = [1, 1, 1, 0, 0, 0]
    up, down = pairs(spark, [6, 5, 4, 3, 2, 1], y), pairs(spark, [1, 2, 3, 4, 5, 6], y)
    assert curves.auroc(up).first().auroc == 1 and curves.auroc(down).first().auroc == 0
    assert curves.auprc(up).first().auprc == 1
    s = confusion.statistics(confusion.counts(up, [], 3.5)).first()
    assert (s.tp, s.fp, s.tn, s.fn, s.mcc, s.f1, s.balanced_accuracy) == (3, 0, 3, 0, 1, 1, 1)
    assert confusion.statistics(confusion.counts(up, [], 99)).first().mcc == 0
    assert curves.auroc(pairs(spark, [1, 1, 1, 1], [1, 0, 1, 0])).first().auroc == 0.5
    assert curves.auroc(pairs(spark, [1, 2], [1, 1])).first().auroc is None


def test_ranking_with_two_gold_items(spark):
    r = ranking.metrics(pairs(spark, [4, 3, 2, 1], [0, 1, 0, 1]), 3).first()
    assert (r.p_at_1, r.hit, r.mrr, r.recall) == (0, 1, 0.5, 0.5)
    assert abs(r.ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-9
    none = ranking.metrics(pairs(spark, [1, 2], [0, 0]), 3).first()
    assert none.mrr is None and none.recall is None and none.hit == 0


def test_sweep_fallback_and_strictness(spark):
    p = pairs(spark, [2, 1], [1, 0])
    top = ranking.threshold_sweep(p, [5.0]).first()
    assert (top.precision, top.recall) == (1, 1)
    empty = ranking.threshold_sweep(p, [5.0], top1_fallback=False).first()
    assert (empty.precision, empty.recall, empty.f1) == (0, 0, 0)
    assert ranking.threshold_sweep(p, [1.0], strict=True, top1_fallback=False).first().precision == 1
    assert ranking.threshold_sweep(p, [1.0], strict=False, top1_fallback=False).first().precision == 0.5


def test_interpolation_and_calibration(spark):
    p = pairs(spark, [4, 3, 2, 1], [1, 0, 1, 0])
    values = {(r.kind, r.target): r.value for r in curves.operating_points(p, [0.25, 0.5]).collect()}
    assert values["tpr_at_fpr", 0.5] == 1.0 and values["tpr_at_fpr", 0.25] == 0.5 and values["fpr_at_tpr", 0.5] == 0.5
    rnd = random.Random(1)
    rows = [(k, q, int(rnd.random() < q)) for k, q in enumerate(rnd.random() for _ in range(3000))]
    c = spark.createDataFrame(rows, "item int, p double, label int")
    assert curves.ece(c).first().ece < 0.05 and abs(curves.brier(c).first().brier - 1 / 6) < 0.02


def test_running_is_exact_across_ranges(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice("ab"), rnd.choice([None, *range(9)]), rnd.random()) for k in range(400)]
    df = spark.createDataFrame([(k, g, None if v is None else float(v), x) for k, g, v, x in rows], "id int, g string, v double, x double")
    for desc in (False, True):
        for part in ([], ["g"]):
            got = {r.id: (r.s, r.m) for r in running(df, "v", [F.desc_nulls_last("v") if desc else F.asc_nulls_last("v"), F.col("id")], {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, desc, part, ranges=5).collect()}
            order = sorted(rows, key=lambda r: (r[2] is None, (-r[2] if desc else r[2]) if r[2] is not None else 0, r[0]))
            seen = {}
            for k, g, _, x in order:
                key = g if part else 0
                s, m = seen.get(key, (0.0, -1.0))
                seen[key] = (s + x, max(m, x))
                assert abs(got[k][0] - seen[key][0]) < 1e-9 and got[k][1] == seen[key][1]


def test_binomial_and_mcnemar(spark):
    for n in (1, 5, 17, 2000):
        for k in (0, 1, n // 2, n):
            exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
            assert abs(column(spark, stats.binomial_cdf(F.lit(k), F.lit(n))) - exact) < 1e-9
    rows = [(1, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 5
    m = inference.mcnemar(spark.createDataFrame(rows, "a int, b int")).first()
    assert abs(m.p_exact - 2 * (1 + 8 + 28) / 256) < 1e-9 and abs(m.p_mid - (2 * (1 + 8) / 256 + 28 / 256)) < 1e-9 and m.chi2 == 2 and m.chi2_corrected == 9 / 8
    assert inference.mcnemar(spark.createDataFrame([(1, 1)], "a int, b int")).first().p_exact == 1


def test_agreement(spark):
    same = inference.agreement(spark.createDataFrame([("x", "x"), ("y", "y")], "a string, b string")).first()
    assert (same.kappa, same.ac1) == (1, 1)
    r = inference.agreement(spark.createDataFrame([("x", "x")] * 20 + [("x", "y")] * 5 + [("y", "x")] * 10 + [("y", "y")] * 15, "a string, b string")).first()
    assert abs(r.kappa - 0.4) < 1e-9 and abs(r.agreement - 0.7) < 1e-9


def test_multiple_testing(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    got = {r.id: (round(r.holm, 6), round(r.bh, 6)) for r in inference.adjust(spark.createDataFrame(list(enumerate(p)), "id int, p double")).collect()}
    assert got == {0: (0.03, 0.02), 1: (0.06, 0.04), 2: (0.06, 0.04), 3: (0.02, 0.02)}


def test_wilson_pins(spark):
    low, high = stats.wilson(F.lit(0), F.lit(10))
    assert column(spark, low) == 0 and abs(column(spark, high) - 0.277533) < 1e-5
    assert column(spark, stats.wilson(F.lit(10), F.lit(10))[1]) == 1 and column(spark, stats.wilson(F.lit(0), F.lit(0))[0]) is None


def test_paired_kernels(spark):
    assert kernels.exact_sign_flip([1, 2, 3, 4, 5]) == 2 / 32 and kernels.exact_sign_flip([0, 0, 0]) == 1
    t, p = kernels.wilcoxon([1, -1, 2, -3, 0, 4, 5, 6])
    assert t == 2.5 + 5 and 0.1 < p < 0.3
    assert kernels.wilcoxon([0, 0]) == (0.0, 1.0)
    low, high = kernels.bca(list(range(50)), replicates=999)
    assert low < 24.5 < high and kernels.bca([3, 3, 3]) == (3, 3) and kernels.bca(list(range(50)), replicates=999) == (low, high)
    e = inference.paired_effects(spark.createDataFrame([("g", float(d)) for d in (1, 2, 3, 4, 5)], "g string, d double"), ["g"]).first()
    assert e.cles == 1 and abs(e.p_sign - 2 / 32) < 1e-9 and abs(e.dz - 3 / math.sqrt(2.5)) < 1e-9
    m = inference.median_sign_interval(spark.createDataFrame([("g", float(d)) for d in range(1, 16)], "g string, d double"), ["g"]).first()
    assert (m.median, m.low, m.high) == (8, 4, 12)


def test_bootstrap_is_repeatable_and_covers(spark):
    c = spark.createDataFrame([(k, float(k % 7), 1) for k in range(60)], "cluster int, s double, n int")
    a, b = (inference.cluster_bootstrap(c, 150, 5).first() for _ in "ab")
    assert a == b and a.low < 2.95 < a.high
    assert inference.cluster_bootstrap(c, 150, 6).first() != a


def test_surface_forms(spark):
    cases = {"FIN7": "1word_upper_digit", "Carbanak": "1word_title", "CozyDuke": "mixed_case_special", "Wizard Spider": "2word_title", "COZY": "1word_upper_nodigit", "a b c": "3plus_words", "lower": "other", "": "other", "wizard Spider": "2word_other"}
    for name, form in cases.items():
        assert column(spark, explain.surface_form(F.lit(name))) == form
    for sub, original, want in (("Andariel", "FIN7", "ANDARIEL"), ("apt41", "FIN7", "APT41"), ("andariel", "Carbanak", "Andariel"), ("Andariel", "CozyDuke", "Andariel"), ("APT41", "COZY", "APT41")):
        assert column(spark, explain.recast(F.lit(sub), F.lit(original))) == want
    for query, want in (("Stealing files", "stealing files"), ("VBScripts.", "VBScripts."), ("GH0ST", "GH0ST"), ("PowerShell was used", "PowerShell was used"), ("I went to", "I went to")):
        assert column(spark, explain.insert_actor(F.lit(query), F.lit("X"))) == f"X was observed {want}"
    assert column(spark, explain.splice(F.lit("abcdef"), F.lit(2), F.lit(4), F.lit("--"))) == "ab--ef"
    assert column(spark, explain.smart_title(F.lit("MANIPULATION OF CONTROL"))) == "Manipulation of Control"
    assert column(spark, X.english_join(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b, and c"
    assert [column(spark, X.ordinal(F.lit(n))) for n in (1, 2, 3, 11, 112, 21)] == ["1st", "2nd", "3rd", "11th", "112th", "21st"]


def test_rank_agreement(spark):
    a = F.array(*[F.lit(x) for x in "abcde"])
    b = F.array(*[F.lit(x) for x in "edcba"])
    assert abs(column(spark, explain.rbo(a, a, 5, 0.8)) - 1) < 1e-9 and column(spark, explain.tau_b(a, a, 5)) == 1 and column(spark, explain.tau_b(a, b, 5)) == -1
    assert column(spark, explain.rbo(a, F.array().cast("array<string>"), 5, 0.8)) == 0 and column(spark, explain.tau_b(F.array(F.lit("a")), F.array(F.lit("a")), 5)) is None


def triple(**kw):
    base = {"seq": 1, "s_name": "X", "s_type": "malware", "predicate": "exploits", "o_name": "Y", "o_type": "vulnerability", "quote": "q", "confidence": 0.9}
    return tuple((base | kw).values())


TRIPLE = "seq int, s_name string, s_type string, predicate string, o_name string, o_type string, quote string, confidence double"


def test_validation_codes(spark):
    cases = [
        ({}, []), ({"predicate": "befriends"}, ["predicate_invalid"]), ({"s_type": "Threat Actor"}, []), ({"s_type": "sector"}, ["subject.type_domain"]), ({"o_type": "file"}, ["object.type_range"]),
        ({"s_name": " ", "o_name": None}, ["subject.name_bad", "object.name_bad"]), ({"s_type": None}, ["subject.type_not_allowed", "subject.type_domain"]), ({"predicate": "attributed-to"}, ["predicate_invalid"]), ({"predicate": None}, ["predicate_invalid"]),
    ]
    df = spark.createDataFrame([triple(seq=k, **kw) for k, (kw, _) in enumerate(cases)], TRIPLE)
    assert {r.seq: r.errors for r in triples.validated(df).collect()} == {k: e for k, (_, e) in enumerate(cases)}


def test_fuzzy_consensus_merges_and_counts(spark):
    names = [("WannaCry", "the worm spread very fast"), ("Wanna Cry", "the worm spread very fast again"), ("WannaCri", "the worm spread very fast"), ("Other", "the worm spread very fast"), ("wannacry", "the worm spread very fast"), ("WANNACRY", "the worm spread very fast")]
    rows = [(1, *triple(seq=k, s_name=n, quote=q)) for k, (n, q) in enumerate(names)] + [(1, *triple(seq=9, s_name="WannaCry", s_type="virus", quote=names[0][1]))]
    df = spark.createDataFrame(rows, "unit int, " + TRIPLE)
    out = triples.fuzzy_consensus(df, "unit", m=3, tau=0.8).collect()
    assert [(r.votes, r.quote) for r in out] == [(3, "the worm spread very fast again")]  # case counts: the last two are other names, and the type is not allowed
    assert triples.fuzzy_consensus(df, "unit", m=4, tau=0.8).collect() == []
    assert triples.similarity("abc", "abc") == 1 and triples.similarity("abc", "ABC") == 0 and triples.similarity("abc", "xyz", 0.9) == 0


def brute_consensus(rows, m, tau):
    """All pairs, straight from the rules."""
    from difflib import SequenceMatcher

    flat = lambda x: " ".join((x or "").split())
    buckets = {}
    for s, o, q in rows:
        buckets.setdefault((flat(s), flat(o)), []).append((s, o, q))
    keys, gone, out = list(buckets), set(), []
    for i, a in enumerate(keys):
        if a in gone:
            continue
        group = list(buckets[a])
        for b in keys[i + 1 :]:
            if b in gone or any(SequenceMatcher(None, a[k], b[k]).ratio() < tau for k in (0, 1)):
                continue
            x, y = set((buckets[a][0][2] or "").lower().split()), set((buckets[b][0][2] or "").lower().split())
            if x and y and len(x & y) >= max(3, min(len(x), len(y)) // 2):
                group += buckets[b]
                gone.add(b)
        if len(group) >= max(2, m):
            out.append((max(group, key=lambda t: len(t[2] or "")), len(group)))
    return out


def test_consensus_matches_brute_force(spark):
    import random

    rnd = random.Random(4)
    words = "the worm spread very fast over many hosts".split()
    for _ in range(20):
        rows = [(rnd.choice(("Wanna Cry", "WannaCry", "WannaCri", "wannacry", "Petya", "NotPetya")), rnd.choice(("host", "hosts", "Host")), rnd.choice((None, " ".join(rnd.sample(words, rnd.randint(0, 8)))))) for _ in range(30)]
        df = spark.createDataFrame([(1, *triple(seq=k, s_name=s, o_name=o, quote=q)) for k, (s, o, q) in enumerate(rows)], "unit int, " + TRIPLE) if _ < 2 else None
        exact = {}
        for k, (s, o, q) in enumerate(rows):
            r = exact.setdefault((" ".join(s.split()), o), {"s_key": " ".join(s.split()), "o_key": o, "votes": 0, "first_quote": q, "quote": q, "s_name": s, "o_name": o})
            r["votes"] += 1
            if len(q or "") > len(r["quote"] or ""):
                r.update(quote=q, s_name=s, o_name=o)
        want = brute_consensus(rows, 2, 0.8)
        assert [((r["s_name"], r["o_name"], r["quote"]), n) for r, n in triples.consensus(list(exact.values()), 2, 0.8)] == want
        if df is not None:
            got = triples.fuzzy_consensus(df, "unit", 2, 0.8).collect()
            assert sorted(map(str, ((r.s_name, r.o_name, r.quote, r.votes) for r in got))) == sorted(map(str, ((*t, n) for t, n in want)))


def test_majority_labels_keep_case_and_order(spark):
    contexts = spark.createDataFrame([(1, "Emotet hit a bank. The emotet group left! Nothing else.")], "context_id int, text string")
    mentions = spark.createDataFrame([(1, "Emotet", "malware", 0), (1, "bank", "Threat Actor", 1), (1, "", "tool", 2), (1, "group", None, 3)], "context_id int, name string, kind string, seq int")
    got = [(r.k, r.kind, r.confidence) for r in triples.majority_labels(mentions, contexts).orderBy("k").collect()]
    assert got == [(0, "malware", 0.5), (1, "other", 0.5), (2, "other", 0.5)]


def test_viterbi_smooths_a_lone_doubtful_label():
    assert triples.viterbi(["malware"] * 3 + ["tool"] + ["malware"] * 3, [0.9] * 3 + [0.4] + [0.9] * 3) == ["malware"] * 7
    assert triples.viterbi(["malware", "tool"], [0.99, 0.99]) == ["malware", "tool"] and triples.viterbi([], []) == []
    kinds, conf = ["malware", "org", "tool"], [0.6, 0.5, 0.7]
    n, step = 10, lambda a, b: math.log(1.0 if a == b else 0.1) - math.log(1 + 0.9)
    score = lambda path: sum(math.log(c if s == k else (1 - c) / (n - 1)) for s, k, c in zip(path, kinds, conf)) + sum(step(a, b) for a, b in zip(path, path[1:]))
    best = max(itertools.product(triples.STATES, repeat=3), key=score)
    assert abs(score(triples.viterbi(kinds, conf)) - score(best)) < 1e-9


def test_upsert_is_idempotent_and_first_wins(spark):
    t = spark.createDataFrame([(1, "Evil", "actor", "uses-it", "Tool", "tool", "c1"), (2, " evil ", "Actor", "uses it", "tool", "tool", "c2"), (3, None, "actor", "x", "Tool", "tool", "c3")], "seq int, subject string, subject_type string, predicate string, object string, object_type string, context string")
    n = graph.nodes_of(t)
    got = {r.name: r.contexts for r in n.collect()}
    assert got == {"Evil": ["c1", "c2"], "Tool": ["c1", "c2", "c3"]}
    assert {r.relation for r in graph.edges_of(t).collect()} == {"USES_IT"} and graph.edges_of(t).count() == 1
    again = graph.upsert_nodes(n, n)
    assert sorted(map(str, again.collect())) == sorted(map(str, n.collect()))


def test_reach_and_propagate(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    got = {r.node: r.distance for r in graph.reach(spark.createDataFrame([(1,)], "node int"), edges, folder=str(tmp_path)).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    # X is sure of itself; its edge to the vulnerability takes Y with it, from there an unsure edge takes Z; L and M are alone
    kinds = "seq long, s_name string, s_type string, s_confidence double, predicate string, o_name string, o_type string, o_confidence double, confidence double"
    rows = [
        (1, "X", "malware", 0.85, "exploits", "Y", "vulnerability", 0.2, 0.3), (2, "Z", "tool", None, "exploits", " y ", "vulnerability", 0.1, 0.2), (3, "Q", "malware", 0.5, "uses", "S", "sector", 0.5, 0.9),
        (4, "L", "malware", 0.5, "targets", "M", "sector", 0.5, 0.1), (5, "A", "tool", 0.4, "targets", "B", "sector", 0.4, 0.75), (6, "C", "tool", 0.4, "targets", "B", "sector", 0.4, 0.2), (7, "L", "malware", 0.6, "targets", "M", "sector", 0.5, 0.2),
    ]
    nodes, edges = propagate.run(spark.createDataFrame(rows, kinds), folder=str(tmp_path))
    out = {(r.source.split("::")[0], r.state): r.confidence for r in edges.collect()}
    assert out == {("x", "forced"): 0.9, ("z", "forced"): 0.9, ("l", "kept"): 0.2, ("a", "seed"): 0.9, ("c", "forced"): 0.9}
    got = {r.name: (r.forced, r.confidence) for r in nodes.collect()}
    assert got == {"X": (True, 0.9), "Y": (True, 0.9), "Z": (True, 0.9), "Q": (False, 0.5), "S": (False, 0.5), "L": (False, 0.6), "M": (False, 0.5), "A": (True, 0.9), "B": (True, 0.9), "C": (True, 0.9)}


def test_tiers(spark):
    got = [column(spark, explain.tier(F.lit(x))) for x in (0.3, 0.299, 0.1, 0.09, -1.0)]
    assert got == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_bio_spans(spark):
    tags = ["I-X", "B-X", "I-X", "I-Y", "O", "I-Y", "B-Y", "B-Y"]
    rows = [(1, k, f"t{k}", t) for k, t in enumerate(tags)]
    out = graph.bio_spans(spark.createDataFrame(rows, "s int, k int, token string, tag string"), "s", "k").orderBy("first").collect()
    assert [(r.kind, r.text) for r in out] == [("X", "t0"), ("X", "t1 t2"), ("Y", "t3"), ("Y", "t5"), ("Y", "t6"), ("Y", "t7")]


def test_error_classes(spark):
    cases = [("TA0001", ["T1001"], "TACTIC_VS_TECHNIQUE"), ("T1001", ["TA0001"], "TACTIC_VS_TECHNIQUE"), ("T1059.001", ["T1059"], "WRONG_GRANULARITY"), ("T1059.001", ["T1059.003"], "SIBLING_TECHNIQUE"), ("T1059", ["T1057"], "NEARBY_TECHNIQUE"), ("T1059", ["T1190", "S0001"], "UNRELATED")]
    for p, g, want in cases:
        assert column(spark, graph.error_class(F.lit(p), F.array(*[F.lit(x) for x in g]))) == want


def test_chunkers():
    v = np.array([[1, 0], [1, 0.1], [0, 1], [0, 1.0], [1, 0]])
    assert chunking.chunk_spans(v, [10] * 5, 0.5, 380, 1, 0) == [(0, 2), (2, 4), (4, 5)]
    assert chunking.chunk_spans(v, [10] * 5, 0.5, 15, 1, 0) == [(k, k + 1) for k in range(5)]
    overlap = chunking.chunk_spans(v, [10] * 5, -1.0, 30, 1, 10)
    assert overlap[0] == (0, 3) and overlap[1][0] == 2 and overlap[-1][1] == 5
    assert chunking.max_min_spans(v) == [(k, k + 1) for k in range(5)] and chunking.max_min_spans(v, legacy=False)[0] == (0, 2)
    assert chunking.coalesce_short([(0, 1), (1, 2), (2, 5)], [5, 100, 80, 80, 80], 50, 200) == [(0, 2), (2, 4), (4, 5)]


def test_splits_and_negatives(spark):
    rows = spark.createDataFrame([(k, "a" if k < 70 else None) for k in range(100)], "id int, stratum string")
    n = {(r.stratum, r.split): r["count"] for r in sampling.stratified_split(rows, 0.8, 0.1, 1).groupBy("stratum", "split").count().collect()}
    assert n == {("a", "train"): 56, ("a", "val"): 7, ("a", "test"): 7, (None, "train"): 24, (None, "val"): 3, (None, "test"): 3}
    p = spark.createDataFrame([("q", k, int(k < 2)) for k in range(30)] + [("z", k, 0) for k in range(5)], "query string, item int, label int")
    t = sampling.training_pairs(p, 2.5, 1)
    assert t.where("query = 'q'").count() == 7 and t.where("query = 'z'").count() == 0


def test_bm25_against_a_loop(spark):
    docs = ["the cat sat", "the dog sat on the cat", "a bird", "", "cat cat cat"]
    tokens = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, tokens)) / len(docs)
    df = {w: sum(w in t for t in tokens) for t in tokens for w in t}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    want = {k: sum(idf.get(q, 0) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in ("Cat", "sat", "cat") for q in [q.lower()]) for k, t in enumerate(tokens)}
    out = retrieval.bm25(spark.createDataFrame([(1, "Cat sat cat")], "query int, text string"), spark.createDataFrame(list(enumerate(docs)), "doc int, text string"), 10).collect()
    assert {r.doc: round(r.score, 9) for r in out} == {k: round(v, 9) for k, v in want.items() if v}


def test_taxonomy_from_a_bundle(spark, tmp_path):
    from threadloom.sources import readers

    ref = lambda x: [{"source_name": "mitre-attack", "external_id": x}]
    phase = [{"kill_chain_name": "k", "phase_name": "execution"}]
    objects = [
        {"id": "t1", "type": "attack-pattern", "name": "Script", "description": "Runs. (Citation: A)", "external_references": ref("T1059"), "kill_chain_phases": phase},
        {"id": "t2", "type": "attack-pattern", "name": "Shell", "external_references": ref("T1059.001")}, {"id": "ta", "type": "x-mitre-tactic", "name": "Execution", "x_mitre_shortname": "execution", "external_references": ref("TA0002")},
        {"id": "old", "type": "attack-pattern", "name": "Old", "revoked": True, "external_references": ref("T1064")}, {"id": "g", "type": "intrusion-set", "name": "Cozy Bear", "aliases": ["Bear Two"], "external_references": ref("G0016")},
        {"id": "r1", "type": "relationship", "relationship_type": "revoked-by", "source_ref": "old", "target_ref": "t1"},
        {"id": "r2", "type": "relationship", "relationship_type": "uses", "source_ref": "g", "target_ref": "t2", "description": "[It](http://x) ran a shell for long."},
    ]
    import json

    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "objects": objects}, indent=1))
    o = readers.stix_objects(spark, str(tmp_path / "b.json"))
    assert {(r.id, r.parent) for r in taxonomy.hierarchy(o).collect()} == {("T1059.001", "T1059"), ("T1059", "TA0002"), ("T1059.001", "TA0002")}
    assert {r.attack_id for r in taxonomy.cards(o).collect()} == {"T1059", "T1059.001", "TA0002", "G0016"}
    assert [tuple(r) for r in taxonomy.revoked_map(o).collect()] == [("T1064", "T1059")]
    assert [tuple(r) for r in taxonomy.procedure_examples(o).collect()] == [("It ran a shell for long.", "T1059.001")]
    assert {r.token for r in taxonomy.alias_tokens(o).collect()} == {"cozy", "bear", "two"}
    assert column(spark, taxonomy.rolled_up_label(F.lit("T1059.001"), F.array(F.lit("T1059")))) == 1


@pytest.mark.parametrize("text, want", [("```json\n[{'a': 1,}]\n```", '[{"a": 1}]'), ("x {a: 1} y", '{"a": 1}')])
def test_json_repair(spark, text, want):
    assert column(spark, X.repair_json(F.lit(text))) == want


def test_fuzzy_consensus_query_takes_whole_turns(spark, tmp_path):
    from threadloom.plans import units

    long = "the same opening words of a turn that go on for well over eighty characters before "
    turns = [(1, 0, "user", "short one"), (1, 1, "user", long + "alpha " * 20), (1, 2, "user", long + "omega " * 20)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = units.fuzzy_consensus(spark, str(tmp_path)).collect()
    assert {r.quote for r in out} == {t[3] for t in turns}
