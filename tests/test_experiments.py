import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import chunking, experiments, extraction, graph, kernels
from threadloom.sources import config


def column(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def brute_overlapping(v, words, least, most, overlap, ahead):
    """Word for word from the rules."""
    spans, i, n = [], 0, len(words)
    while i < n:
        end, total = i + 1, words[i]
        while end < n and total < most:
            if any(np.dot(v[end - 1], v[k]) < least for k in range(max(i, end - ahead), end)):
                break
            total += words[end]
            end += 1
        spans.append((i, end))
        if end >= n:
            return spans
        if overlap <= 0:
            i = end
            continue
        seen, k = 0, end - 1
        while k > i and seen < overlap:
            seen += words[k]
            k -= 1
        i = max(k + 1, i + 1)
    return spans


def brute_chunks(v, words, least, most, ahead, overlap):
    """Greedy chunks by the definition of chunk_spans: the next sentence, or one within ``ahead``, is alike to the centroid, and what is taken fits."""
    spans, start, n = [], 0, len(words)
    cos = lambda a, b: float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) if np.linalg.norm(a) * np.linalg.norm(b) > 0 else -2.0
    while start < n:
        end, total = start + 1, words[start]
        while end < n:
            centre = v[start:end].sum(axis=0)
            step = next((k for k in range(1, ahead + 1) if end + k <= n and cos(v[end + k - 1], centre) >= least - 1e-12), None)
            if step is None or total + sum(words[end : end + step]) > most:
                break
            total += sum(words[end : end + step])
            end += step
        spans.append((start, end))
        if end >= n:
            return spans
        back, seen = end, 0
        while back > start + 1 and seen + words[back - 1] <= overlap:
            seen += words[back - 1]
            back -= 1
        start = max(back, start + 1)
    return spans


def test_overlapping_spans_match_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        n = rnd.randint(0, 25)
        v = np.array([[rnd.choice((0.0, 1.0)) for _ in range(3)] for _ in range(n)]).reshape(n, 3)
        words = [rnd.randint(1, 9) for _ in range(n)]
        args = (rnd.choice((0.0, 1.0, 2.0)), rnd.randint(1, 40), rnd.choice((0, 3, 8)), rnd.randint(1, 4))
        assert chunking.overlapping_spans(v, words, *args) == brute_overlapping(v, words, *args)


def test_chunk_spans_match_brute_force():
    rng, rnd = np.random.default_rng(5), random.Random(5)
    for _ in range(200):
        n = rnd.randint(1, 20)
        v, words = rng.normal(size=(n, 3)), [rnd.randint(1, 9) for _ in range(n)]
        args = (rnd.choice((-0.5, 0.0, 0.4, 0.8)), rnd.randint(5, 40), rnd.randint(1, 4), rnd.choice((0, 3, 8)))
        assert chunking.chunk_spans(v, words, args[0], args[1], args[2], args[3]) == brute_chunks(v, words, *args)


def test_coalescing():
    words = [3, 4, 2, 10, 10, 1, 30]
    assert chunking.coalesce_halving([(0, 1), (1, 2), (2, 3), (3, 5), (5, 6), (6, 7)], words, 6, 15) == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 7)]
    assert chunking.coalesce_halving([], [], 1, 1) == []
    got = chunking.coalesce_buffered([(0, 1), (1, 2), (2, 3), (3, 5), (5, 6), (6, 7)], words, [0.5, None, 0.2, 0.9, 0.1, 0.3], 6, 25)
    assert got == [(0, 3, 0.2), (3, 6, 0.1), (6, 7, 0.3)]
    assert chunking.coalesce_buffered([(0, 5)], [10, 10, 10, 10, 10], [None], 5, 25) == [(0, 2, None), (2, 4, None), (4, 5, None)]


def test_wilcoxon_matches_ranks_by_hand():
    from statistics import NormalDist

    rnd = random.Random(2)
    for _ in range(40):
        d = [rnd.choice((-3, -2, -1, 0, 1, 2, 5)) + rnd.choice((0, 0.5)) for _ in range(rnd.randint(3, 30))]
        if not any(d):
            continue
        size = sorted(map(abs, d))
        rank = {x: sum(i + 1 for i, y in enumerate(size) if y == x) / size.count(x) for x in size}
        up, down = sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0)
        n, z = len(d), d.count(0)
        mean = n * (n + 1) / 4 - z * (z + 1) / 4
        ties = sum(size.count(x) ** 3 - size.count(x) for x in set(size) if x)
        var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1)) / 24 - ties / 48
        t, p = kernels.wilcoxon(d)
        assert t == min(up, down) and p == pytest.approx(min(1.0, 2 * NormalDist().cdf((t - mean) / math.sqrt(var))))


def test_bca_covers_the_mean():
    rng, hits = np.random.default_rng(4), 0
    for k in range(120):
        low, high = kernels.bca(rng.normal(1.0, 2.0, 40), replicates=600, seed=k)
        hits += low <= 1.0 <= high
    assert 0.88 <= hits / 120 <= 1.0


def test_splits_of_actors(spark):
    q = spark.createDataFrame([(f"q{k}", "a", 1) for k in range(25)] + [("x", "external_z", 1), ("y", "a", 0), ("z", "b", 2)], "query string, actor string, n_gold int")
    got = {(r.actor, r.split): r["count"] for r in experiments.actor_split(q, 1).groupBy("actor", "split").count().collect()}
    assert got == {("a", "train"): 20, ("a", "validation"): 2, ("a", "test"): 3, ("b", "test"): 1}


def test_held_out_documents_at_a_stride(spark):
    names = [f"doc{k:03d}" for k in range(50)]
    got = sorted(r.document for r in experiments.held_out(spark.createDataFrame([(n,) for n in names * 2], "document string")).collect())
    assert got == names[::10][:5]
    splits = spark.createDataFrame([("train", "a"), ("train", "b"), ("test", "b"), ("test", "b")], "split string, document string")
    assert [(r.document, r.splits) for r in experiments.overlapping(splits).collect()] == [("b", ["test", "train"])]


def test_training_pairs(spark):
    corpus = spark.createDataFrame([(f"c{k}", f"red fox {k}") for k in range(10)] + [("far", "blue whale")], "id string, text string")
    q = spark.createDataFrame([("q", "red fox", ["c1", "c2"])], "qid string, query_raw string, gold_ids array<string>")
    rows = experiments.training_pairs(q, corpus, 3).collect()
    assert sum(r.label for r in rows) == 2 and len(rows) == 2 + 5 and not {r.id for r in rows if not r.label} & {"c1", "c2", "far"}


def test_systems_and_effects(spark):
    a = spark.createDataFrame([("one  two", 1), ("b", 1), ("c", 0), ("d", 1)], "query string, correct int")
    b = spark.createDataFrame([(" one two ", 0), ("b", 0), ("c", 1), ("e", 1)], "query string, correct int")
    r = experiments.compare_systems(a, b).first()
    assert (r.shared, r.only_a, r.only_b, r.both) == (3, 2, 1, 0) and r.chi2 == pytest.approx(1 / 3) and r.p_value == pytest.approx(math.erfc(math.sqrt(1 / 6))) and r.stars == "ns"
    assert experiments.compare_systems(a, a).first().p_value is None
    v = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 4.0), ("y", 9.0), ("y", 8.5), ("z", 0.0)], "g string, x double")
    w = experiments.welch(v, "g", "x", "y").first()
    x, y = np.array([1, 2, 4.0]), np.array([9, 8.5])
    assert w.t == pytest.approx((x.mean() - y.mean()) / math.sqrt(x.var(ddof=1) / 3 + y.var(ddof=1) / 2)) and w.effect == "LARGE"


def test_blends(spark):
    a = spark.createDataFrame([("w", 0, 1.0), ("w", 1, 3.0)], "name string, place int, value double")
    b = spark.createDataFrame([("w", 0, 5.0), ("w", 1, 3.0)], "name string, place int, value double")
    assert {r.place: r.value for r in experiments.blend(a, b, 0.25).collect()} == {0: 2.0, 1: 3.0}
    assert {r.place: r.value for r in experiments.soup([a, b]).collect()} == {0: 3.0, 1: 3.0}
    with pytest.raises(Exception, match="differ"):
        experiments.blend(a, b.limit(1), 0.5).collect()


def test_replies(spark):
    good = '[{"subject": {"name": "A", "type": "t"}, "predicate": "uses", "object": {"text": "B"}}]'
    n = lambda c: len(column(spark, c))
    for reply, loose, strict in ((good, 1, 1), ("```json\n" + good + "\n```", 1, 1), ("x " + good + " y", 1, 1), (good[1:-1], 0, 1), ("no", 0, 0), (None, 0, 0), ("[1, {", 0, 0)):
        r = F.lit(reply).cast("string")
        assert (n(extraction.loose_json_list(r)), n(extraction.any_json(r))) == (loose, strict)


def test_tags(spark):
    of = lambda c: column(spark, c)
    assert [of(graph.tag_type(F.lit(t))) for t in ("B-org", "I-TECHNIQUE", "O", "B-X", "ORG")] == ["identity", "attack-pattern", None, None, None]
    assert of(graph.named_tags(F.array(*[F.lit(x) for x in (0, 5, 99, -1)]))) == ["O", "B-TOOL", "O", "O"]
    assert of(graph.checked_tags(F.array(F.lit("O"), F.lit("B-x")))) == ["O", "B-x"] and of(graph.checked_tags(F.array(F.lit("Z")))) is None
    codes = [2, 1, 2, 2, 0, 1, 1, 2]
    spans = of(graph.plain_entities(F.array(*[F.lit(f"t{k}") for k in range(8)]), F.array(*[F.lit(c) for c in codes])))
    assert [(s.text, s.start, s.end) for s in spans] == [("t1 t2 t3", 1, 4), ("t5", 5, 6), ("t6 t7", 6, 8)]


def test_settings_and_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"model": "x", "passes": 3}')
    assert config.settings(spark, str(tmp_path / "s.json")) == {"model": "x", "passes": 3}
    with pytest.raises(ValueError):
        config.Options(passes=1, votes=2).checked()
    assert config.Options().checked().passes == 3 and config.load(" Token-Tags ") is not None
    with pytest.raises(ValueError):
        config.load("nothing")
    base = tmp_path / "data"
    (base / "ner_json").mkdir(parents=True)
    for name in ("dev", "test"):
        (base / "ner_json" / f"{name}.json").write_text("[]")
    assert [p.rsplit("/", 1)[1] for p in config.split_files(spark, str(base), "dev")] == ["dev.json"] and len(config.split_files(spark, str(base), "none")) == 2
    (tmp_path / "r1.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "r2.json").write_text('{"items": [{"a": 3}]}')
    rows = config.rejected_triples(spark, str(tmp_path / "r*.json")).collect()
    assert sorted(r.row for r in rows) == ['{"a":1}', '{"a":2}', '{"a":3}']
