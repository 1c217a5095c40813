import random
import re

import xxhash
from pyspark.sql import functions as F

from threadloom.llm import simhash as H


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {f: f for f in fps}

    def find(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= H.RADIUS:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


TEXTS = [None, "", " \x0b\n", "A", "a", "a B", "a b C d", "É é ÀB c", "x y z\x85w", "w " * 400, "Word " * 70_000, " ".join(f"t{k}" for k in range(40_000))]


def test_fingerprints_match_brute_force(spark, make):
    rows = H.near_duplicates(make(TEXTS)).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in rows} == {k: brute_fingerprint(t) for k, t in enumerate(TEXTS)}
    # Spark's own hash of a shingle is the one used
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check(spark, fps):
    rows = spark.createDataFrame([(k, signed(f)) for k, f in enumerate(fps)], "doc_id long, fp long")
    found = {r.fp & (1 << 64) - 1: r.component_id for r in H.fp_components(rows).collect()}
    roots = brute_components(sorted(set(fps)))
    least = {}
    for k, f in enumerate(fps):
        least[roots[f]] = min(least.get(roots[f], k), k)
    assert found == {f: least[roots[f]] for f in set(fps)}


def test_links_in_every_split_of_bits(spark):
    rnd, fps = random.Random(1), []
    for _ in range(60):
        f = rnd.getrandbits(64)
        fps += [f] + [f ^ sum(1 << b for b in rnd.sample(range(64), d)) for d in (1, 2, 3, 3, 4, 5)]
    check(spark, fps + [0, 7, 15, (1 << 64) - 1])


def test_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT", 3)  # every deeper level is taken
    rnd, fps = random.Random(2), []
    for centre in (rnd.getrandbits(64), rnd.getrandbits(64)):
        for _ in range(150):
            fps.append(centre ^ sum(1 << b for b in rnd.sample(range(24), rnd.randint(0, 6))))
        fps += [centre ^ (1 << b) ^ (1 << (b + 7) % 64) ^ (1 << (b + 31) % 64) for b in range(40)]
    check(spark, fps)


def test_hot_bucket_sends_no_pairs(spark):
    rnd = random.Random(3)
    fps = sorted({(5 << 40) ^ sum(1 << b for b in rnd.sample(range(12), rnd.randint(0, 6))) for _ in range(1500)})
    links = H.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert links.count() < 60 * len(fps)
    check(spark, fps)


def test_nulls_repeats_empty_and_clashing_columns(make):
    docs = make([(None, "some words here"), (4, "some words here"), (9, "other text of its own"), (9, "other text of its own"), (3, None)], {"fp": F.lit(1), "component_id": F.lit(2), "_fp": F.lit(0)})
    rows = sorted((str(r.doc_id), r.component_id) for r in H.near_duplicates(docs).collect())
    assert rows == [("3", 3), ("4", 4), ("9", 9), ("9", 9), ("None", 4)]
    kept = H.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 9]
    assert H.near_duplicates(docs.limit(0)).collect() == [] and H.drop_near_duplicates(docs.limit(0)).collect() == []
    assert H.near_duplicates(make([(None, "only")])).first().component_id is None
    assert H.drop_near_duplicates(make([(None, "only")])).count() == 1


def test_stage_drops_texts_of_similar_shingles(make):
    rnd = random.Random(8)
    grams = lambda t: {" ".join(w) for w in zip(*[t.split()[k:] for k in range(5)], strict=False)}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    rows, dropped = [], set()
    for n in range(60):
        w = [f"w{rnd.randint(0, 5000)}" for _ in range(120)]
        copy = w[:]
        for k in rnd.sample(range(10, 110), 1 + n % 6):
            copy[k] = "other"
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(copy))]
        near = bin(brute_fingerprint(rows[-2][1]) ^ brute_fingerprint(rows[-1][1])).count("1") <= H.RADIUS
        dropped |= {2 * n + 1} if near or alike(rows[-2][1], rows[-1][1]) >= 0.8 else set()
    far = [k for k in dropped if bin(brute_fingerprint(rows[k - 1][1]) ^ brute_fingerprint(rows[k][1])).count("1") > H.RADIUS]
    assert len(far) > 10 and len(dropped) < 60
    kept = {r.doc_id for r in H.drop_near_duplicates(make(rows)).collect()}
    assert kept == {k for k, _ in rows} - dropped


def test_a_large_bucket_is_compared_in_blocks(spark, make, monkeypatch):
    from threadloom.llm import similar as S

    monkeypatch.setattr(S, "MEMBERS", 5)
    rnd, rows = random.Random(12), []
    w = [f"w{rnd.randint(0, 5000)}" for _ in range(150)]
    for n in range(60):  # a chain of edits: neighbours are similar, far ones aren't
        for k in rnd.sample(range(150), 2):
            w[k] = f"v{rnd.randint(0, 5000)}"
        rows.append((n, " ".join(w)))
    rnd.shuffle(rows)
    texts = dict(rows)
    grams, fps = {n: S.shingles(S.words(t)) for n, t in texts.items()}, {n: brute_fingerprint(t) for n, t in texts.items()}
    linked = [(a, b) for a in texts for b in texts if a < b and (S.similarity(grams[a], grams[b]) >= S.SIMILARITY or bin(fps[a] ^ fps[b]).count("1") <= H.RADIUS)]
    label = {n: n for n in texts}
    for _ in texts:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    kept = {r.doc_id for r in H.drop_near_duplicates(make(rows)).collect()}
    assert kept == {n for n in texts if label[n] == n}


def test_a_group_of_texts_that_are_not_quite_similar_sends_no_pairs(spark, make):
    from threadloom.llm import similar as S

    rnd = random.Random(13)
    w = [f"w{k}" for k in range(200)]
    rows = []
    for n in range(300):
        own = w[:]
        for k in rnd.sample(range(200), 6):
            own[k] = f"x{rnd.randint(0, 10_000)}"
        rows.append((n, " ".join(own)))
    keyed = S.with_keys(make(rows).select("doc_id", "text"), signed=True)
    cells = keyed.select("node", F.col("node").alias("root"), F.posexplode("bands").alias("band", "bucket"))
    together = cells.alias("a").join(cells.alias("b"), ["band", "bucket"]).where("a.node < b.node").select("a.node", "b.node").distinct().count()
    coarse = S._likely(S._mixed(cells), keyed.select("node", "sketch", F.lit(None).cast("binary").alias("finer")), best=False).count()
    finer = keyed.select("node", "sketch").join(S._finer(S.with_keys(make(rows).select("text"), signed=False)), "node")
    likely = S._likely(S._mixed(cells), finer, best=False).count()
    assert together > 10_000 and likely <= coarse < together and likely < together / 20
    assert S._likely(S._mixed(cells), finer, best=True).count() <= 300


def test_the_same_result_without_broadcast(make, monkeypatch):
    from threadloom.llm import similar as S

    rnd, rows = random.Random(21), []
    for n in range(25):
        w = [f"w{rnd.randint(0, 5000)}" for _ in range(100)]
        copy = w[:]
        copy[50] = "other"
        rows += [(3 * n, " ".join(w)), (3 * n + 1, " ".join(copy)), (3 * n + 2, " ".join(copy))]
    want = {r.doc_id for r in H.drop_near_duplicates(make(rows)).collect()}
    monkeypatch.setattr(S, "checked_broadcast", lambda df, n=0: df)
    assert {r.doc_id for r in H.drop_near_duplicates(make(rows)).collect()} == want == {3 * n for n in range(25)}


def test_a_bucket_makes_one_pair_for_each_component():
    import numpy as np
    import pyarrow as pa

    from threadloom.llm import similar

    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 256, similar.BANDS * similar.ROWS, dtype=np.uint8)
    values = np.tile(base, (90, 1))
    for row in values:  # near copies, some too far from the others
        at = rnd.choice(len(base), rnd.integers(0, 60), replace=False)
        row[at] = rnd.integers(0, 256, len(at))
    side, root = np.arange(90) % 2, np.arange(90) % 7 + 1000 * (np.arange(90) > 70) * np.arange(90)
    for sides in (np.zeros(90, int), side):
        columns = [np.zeros(90, int), np.zeros(90, int), np.zeros(90, int), sides.max() + np.zeros(90, int), sides, np.arange(90), root, [v.tobytes() for v in values], [None] * 90]
        names = ["band", "bucket", "low", "high", "side", "node", "root", "sketch", "finer"]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        got = [(a, b) for out in similar._pairs(True)(iter([batch])) for a, b in zip(*[c.to_pylist() for c in out.columns])]
        agree = lambda a, b: int((values[a] == values[b]).sum())
        may = {(a, b) for a in range(90) for b in range(a + 1, 90) if root[a] != root[b] and (not sides.any() or sides[a] != sides[b]) and agree(a, b) >= similar.AGREE}
        assert len(got) == len(set(got)) and set(got) <= may
        components = {(sides[k], root[k]) for p in may for k in p}
        assert len(got) <= len(components)
        for own, r in components:  # the likest pair of each is there, or one as like
            mine = lambda p: any(root[k] == r and sides[k] == own for k in p)
            assert max(agree(*p) for p in may if mine(p)) == max((agree(*p) for p in got if mine(p)), default=-1)
