import random

from pyspark.sql import functions as F

from threadloom.llm import decontaminate as D

ITEMS = "item_id long, text string"


def text(rnd, n, vocabulary=4000):
    return [f"w{rnd.randint(0, vocabulary)}" for _ in range(n)]


def brute_align(a, b):
    """Score and matches of the best local alignment."""
    best = (0, 0)
    table = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s, m = table[i - 1][j - 1]
            diagonal = (s + 2, m + 1) if a[i - 1] == b[j - 1] else (s - 1, m)
            up, left = table[i - 1][j], table[i][j - 1]
            table[i][j] = max((0, 0), diagonal, (up[0] - 1, up[1]), (left[0] - 1, left[1]))
            best = max(best, table[i][j])
    return best


def test_alignment_matches_brute_force():
    import numpy as np

    rnd = random.Random(1)
    for _ in range(200):
        a, b = [rnd.randint(0, 4) for _ in range(rnd.randint(1, 12))], [rnd.randint(0, 4) for _ in range(rnd.randint(1, 15))]
        score, matched, start, end = D.align(np.array(a), np.array(b))
        assert (score, matched) == brute_align(a, b)
        if score:
            assert brute_align(a, b[start:end]) == (score, matched)


def test_finds_edited_copies_and_leaves_others(spark):
    rnd = random.Random(2)
    items = [(k, " ".join(text(rnd, n))) for k, n in enumerate((8, 10, 15, 16, 19, 20, 21, 30, 39, 50, 55, 120))]
    rows, expected = [], set()
    for n in range(240):
        k, body = items[n % len(items)]
        w = body.split()
        out, left = [], int(0.2 * len(w))
        spots = set(rnd.sample(range(len(w)), left))
        for i, x in enumerate(w):
            if i in spots:
                kind = rnd.random()
                out += [] if kind < 0.3 else ["other"] if kind < 0.7 else [x.upper() + "zz"]
            else:
                out.append(x + rnd.choice(("", ",", ".", "\n")))
        rows.append((n, " ".join(text(rnd, rnd.randint(0, 60)) + out + text(rnd, rnd.randint(0, 60)))))
        expected.add((n, k))
    rows += [(1000 + n, " ".join(text(rnd, 150))) for n in range(50)]
    halves = [(2000 + k, " ".join(body.split()[: len(body.split()) // 2])) for k, body in items if len(body.split()) > 20]
    docs = spark.createDataFrame(rows + halves, "doc_id long, text string")
    table = spark.createDataFrame(items, ITEMS)
    found = D.find_leaks(docs, table).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    kept = {r.doc_id for r in D.drop_leaks(docs, table).collect()}
    assert kept == {r[0] for r in rows + halves} - {d for d, _ in expected}
    spans = {r.doc_id: (r.start, r.end) for r in found}
    exact = next(n for n, k in expected if k == 0)
    assert items[0][1].split()[-1] in dict(rows)[exact][spans[exact][0] : spans[exact][1]].lower()


def test_finds_copies_with_words_put_in(spark):
    rnd = random.Random(6)
    items = [(k, " ".join(text(rnd, n))) for k, n in enumerate((9, 16, 20, 36, 55, 120))]
    rows, expected = [], set()
    for n in range(60):
        k, body = items[n % len(items)]
        w, out = body.split(), []
        left = set(rnd.sample(range(len(w)), int(0.2 * len(w)))) if n >= 20 else set()
        for i, x in enumerate(w):
            put = 1 if n >= 40 else i % 2  # after each word, or each second one
            out += (["other"] if i in left else [x]) + [f"in{rnd.randint(0, 99)}"] * put
        rows.append((n, " ".join(text(rnd, rnd.randint(0, 60)) + out + text(rnd, rnd.randint(0, 60)))))
        expected |= {(n, k)} if brute_align(w, rows[-1][1].split())[1] >= D.needed(len(w)) else set()
    assert len(expected) > 40
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    assert expected <= {(r.doc_id, r.item_id) for r in D.find_leaks(docs, table).collect()} <= {(n, n % len(items)) for n, _ in rows}


def test_sparse_copy_counts_beside_a_dense_part(spark):
    body = text(random.Random(7), 40)
    sparse = [y for i, x in enumerate(body) for y in ([x, "other"] if i % 2 else [x])]
    docs = spark.createDataFrame([(1, " ".join(body[:31] + ["far"] * 70 + sparse))], "doc_id long, text string")
    found = D.find_leaks(docs, spark.createDataFrame([(5, " ".join(body))], ITEMS)).collect()
    assert [(r.item_id, r.matched) for r in found] == [(5, 40)]


def test_frequent_grams_lose_to_rare_ones(spark):
    rnd = random.Random(3)
    common = text(rnd, 3)
    item = common + text(rnd, 1) + text(rnd, 16)
    seeds = D.Seeds([(1, " ".join(item))])
    seeds.choose({seeds.grams(seeds.items[0][1])[0]: 10_000})
    assert [tuple(p) for p in seeds.places][0] != (0, 0) and (0, 1) in {tuple(p) for p in seeds.places}


def test_chunks_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_WORDS", 100)
    rnd = random.Random(4)
    items = [(k, " ".join(text(rnd, 30))) for k in range(20)]
    table = spark.createDataFrame(items, ITEMS)
    assert len(list(D.chunk_filters(table))) > 1
    docs = spark.createDataFrame([(k, "x y " + body + " z") for k, body in items] + [(99, "clean text of no item")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs, table).collect()} == {(k, k) for k, _ in items}
    assert [r.doc_id for r in D.drop_leaks(docs, table).collect()] == [99]


def test_nulls_repeats_empty_and_clashing_columns(spark, make):
    body = " ".join(text(random.Random(5), 20))
    items = spark.createDataFrame([(1, body), (1, body), (2, None), (3, "  "), (4, "é ß"), (None, body)], ITEMS)
    docs = make([(None, body), (7, body + " " + body), (8, None), (9, "so É ß it"), (9, "so É ß it"), (10, "")], {"item_id": F.lit(3), "score": F.lit("s")})
    found = sorted((str(r.doc_id), str(r.item_id)) for r in D.find_leaks(docs, items).collect())
    assert found == [("7", "1"), ("7", "None"), ("9", "4"), ("9", "4"), ("None", "1"), ("None", "None")]
    kept = D.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [8, 10]
    assert D.find_leaks(docs.limit(0), items).collect() == [] and D.find_leaks(docs, items.limit(0)).collect() == []
    assert D.drop_leaks(docs, items.limit(0)).count() == 6


def test_very_long_text_and_items_that_tie(spark):
    rnd = random.Random(9)
    body = text(rnd, 30)
    far = text(rnd, 200_000)
    items = spark.createDataFrame([(1, " ".join(body)), (2, " ".join(body)), (3, " ".join(body[:20]))], ITEMS)
    docs = spark.createDataFrame([(5, " ".join(far[:150_000] + body + far[150_000:] + body))], "doc_id long, text string")
    found = {r.item_id: r for r in D.find_leaks(docs, items).collect()}
    assert {k: r.matched for k, r in found.items()} == {1: 30, 2: 30, 3: 20}
    begin = len(" ".join(far[:150_000])) + 1
    assert {(r.start) for r in found.values()} == {begin}
