import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import packing as P
from threadloom.llm.tokens import default_vocabulary, encoder


def brute_cost(penalty, window):
    cost = [0.0] * len(penalty)
    for j in range(1, len(penalty)):
        cost[j] = penalty[j] + min(cost[i] + window - (j - i) for i in range(max(0, j - window), j))
    return cost


def test_sliding_minima_match_brute_force_over_all_places():
    rnd = random.Random(1)
    for _ in range(60):
        window = rnd.randint(1, 40)
        penalty = np.array([0.0] + [rnd.choice((0.0, 2.0, 10.0, 10.0, 300.0)) for _ in range(rnd.randint(1, 300))])
        f = P.cut_costs(penalty, window)
        assert np.allclose(f - np.arange(len(f)), brute_cost(penalty.tolist(), window))
        chain = [0, *P.cut_chain(f, len(penalty) - 1, window)]
        lengths = np.diff(chain)
        assert (lengths >= 1).all() and (lengths <= window).all()
        assert np.isclose(penalty[chain].sum() + (window - lengths).sum(), f[-1] - len(penalty) + 1)


def test_the_rest_is_cut_at_least_cost():
    from functools import cache

    rnd = random.Random(4)
    for _ in range(40):
        n, window = rnd.randint(1, 14), 16
        penalty = np.array([0.0] + [rnd.choice((0.0, 2.0, 10.0)) for _ in range(n - 1)] + [0.0])

        @cache
        def best(x, penalty=penalty, n=n):
            return 0.0 if x == n else min(penalty[y] + P.padding(y - x, window) + best(y) for y in range(x + 1, n + 1))

        rest, after = P.closing(penalty, window)
        assert np.allclose(rest, [best(x) for x in range(n + 1)])
        assert all(x < after[x] <= n for x in range(n))


def check(rows, texts, window=P.WINDOW):
    """Round trip: each document's ids, in order, once; sequences gapless and within the window; returns padding per token."""
    of = encoder()
    docs, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and r.start == sum(map(len, docs.setdefault(r.doc_id, [])))
        docs[r.doc_id].append(ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_to))
        assert r.doc_tokens == len(of.encode(texts[r.doc_id], special=True)) + 1
    for k, t in texts.items():
        assert np.concatenate(docs[k]).tolist() == [*of.encode(t, special=True), P.END_ID]
    padding = total = 0
    for pieces in sequences.values():
        size = 0
        for offset, length, padded in sorted(pieces):
            assert offset == size
            size += length
        assert size <= window and padded == (size if size & (size - 1) == 0 else window)
        padding, total = padding + padded - size, total + size
    return padding / total


def test_round_trip_and_padding(make):
    rnd = random.Random(2)
    texts = {k: " ".join(rnd.choice(("Some words.", "more of it", "x", "\n", "naïve 123!")) for _ in range(rnd.randint(0, 900))) for k in range(80)}
    texts |= {100: "", 101: None, 102: "word " * 60_000, 103: "a" * 20_000, 104: "混ぜる 漢字 🙂 " * 50, 105: "a <|endoftext|> b", 106: "漢<|endoftext|>"}
    rows = P.pack(make(list(texts.items())).coalesce(1)).collect()
    assert check(rows, texts) < 0.01
    small = P.pack(make(list(texts.items())).repartition(3, "doc_id"), window=256).collect()
    check(small, texts, 256)


def test_order_is_kept_and_repeatable(make):
    docs = make([f"document number {k}. " * 40 for k in range(50)]).coalesce(1)
    rows = P.pack(docs).collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert rows == P.pack(docs).collect()


def test_nulls_repeats_empty_and_clashing_columns(make):
    docs = make([(None, "a b"), (1, None), (2, "x"), (2, "x")], {"ids": F.lit(1), "start": F.lit(2)})
    rows = P.pack(docs).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert sorted((str(r.doc_id), r.doc_tokens, r.n) for r in rows) == [("1", 1, 1), ("2", 2, 4), ("None", 3, 3)]
    assert P.pack(docs.limit(0)).collect() == []


def test_spark_crc_is_the_contract_s(make):
    r = P.pack(make(["some text"])).withColumn("crc", F.crc32("ids")).first()
    assert r.crc == zlib.crc32(bytes(r.ids))


def test_fast_encoder_gives_the_library_s_ids():
    from tokenizers import Tokenizer

    plain, rnd = Tokenizer.from_file(default_vocabulary()), random.Random(3)
    letters = [chr(c) for c in range(0x260)] + list(" \n\t'sté1.漢🙂")
    for _ in range(3000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 20)))
        assert encoder().encode(t) == plain.encode(t, add_special_tokens=False).ids


def test_strings_of_special_tokens():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_vocabulary())
    for t in ("<|endoftext|>", "a <|endoftext|> b", "漢 <|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext"):
        assert encoder().encode(t, special=True) == plain.encode(t, add_special_tokens=False).ids
        assert 50256 not in encoder().encode(t)
