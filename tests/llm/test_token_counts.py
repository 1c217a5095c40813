import random

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import token_counts as C
from threadloom.llm.tokens import encoder


def test_counts_match_the_encoder(make, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_IDS", 64)  # documents lie across many blocks
    rnd = random.Random(1)
    texts = {k: " ".join(rnd.choice(("a", "word", "<|endoftext|>", "é", "\n")) for _ in range(rnd.choice((0, 1, 5, 40, 700)))) for k in range(120)} | {500: None, 501: ""}
    monkeypatch.setattr(C, "ROSTER", 7)
    blocks, roster = C.write_token_files(make(list(texts.items())).repartition(3, "doc_id"))
    assert blocks.columns == ["file", "block", "payload"] and blocks.where("length(payload) > 128").count() == 0
    got = {r.doc_id: r.n_tokens for r in C.named(C.document_lengths(blocks), roster).collect()}
    assert got == {k: len(encoder().encode(t)) for k, t in texts.items()}


def test_flat_files_without_an_index(spark, tmp_path):
    rnd, sep, expected, tails = random.Random(2), C.SEPARATOR, {}, {}
    for name in ("a", "b", "c", "d"):
        ids = [rnd.choice((1, 2, 3, 4, 5, 6, 7, sep)) for _ in range(rnd.randint(200, 400))] if name != "d" else [1] * 333
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
        parts = [[]]
        for x in ids:
            parts.append([]) if x == sep else parts[-1].append(x)
        expected |= {(name, k): len(p) for k, p in enumerate(parts[:-1])}
        tails |= {name: len(parts[-1])} if parts[-1] else {}
    (tmp_path / "empty").write_bytes(b"")
    for size, whole in ((7, 1 << 28), (64, 1 << 28), (1000, 1 << 28), (64, 600), (7, 0)):
        blocks = C.read_flat_files(spark, str(tmp_path), size, whole)
        assert blocks.where(f"length(payload) > {2 * size}").count() == 0
        got = {(r.file.rsplit("/", 1)[1], r.ordinal): r.n_tokens for r in C.document_lengths(blocks).collect()}
        assert got == expected
        assert {r.file.rsplit("/", 1)[1]: r.n_tokens for r in C.unterminated(blocks).collect()} == tails


def test_nulls_repeats_empty_and_clashing_columns(make):
    docs = make([(None, "a b"), (1, None), (2, "x"), (2, "x")], {"file": F.lit(1), "payload": F.lit(b"q")})
    count = lambda d: C.named(C.document_lengths((w := C.write_token_files(d))[0]), w[1]).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in count(docs)) == [("1", 0), ("2", 1), ("2", 1), ("None", 2)]
    assert count(docs.limit(0)) == []


def test_a_document_over_many_blocks_of_real_size(make):
    text = "a b c d e f g h " * 40_000
    blocks, roster = C.write_token_files(make([text, "x", text]).coalesce(1))
    assert blocks.count() > 4
    got = {r.doc_id: r.n_tokens for r in C.named(C.document_lengths(blocks), roster).collect()}
    assert got == {0: len(encoder().encode(text)), 1: 1, 2: len(encoder().encode(text))}
