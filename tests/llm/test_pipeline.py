import random
import re

import numpy as np
import pytest

from threadloom.llm import catalog
from threadloom.llm.tokens import encoder

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rnd, n=90):
    return " ".join(f"{rnd.choice(('alpha', 'beta', 'gamma', 'delta'))}{rnd.randint(0, 900)}{'.' if k % 9 == 8 else ''}" for k in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, path = random.Random(1), str(tmp_path_factory.mktemp("data"))
    item = prose(rnd, 25)
    clean = {k: prose(rnd) for k in range(40)}
    planted = {
        100: clean[3],  # a copy
        101: prose(rnd, 20),  # too short
        102: " ".join(w + "###" for w in prose(rnd).split()),  # junk
        103: prose(rnd) + " " + item + " " + prose(rnd),  # a leak
        104: prose(rnd) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(rnd),  # a secret
        105: None,
    }
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in (clean | planted).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, clean, planted


def test_stages_take_effect_and_keep_clean_documents(spark, folder, tmp_path):
    path, clean, planted = folder
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontamination", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == DOCUMENT
            left[name] = {r.doc_id: r for r in docs.collect()}
    assert set(left["quality_rules"]) == set(clean) | {100, 103, 104}
    assert set(left["simhash_near_dedup"]) == set(clean) | {103, 104}
    assert set(left["decontamination"]) == set(clean) | {104}
    final = left["secret_scan"]
    assert "[assign]" in final[104].text and not re.search("[0-9a-f]{24}", final[104].text)
    assert all(final[k].text == t and final[k].n_chars == len(t) for k, t in clean.items()) and final[104].n_chars == len(final[104].text)
    ids = {}
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids == {k: [*encoder().encode(r.text), 1] for k, r in final.items()}


def test_run_is_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(folder[1]) | {104}


def test_one_query_per_operator():
    names = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES)
    assert names == list(range(1, 11))


def through(spark, docs, path, folder):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def test_odd_tables_pass_all_stages(spark, tmp_path):
    from pyspark.sql import functions as F

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rnd = random.Random(7)
    long = " ".join(f"w{rnd.randint(0, 10**6)}" + "." * (k % 12 == 11) for k in range(60_000)) + " token=abcdefg1"
    rows = [(1, long, "en", "s", len(long)), (None, prose(rnd), None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, prose(rnd), "en", "s", 1)]
    rows.append((6, rows[4][1], "en", "s", 1))
    docs = spark.createDataFrame(rows, kinds).withColumns({c: F.lit("x") for c in ("fp", "node", "blob_id", "spans", "_id", "_node", "n_words", "kept", "limits", "_row2", "cuts")})
    path = str(tmp_path / "empty-benchmark")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    out = through(spark, docs, path, str(tmp_path / "a"))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {1, None, 5}
    before = spark.read.parquet(f"{tmp_path}/a/secret_scan")
    assert before.columns == docs.columns and before.where("doc_id = 1").first().text == long.replace("token=abcdefg1", "[assign]")
    assert through(spark, docs.limit(0), path, str(tmp_path / "b")).collect() == []
