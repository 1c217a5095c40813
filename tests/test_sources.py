"""Readers, sinks and the resumable stream."""

import json

from pyspark.sql import functions as F

from threadloom.sources import readers, sinks
from threadloom.streaming import incremental

ITEM = "struct<a int, b string>"


def test_json_ladder(spark, tmp_path):
    cases = {
        "array": '[{"a": 1, "b": "x"}, {"a": 2}]', "lines": '{"a": 1}\n\n{"a": 2}\nbroken\n{"a": 3}\n', "joined": '{"a": 1} {"a": 2}\n  {"a": 3}', "cut": '[{"a": 1}, {"a": 2}, {"a": 3, "b": "x', "bom": '﻿[{"a": 7}]', "none": "nothing here",
    }
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r["items"] and [x.a for x in r["items"]] for r in readers.json_ladder(spark, str(tmp_path), ITEM).collect()}
    assert got == {"array": [1, 2], "lines": [1, 2], "joined": [1, 2, 3], "cut": [1, 2], "bom": [7], "none": None}


def test_lines_csv_and_encodings(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": 1}\nbad\n{"a": 3}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "l.json"), "a int").collect()) == [1, 3]
    (tmp_path / "c.csv").write_text("x,y\n1,2.5\nz,\n")
    out = readers.typed_csv(spark, str(tmp_path / "c.csv"), {"x": ("int", 0), "y": ("double", -1.0), "w": ("string", "none")}).collect()
    assert [tuple(r) for r in out] == [(1, 2.5, "none"), (0, -1.0, "none")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "u").write_bytes("﻿é".encode())
    (tmp_path / "e" / "l").write_bytes("é".encode("latin-1"))
    assert [r.text for r in readers.text_ladder(spark, str(tmp_path / "e")).collect()] == ["é", "é"]


def test_bio_and_tagged_items(spark, tmp_path):
    (tmp_path / "t.txt").write_text("A\tB-X\nb I-X\n\n\nC\tO\nd\n")
    rows = [tuple(r)[1:] for r in readers.bio(spark, str(tmp_path / "t.txt")).orderBy("sentence", "place").collect()]
    assert rows == [(1, 1, "A", "B-X"), (1, 2, "b", "I-X"), (2, 1, "C", "O"), (2, 2, "d", "O")]
    items = spark.createDataFrame([("i", ["a", "b", "c"], ["1", "0"])], "id string, tokens array<string>, tags array<string>")
    assert [(r.token, r.tag) for r in readers.tagged_items(items, {0: "O", 1: "B-X"}).collect()] == [("a", "B-X"), ("b", "O")]


def test_documents_and_mapping(spark, tmp_path):
    (tmp_path / "g1").mkdir()
    (tmp_path / "g1" / "r.txt").write_text("hello")
    (tmp_path / "m.csv").write_text("Title,Document,Identifier,Group\nT,r.txt,ID1,g\n")
    d = readers.documents(spark, str(tmp_path), "*.txt").join(readers.document_mapping(spark, str(tmp_path / "m.csv")).withColumnRenamed("key", "stem"), "stem").first()
    assert (d.group, d.identifier, len(d.id)) == ("g1", "ID1", 16)


def test_cache_scores_only_misses(spark):
    seen = []

    def score(df):
        seen.append(df.count())
        return df.select("key", F.length("text").alias("value"))

    units = spark.createDataFrame([("aa",), ("bbb",), ("aa",)], "text string")
    cache = units.where("text = 'aa'").distinct().select(F.sha1("text").alias("key"), F.lit(99).alias("value"))
    out, new = readers.cached_scores(units, cache, score)
    assert sorted((r.text, r.value) for r in out.collect()) == [("aa", 99), ("aa", 99), ("bbb", 3)] and seen == [1] and new.count() == 1


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "manifest.jsonl")
    assert sinks.read_manifest(spark, path) == []
    for k in range(3):
        sinks.append_manifest(spark, path, {"k": k})
    assert [e["k"] for e in sinks.read_manifest(spark, path)] == [0, 1, 2]
    sinks.delimited(spark.range(2), str(tmp_path / "d"), "\t")
    sinks.json_lines(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    both = readers.concatenated([spark.range(1).select("id"), spark.range(1).select("id", F.lit(1).alias("x"))])
    assert both.columns == ["id", "x"] and both.count() == 2


TRIPLES = "seq int, subject string, subject_type string, predicate string, object string, object_type string, context string"


def test_stream_resumes_and_repeats_nothing(spark, tmp_path):
    source, folder, mark = (str(tmp_path / x) for x in ("in", "graph", "mark"))
    batch = lambda rows: spark.createDataFrame(rows, TRIPLES).coalesce(1).write.mode("append").parquet(source)
    batch([(1, "A", "t", "uses", "B", "t", "c1")])
    incremental.ingest(spark, source, TRIPLES, folder, mark).awaitTermination()
    batch([(2, "a", "t", "uses", "C", "t", "c2")])
    for _ in range(2):  # the second run finds nothing new
        incremental.ingest(spark, source, TRIPLES, folder, mark).awaitTermination()
    nodes = {r.name: r.contexts for r in incremental.current(spark, f"{folder}/nodes").collect()}
    assert nodes == {"A": ["c1", "c2"], "B": ["c1"], "C": ["c2"]} and incremental.current(spark, f"{folder}/edges").count() == 2
    before = json.dumps(sorted(map(str, incremental.current(spark, f"{folder}/nodes").collect())))
    incremental.upsert_batch(spark.read.parquet(source), 1, folder)  # a batch that was done is skipped
    assert json.dumps(sorted(map(str, incremental.current(spark, f"{folder}/nodes").collect()))) == before


def test_windows_on_tables(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert incremental.windowed_counts(e, "ts", ["event_type"], "1 day").agg(F.sum("n")).first()[0] == e.count()
