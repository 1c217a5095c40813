import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import extractor
from threadloom.sources.config import Options

LONG = "The Emotet malware was seen dropping files on many hosts."
OTHER = "A short one. Another group used PowerShell to move laterally there."


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc string, page int, text string")


def t(name, kind="malware", predicate="drops", obj="files", okind="file", quote=None):
    return {"subject": {"name": name, "type": kind}, "predicate": predicate, "object": {"name": obj, "type": okind}, "evidence": {"quote": quote}}


def test_single_stage_counts_and_reasons(spark):
    def load():
        replies = {LONG: json.dumps([t("Emotet"), t("Emotet"), t("X", kind="widget"), t("Y", okind="widget"), t("Z", predicate="befriends"), {"subject": {"name": "Q", "type": "tool"}, "object": {"name": "R", "type": "tool"}}])}
        return lambda prompts: [replies.get(p, "no idea") for p in prompts]

    run = extractor.run(pages(spark, [("a", 1, f"{LONG} {OTHER}"), ("a", 2, LONG), ("b", 1, "Tiny.")]), load, Options(passes=1, votes=1))
    assert sorted((r.doc, r.page, r.i, len(r.triples)) for r in run.chunks.collect()) == [("a", 1, 0, 1), ("a", 2, 0, 1)]
    assert {r.rejection_reason for r in run.rejected.collect()} == {"subject_type_not_in_ontology", "object_type_not_in_ontology", "predicate_not_in_ontology", "invalid_predicate_type"}
    assert {(r.doc, r.page): (r.valid, r.invalid, r.total) for r in run.pages.collect()} == {("a", 1): (2, 4, 6), ("a", 2): (2, 4, 6)}
    m = {r.doc: r for r in run.metrics.collect()}
    assert (m["a"].num_pages, m["a"].num_sentences_total, m["a"].num_sentences_used, m["a"].num_raw_triples, m["a"].num_valid_triples, m["a"].num_invalid_triples) == (2, 4, 3, 12, 2, 8)
    assert m["a"].avg_triples_per_sentence == 4.0 and m["b"].num_sentences_used == 0 and m["b"].avg_triples_per_sentence == 0.0


def test_consensus_needs_its_votes(spark):
    def load():
        def answer(p):
            if p.startswith("v0"):
                return json.dumps([t("Emotet", quote="malware was seen dropping files"), t("Once")])
            return json.dumps([t("Emotets", quote="malware was seen dropping files on hosts")]) if p.startswith("v1") else "{broken"

        return lambda prompts: [answer(p) for p in prompts]

    run = extractor.run(pages(spark, [("a", 1, LONG)]), load, Options(passes=3, votes=2), templates=["v0 {text}", "v1 {text}", "v2 {text}"])
    rows = run.chunks.collect()
    assert [[x.s_name for x in r.triples] for r in rows] == [["Emotets"]]  # the longer quote speaks


def test_gate_chunks_and_failing_models(spark):
    def load():
        def model(prompts):
            raise RuntimeError("down")

        return model

    run = extractor.run(pages(spark, [("a", 1, f"{LONG} {LONG}")]), load, Options(passes=1, votes=1, sentences=False), lambda u: u.contains("Emotet"))
    assert run.chunks.collect() == [] and run.metrics.first().num_sentences_used == 1
    assert extractor.run(pages(spark, []), load, Options(passes=1, votes=1)).metrics.collect() == []
    with pytest.raises(ValueError):
        extractor.run(pages(spark, []), load, Options(passes=1, votes=2))


def test_one_stage_by_priority():
    assert extractor.chosen(["CHUNK_SINGLE", "SENTENCE_SINGLE"], False) == ["SENTENCE_SINGLE"] and extractor.chosen([], False) == []
    assert extractor.chosen(["CHUNK_SINGLE", "SENTENCE_SINGLE"], True) == ["CHUNK_SINGLE", "SENTENCE_SINGLE"]
    with pytest.raises(ValueError):
        extractor.chosen(["x"], True)


def test_page_texts(spark):
    rows = [("a", 1, 2, "body", " two "), ("a", 1, 1, None, "one"), ("a", 1, 3, "furniture", "no"), ("a", None, 4, "body", "no"), ("a", 2, 1, "body", "x")]
    got = {r.page: r.text for r in extractor.page_texts(spark.createDataFrame(rows, "doc string, page int, place int, layer string, text string")).collect()}
    assert got == {1: " one two", 2: " x"}


def test_samples_and_ids(spark):
    kinds = "doc string, actor string, seq int, context string, techniques array<string>, tool string"
    rows = [("a", "APT", 1, "One.", ["T1", "T2"], "Tool"), ("a", "APT", 2, "Two.", ["T1"], None), ("b", "APT", 1, None, ["T9"], "")]
    got = {r.doc: r for r in extractor.annotated_samples(spark.createDataFrame(rows, kinds)).collect()}
    assert got["a"].text == "One. Two." and [tuple(g) for g in got["a"].gold] == [("tool", "executes", "t1"), ("tool", "executes", "t2")]
    assert [tuple(g) for g in got["b"].gold] == [("apt", "uses", "t9")]
    ann = spark.createDataFrame([("a", " t1 ", None, ["TA1", " "], None), ("a", "T1", "T1.001", None, ["S1"])], "doc string, technique string, sub_technique string, tactics array<string>, tools array<string>")
    assert {(r.kind, r.id) for r in extractor.annotation_ids(ann).collect()} == {("technique", "T1"), ("technique", "T1.001"), ("tactic", "TA1"), ("software", "S1")}
    assert spark.range(1).select(extractor.ids_in_text(F.lit("see t1059.001, TA0001 and S0002, T1059.001; XT1000")).alias("x")).first().x == ["S0002", "T1059.001", "TA0001"]
