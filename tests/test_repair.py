import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import entities as E
from threadloom.operators import assembly, counterfactual, repair
from threadloom.operators.triples import viterbi

TRIPLE = "id long, context string, s_name string, s_type string, predicate string, o_name string, o_type string"


def column(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def rows_of(spark, rows):
    return spark.createDataFrame(rows, TRIPLE)


def test_cascade_takes_each_way_out(spark, tmp_path):
    ctx = "Emotet was seen by a bank. Later the bank saw Emotet again! Other things."
    rows = [
        (1, None, " Emotet ", "Malware", "Drops", "x.dll", "file"),  # cleanup is enough
        (2, ctx, "Emotet", "other", "drops", "Emotet", "malware"),  # its sentence says malware
        (3, ctx, "Emotet", "malware", "befriends", "bank", "organization"),  # no known predicate: no call
        (4, None, "A", "widget", "uses", "B", "tool"),  # a proposal mends it
        (5, None, "C", "widget", "uses", "D", "tool"),  # none does
        (6, None, "", "malware", "drops", "y", "file"),  # blank names become UNKNOWN
        (7, None, None, "malware", "drops", "y", "file"),
    ]
    asked = []

    def load():
        good = json.dumps([{"subject": {"name": "A", "type": "widget"}, "predicate": "uses", "object": {"name": "B", "type": "tool"}}, {"subject": {"name": "A", "type": "Threat Actor"}, "predicate": "uses", "object": {"name": "B", "type": "tool"}}])
        return lambda prompts: [good if '"A"' in p else "sorry" for p in prompts]

    out = {r.id: r for r in repair.cascade(rows_of(spark, rows), load, folder=str(tmp_path)).collect() if r.id is not None}
    assert {k: r.repair for k, r in out.items()} == {1: "deterministic", 2: "markov_smooth", 3: "bad", 4: "model", 5: "bad", 6: "deterministic", 7: "bad"}
    assert (out[1].s_name, out[1].s_type, out[1].predicate) == ("Emotet", "malware", "drops") and out[2].s_type == "malware" and out[4].s_type == "threat-actor" and out[6].s_name == "UNKNOWN"
    assert out[3].reasons == ["predicate_invalid"] and out[7].reasons == ["subject.name_bad"] and not asked
    plain = {r.id: r.repair for r in repair.cascade(rows_of(spark, rows), folder=str(tmp_path)).collect() if r.id is not None}
    assert plain[4] == "bad" and repair.cascade(rows_of(spark, rows).limit(0), folder=str(tmp_path)).collect() == []


def test_propagation_adds_only_new_valid_triples(spark, tmp_path):
    parts = "id long, s_name string, s_type string, predicate string, o_name string, o_type string, repair string"
    rows = [(1, "Emotet", "malware", "drops", "X", "file", "deterministic"), (2, "emotet", "malware", "drops", "Y", "file", "bad"), (3, "Emotets", "malware", "drops", "X", "file", "bad"), (4, "Q", "sector", "uses", "Z", "tool", "bad")]
    got = [(r.s_name, r.o_name) for r in repair.propagated(spark.createDataFrame(rows, parts), str(tmp_path)).collect()]
    assert got == [("Emotet", "Y")]  # the third is the first under another spelling, the fourth isn't valid


def test_append_and_reasons(spark):
    parts = "s_name string, s_type string, predicate string, o_name string, o_type string"
    old = spark.createDataFrame([("a", "tool", "uses", "b", None)], parts)
    new = spark.createDataFrame([("a", "tool", "uses", "b", None), ("a", "tool", "uses", "c", "x"), ("a", "tool", "uses", "c", "x")], parts)
    assert sorted(r.o_name for r in repair.append_new(old, new).collect()) == ["b", "c"]
    bad = spark.createDataFrame([("bad", ["x", "y"]), ("bad", ["y"]), ("model", ["z"])], "repair string, reasons array<string>")
    assert [(r.reason, r.n) for r in repair.reason_counts(bad).collect()] == [("y", 2), ("x", 1)]


@pytest.mark.parametrize("given, want", [("Threat  Actor", "threat-actor"), ("ATTACK-PATTERN", "attack-pattern"), ("E-mail!", "email-addr"), ("ipv4", "ipv4-addr"), ("Observed Data", "observed-data"), ("widget", "widget")])
def test_loose_types(spark, given, want):
    assert column(spark, repair.loose_type(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [("communicatesWith", "communicates_with"), ("based on", "based_on"), ("uses", "uses"), ("writesTo", "writes_to"), ("Uses", "uses"), ("befriends", "befriends")])
def test_loose_predicates(spark, given, want):
    assert column(spark, repair.loose_predicate(F.lit(given))) == want


@pytest.mark.parametrize("given, kind, want", [
    ("used T1059.001 here", None, "T1059.001"), ("see cve-2021-44228!", "tool", "CVE-2021-44228"), ("https://Evil.example.com/a/b", None, "evil.example.com"), ("Mimikatz.exe", "tool", "mimikatz"), ("Mimikatz.exe", None, "mimikatz.exe"),
    ("a.zip.exe", "program", "a.zip"), ('"Cobalt  Strike"', None, "cobalt_strike"), ("", None, ""), (None, None, ""),
])
def test_entity_labels(spark, given, kind, want):
    assert column(spark, E.entity_label(F.lit(given).cast("string"), F.lit(kind).cast("string"))) == want


def test_names_in_previews(spark):
    cases = {"T1059.001 — PowerShell: runs": "PowerShell", "T0833 — MANIPULATION OF CONTROL": "Manipulation of Control", "no dash": None, "": None, "T1 — : x": None}
    assert {k: column(spark, E.preview_name(F.lit(k))) for k in cases} == cases


def test_query_text_spends_its_words(spark):
    left, right = "a b c d e f g h", "r s t"

    def brute(base, most):
        budget = max(most - len(base.split()), 0)
        lw = min(8, budget // 2)
        rw = min(3, budget - lw)
        lw = min(8, budget - rw)
        return " ".join(p for p in (" ".join(left.split()[8 - lw :]) if lw else "", base, " ".join(right.split()[:rw]) if rw else "") if p)

    for base in ("x", "x y z"):
        for most in range(0, 16):
            got = column(spark, assembly.query_text(F.lit(base), F.lit(left), F.lit(right), F.array(F.lit("m")), True, False, most))
            assert got == brute(base, most)
    assert column(spark, assembly.query_text(F.lit("x"), F.lit(""), F.lit(""), F.array(F.lit("m"), F.lit("n")), False, True)) == "m; n — x"


def test_grouped_queries(spark):
    kinds = "label_link string, context_left string, mention string, context_right string, document string, sentence_left string, sentence_right string, seq int"
    at = "https://attack.mitre.org/"
    rows = [
        (at + "techniques/T1059/001", "He  used", "[shell](x)", "here.", "d1", "one", "z", 1), (at + "software/S0002", "he used", "Shell", "here.", "d1", "longer", None, 2), (at + "groups/G0001", "he", "x", "y", "d1", "", "", 3),
        (at + "techniques/T9999", "a", "b", "c", "d1", "", "", 4), (at + "techniques/T1000", "old", "one", "", None, "", "", 5), ("https://x.org", "a", "b", "c", "d2", "", "", 6), (None, "a", "b", "c", "d2", "", "", 7),
    ]
    known = spark.createDataFrame([("T1059.001",), ("S0002",), ("T1001",)], "id string")
    revoked = spark.createDataFrame([("T1000", "T1001"), ("T9999", "")], "id string, successor string")
    m = spark.createDataFrame(rows, kinds)
    q = {r.base_norm: r for r in assembly.grouped_queries(m, known, revoked, mention_first=True).collect()}
    assert set(q) == {"he used shell here.", "old one"}
    first = q["he used shell here."]
    assert (first.query_raw, first.category, first.gold_ids, first.n_mentions, first.mentions) == ("Shell; shell — He used shell here.", "mixed", ["S0002", "T1059.001"], 2, ["Shell", "shell"])
    assert (q["old one"].document, q["old one"].gold_ids, q["old one"].gold_ids_raw) == ("unknown", ["T1001"], ["T1000"])
    assert {(r.state, r.n) for r in assembly.crosswalk(m, known, revoked).collect()} == {("kept", 1), ("mapped", 1), ("group", 1), ("unresolvable", 1), ("foreign", 2)}


def test_pools_with_gold(spark):
    q = spark.createDataFrame([("q", "red fox jumps", ["d3", "d9"])], "qid string, query_raw string, gold_ids array<string>")
    corpus = spark.createDataFrame([("d1", "red fox"), ("d2", "fox den"), ("d3", "nothing like it"), ("d4", "jumps")], "id string, text string")
    got = [(r.item, r.rank, r.label) for r in assembly.pools(q, corpus, 2, with_gold=True).orderBy("rank").collect()]
    assert len(got) == 3 and got[2] == ("d3", 3, 1) and {g[2] for g in got[:2]} == {0}


def test_spans(spark):
    cases = [
        ("This would allow FIN6 to escalate", ["fin6"], [(17, 21, "FIN6")]), ("Cozyduke is a malware", ["cozyduke"], [(0, 8, "Cozyduke")]), ("APT29 has been observed", ["apt29"], [(0, 5, "APT29")]),
        ("apt29 and APT29x, apt29", ["apt29"], [(0, 5, "apt29"), (18, 23, "apt29")]), ("the dukes", ["the dukes", "dukes"], [(0, 9, "the dukes")]), ("ab ab", ["ab"], []), ("a.b.c x", ["a.b.c"], [(0, 5, "a.b.c")]), ("x", [], []),
    ]
    for text, tokens, want in cases:
        got = column(spark, counterfactual.spans(F.lit(text), F.array(*[F.lit(t) for t in tokens]).cast("array<string>")))
        assert [tuple(s) for s in got] == want


def test_generic_phrases(spark):
    of = lambda text, start: column(spark, counterfactual.generic_phrases(F.lit(text), F.lit(start)))[0]
    assert of("APT29 did", 0) == "The threat actor" and of("by APT29", 3) == "the threat actor" and of("The Dukes are", 4) == "threat actor" and of("xthe Dukes", 5) == "threat actor"


def test_substitutes_prefer_little_overlap_and_repeat(spark):
    pool = spark.createDataFrame([(f"a{k}", f"NAME{k}", "1word_upper_digit", f"G{k}") for k in range(6)] + [("b", "Bear", "1word_title", "")], "norm string, primary string, bucket string, g_id string")
    techniques = spark.createDataFrame([("G0", "T1001"), ("G1", "T1001"), ("G2", "T1002")], "g_id string, id string")
    q = spark.createDataFrame([(n, "APT29", ["a5"], ["T1001", "TA0001"]) for n in range(40)] + [(99, "CozyDuke", [], [])], "query int, surface string, excluded array<string>, gold array<string>")
    out = counterfactual.substitutes(q, pool, techniques, 3, 7)
    rows = out.collect()
    assert sorted(map(str, rows)) == sorted(map(str, counterfactual.substitutes(q, pool, techniques, 3, 7).collect()))
    drawn = [r for r in rows if r.query < 99]
    assert len(drawn) == 120 and {r.norm for r in drawn} == {"a2", "a3", "a4"} | ({"a0", "a1"} & {r.norm for r in drawn}) and "a5" not in {r.norm for r in drawn}
    assert not {"a0", "a1"} & {r.norm for r in drawn}  # all their techniques are the gold one: weight 0
    mixed = [r for r in rows if r.query == 99]
    assert {r.fallback for r in mixed} == {2} and all(r.recast == r.recast.title() for r in mixed)


def test_viterbi_smooths_labels_of_a_context(spark):
    rnd = random.Random(1)
    text = " ".join(f"Sentence {k} has Emotet." for k in range(6))
    rows = [(k, text, "Emotet", "malware", "drops", "nothing", rnd.choice(("file", "tool"))) for k in range(4)]
    labels = repair.sentence_labels(rows_of(spark, rows)).first().labels
    assert [x["smooth"] for x in labels] == viterbi(["malware"] * 6, [1.0] * 6) == ["malware"] * 6
