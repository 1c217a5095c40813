"""Prompts, injected scorers, replies, pages, gold triples and set scores."""

from pyspark.sql import functions as F

from threadloom.operators import extraction as E


def test_passes_cycle_through_templates(spark):
    u = spark.createDataFrame([("t {x}",)], "text string")
    rows = E.passes(u, ["A: {text}", "B {text}."], 3).orderBy("pass").collect()
    assert [r.prompt for r in rows] == ["A: t {x}", "B t {x}.", "A: t {x}"]


def test_scorer_loads_once_and_survives_failures(spark):
    def load():
        def model(a, b):
            if "bad" in a:
                raise ValueError
            return [float(len(x) + len(y)) for x, y in zip(a, b)]

        return model

    rows = spark.createDataFrame([("a", "bb"), ("bad", "x"), ("ccc", "d")], "q string, c string").coalesce(1)
    out = {r.q: r.score for r in E.scored(rows, ["q", "c"], "double", load, batch=1).collect()}
    assert out["a"] == 3 and out["ccc"] == 4 and (out["bad"] is None or out["bad"] != out["bad"])
    assert E.scored(rows.limit(0), ["q", "c"], "double", load).collect() == []


def test_replies(spark):
    for reply, n in (("[]", 0), (None, 0), ("nothing", 0), ('{"subject": {"name": "a"}, "predicate": "uses", "object": {"name": "b"}}', 1), ('{"triples": [{"subject": {"name": "a"}, "relation": "r", "object": {"name": "b"}}, {"subject": null}]}', 1)):
        assert len(spark.range(1).select(E.parsed_triples(F.lit(reply).cast("string")).alias("t")).first().t) == n


def test_spill_over(spark):
    p = spark.createDataFrame([("d", 1, ["a", "b", "c"]), ("d", 2, ["e"]), ("d", 3, ["f"])], "doc string, page int, sentences array<string>")
    assert [r.units for r in E.spilled_pages(p, 2).orderBy("page").collect()] == [["a", "b", "c"], ["b", "c", "e"], ["e", "f"]]


def test_gold_and_scores(spark):
    a = spark.createDataFrame([("d", "apt", ["t1", "t2"], ["T1"]), ("e", "apt", [], ["T1", "T2"])], "doc string, actor string, tools array<string>, techniques array<string>")
    gold = E.gold_triples(a)
    assert {tuple(r) for r in gold.collect()} == {("d", "t1", "executes", "T1"), ("d", "t2", "executes", "T1"), ("e", "apt", "uses", "T1"), ("e", "apt", "uses", "T2")}
    s = E.set_scores(gold.where("subject <> 't2'"), gold, "doc", ["subject", "predicate", "object"]).first()
    assert (s.samples, s.macro_precision, s.macro_recall, s.micro_recall) == (2, 1, 0.75, 0.75)


def test_greedy_matching_uses_each_gold_once(spark):
    p = spark.createDataFrame([("s", 0, "alpha uses beta"), ("s", 1, "alpha uses beta too"), ("s", 2, "gamma delta")], "id string, k int, text string")
    g = spark.createDataFrame([("s", 0, "alpha uses beta"), ("s", 1, "epsilon zeta"), ("t", 0, "lonely")], "id string, k int, text string")
    assert {r.id: (r.matched, r.predicted, r.gold) for r in E.greedy_matches(p, g, "id", 0.3).collect()} == {"s": (1, 3, 2), "t": (0, 0, 1)}
