import collections
import re

from pyspark.sql import functions as F

from threadloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


CASES = [
    None, "", " \n\t", "a", "a b c", "a b c a b c", "x x x x", "one\none\n\none \n", "é b c\x0bd e\x85f", "## $a | b <c>", " ".join(f"w{k}" for k in range(60)),
    "a b c d " * 30, "z" * 50_000, " ".join(["long"] * 3000 + [f"u{k}" for k in range(5000)]), "a\r\nb\na\r\n" * 40, "a b c d e\n" * 2,
]


def test_statistics_match_brute_force(make):
    rows = Q.quality(make(CASES)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    assert got == {k: brute(t) for k, t in enumerate(CASES)}
    assert not any(r.kept for r in rows if r.base_failed)


def test_thresholds_adapt_to_each_source(spark):
    plain = lambda k: " ".join(f"word{(k * 31 + i * 7) % 997}x{i}" for i in range(80))
    noisy = lambda k: " ".join(f"word{(k * 31 + i * 7) % 997}x{i}" + ("#" if i % 3 == 0 else "") for i in range(80))
    rows = [(k, plain(k), "en", "a", 0) for k in range(60)] + [(100, noisy(1), "en", "a", 0)] + [(200 + k, noisy(k), "en", "b", 0) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in Q.quality(docs, prior=1).collect()}
    assert not kept[100] and all(v for k, v in kept.items() if k != 100)
    # a strong prior: what the language says decides in every source
    assert all(r.kept for r in Q.quality(docs, prior=1_000_000).collect())
    assert sum(r.kept for r in Q.quality(docs.where("source = 'a'"), prior=1000).collect()) == 60


def test_limits_move_smoothly_with_the_size_of_a_source(spark):
    rows = [(k, "en", "big", 0.0) for k in range(400)] + [(1000 + k, "en", "small", 0.0) for k in range(250)]
    limits = []
    for n in (1, 50, 199, 200, 201, 250):
        made = [(s, 100, 500, 40 if s == "small" else 0, 0, 0, 10, 10, False) for k, _, s, _ in rows if s == "big" or k < 1000 + n]
        stats = spark.createDataFrame([("en", *r) for r in made], "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, base_failed boolean")
        limits.append({r.source: r.limits["symbols"] for r in Q.thresholds(stats).collect()}["small"])
    steps = [b - a for a, b in zip(limits, limits[1:])]
    assert limits == sorted(limits) and limits[0] < 0.6 * limits[-1] and abs(steps[2]) <= 2 and abs(steps[3]) <= 2


def test_a_value_equal_to_its_limit_passes(spark):
    stats = spark.createDataFrame([(1, "en", "s", 100, 500, n, 0, 0, 10, 0, False) for n in (20, 21)], "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, base_failed boolean")
    limits = spark.createDataFrame([("en", "s", {r: 200 for r in Q.RULES})], "lang string, source string, limits map<string, long>")
    assert [(r.n_symbols, r.kept) for r in Q.judge(stats, limits).orderBy("n_symbols").collect()] == [(20, True), (21, False)]


def test_nulls_repeats_empty_and_clashing_columns(spark, make):
    text = " ".join(f"word{i}" for i in range(70))
    docs = make([(None, text), (1, text), (1, text), (2, None)], {"n_words": F.lit(3), "kept": F.lit("x"), "limits": F.lit(1), "_l": F.lit(2)})
    docs = docs.withColumns({"lang": F.when(F.col("doc_id") == 1, F.lit(None)).otherwise("en"), "source": F.lit(None).cast("string")})
    assert sorted((str(r.doc_id), r.kept) for r in Q.quality(docs).collect()) == [("1", True), ("1", True), ("2", False), ("None", True)]
    out = Q.filter_documents(docs)
    assert out.columns == docs.columns and sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "1", "None"]
    assert Q.quality(docs.limit(0)).collect() == [] and Q.filter_documents(docs.limit(0)).collect() == []


def test_sketches_merge_in_any_order(spark, make):
    stats = Q.rule_stats(make([" ".join(f"w{(i * k) % 37}" for i in range(60 + k)) for k in range(40)]), ["lang", "source"])
    whole = {tuple(r) for r in Q.merge(Q.sketches(stats), ["lang"]).collect()}
    parts = Q.sketches(stats.where("n_words % 2 = 0")).union(Q.sketches(stats.where("n_words % 2 = 1")))
    assert {tuple(r) for r in Q.merge(parts, ["lang"]).collect()} == whole


def test_plan_has_no_python(make):
    plan = Q.judge(Q.rule_stats(make(["a"]), ["doc_id", "lang", "source"]), Q.thresholds(Q.rule_stats(make(["a"]), ["lang", "source"])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
