"""Quality rules with adaptive thresholds (native: DataFrame functions only).

1. One narrow pass computes integer rule statistics per document (no text is shuffled).
2. Every rule, and every size that it is a share of, gets a mergeable quantile sketch per (language, source): counts in buckets whose
   width grows with the value (exact below 64, then 32 buckets a doubling), so a rank error is zero and a value error at most 1/32.
   Sketches are sums of counts: map-side combined, mergeable in any order, the same on every run.
3. A group's limit is ``median + SPREADS * max(median - lower quartile, error of the rule at the group's median size)``: the
   lower half sets the spread, so junk in up to half of a source does not move it, and where that half has no spread (most documents hold no
   symbols at all) the size of its documents does: the error of a share falls with the square root of the size, so limits tighten with
   longer documents.
4. A source's limit is drawn towards its language's, and that towards everybody's, with the weight of ``PRIOR`` documents, so no number of
   documents switches from one to the other.
5. Thresholds are joined back; one rule above its threshold rejects the document.

Defined results: null text is empty (0 words, rejected by the base rule); null language or source is a group of
its own; repeated rows are judged each; a value equal to its threshold passes; very long texts are counted whole; an empty table gives an
empty result; other columns are ignored by ``rule_stats`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import SPACE, checked_broadcast, let, materialise, text_of, words_of

#: Rules, in thousandths of a size: the count, the size, and the error at size one.
RULES = {"symbols": ("n_symbols", "n_words", 700), "capitals": ("n_capitals", "word_chars", 1000), "dup_lines": ("n_dup_lines", "n_lines", 300), "repeats": ("n_repeat_words", "n_words", 1600)}
SIZES = ("n_words", "word_chars", "n_lines")
SPREADS, PRIOR = 4, 200


def _repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more."""
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            same = lambda e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
            marked = F.transform(s, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["p"]))
            return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

        positions = let(order, twice)
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(positions, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def rule_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and the statistics of each whole ``text``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_capitals (A-Z), n_distinct (words), base_failed. What a caller doesn't select isn't computed."""
    text = text_of()
    n = lambda c: F.length(c).cast("long")
    found = docs.select(
        *keep,
        words_of(text).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        n(F.regexp_replace(text, SPACE, "")).alias("word_chars"),
        n(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        n(F.regexp_replace(text, r"[^A-Z]+", "")).alias("n_capitals"),
    ).select(
        *keep, "word_chars", "n_symbols", "n_capitals",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    )
    return found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _per_mille(part: str, whole: str) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN (1000 * {part}) div {whole} ELSE 0L END")


def rule_values() -> list[Column]:
    """The value of each rule, as a struct (rule, value), from the columns of rule_stats."""
    return [F.struct(F.lit(rule).alias("rule"), _per_mille(part, whole).alias("value")) for rule, (part, whole, _) in RULES.items()]


def bucket(value: Column) -> Column:
    """Lower edge of a value's sketch bucket: its six highest bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return value - F.pmod(value, step)


def sketches(stats: DataFrame) -> DataFrame:
    """Sketch rows (lang, source, rule, bucket, n) of rules and sizes over the documents that pass the base rule."""
    sizes = [F.struct(F.lit(size).alias("rule"), F.col(size).alias("value")) for size in SIZES]
    rows = stats.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*rule_values(), *sizes)).alias("r"))
    return rows.groupBy("lang", "source", F.col("r.rule").alias("rule"), bucket(F.col("r.value")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def cutoffs(sketch: DataFrame, by: list[str], name: str) -> DataFrame:
    """A row per group: its document count and the map of rules to limits."""
    group = Window.partitionBy(*by, "rule")
    ranked = sketch.select(*by, "rule", "bucket", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = lambda per: F.min(F.when(F.col("upto") * 100 >= F.col("total") * per, F.col("bucket")))
    found = ranked.groupBy(*by, "rule").agg(F.max("total").alias("total"), at(25).alias("q25"), at(50).alias("q50"))
    grouped = found.groupBy(*by).agg(F.max("total").alias(f"{name}_n"), F.map_from_entries(F.collect_list(F.struct("rule", F.struct("q25", "q50")))).alias("q"))
    entries = []
    for rule, (_, size, error) in RULES.items():
        own, step = F.col("q")[rule], F.floor(error / F.sqrt(F.greatest(F.col("q")[size]["q50"], F.lit(1)).cast("double")))
        entries += [F.lit(rule), own["q50"] + SPREADS * F.greatest(own["q50"] - own["q25"], step)]
    return grouped.select(*by, f"{name}_n", F.create_map(*entries).alias(f"{name}_limits"))


def drawn(own: Column, n: Column, towards: Column, prior: int) -> Column:
    """Limits of a group drawn towards those above it, which have the weight of ``prior`` documents; whole numbers."""
    return F.transform_values(own, lambda rule, x: F.floor((n * x + prior * towards[rule]) / (n + prior)))


def thresholds(stats: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, limits map<rule, limit>) from the sketches of the source, its language and everything."""
    sketch = sketches(stats)
    own = cutoffs(sketch, ["lang", "source"], "own")
    lang = cutoffs(merge(sketch, ["lang"]), ["lang"], "lang").withColumnRenamed("lang", "_lang")
    every = cutoffs(merge(sketch.withColumn("all", F.lit(0)), ["all"]), ["all"], "all").drop("all")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    above = joined.withColumn("above", drawn(F.col("lang_limits"), F.col("lang_n"), F.col("all_limits"), prior))
    return above.select("lang", "source", drawn(F.col("own_limits"), F.col("own_n"), F.col("above"), prior).alias("limits"))


def judge(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """stats with ``kept`` and the rules that rejected a row."""
    t = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "limits")
    over = F.filter(F.array(*rule_values()), lambda r: F.coalesce(r["value"] > F.col("limits")[r["rule"]], F.lit(False)))
    return (
        stats.join(t, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
        .withColumn("failed_rules", F.transform(over, lambda r: r["rule"])).drop("limits")
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def quality(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """A row per document row: doc_id, lang, source, statistics, failed_rules and kept."""
    stats = materialise(rule_stats(docs, ["doc_id", "lang", "source"]).drop("n_distinct"), "quality-stats")
    return judge(stats, checked_broadcast(materialise(thresholds(stats, prior), "quality-limits")))


def filter_documents(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The documents that pass, with all their columns. The statistics are written beside the rows once, since counting again
    costs far more than reading; texts are not shuffled unless there are more sources than a broadcast may hold."""
    rows = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    stats = materialise(rule_stats(rows, ["_row"]).drop("n_distinct"), "quality-rows").withColumns({"lang": F.col("_row.lang"), "source": F.col("_row.source")})
    limits = materialise(thresholds(stats.drop("_row"), prior), "quality-limits")
    return judge(stats, checked_broadcast(limits)).where("kept").select("_row.*")
