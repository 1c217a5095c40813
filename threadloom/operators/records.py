"""Explanation records: what was predicted for a query, why, how surely, and what stood next to it; statistics over many of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import entities as E
from threadloom.functions import text as X
from threadloom.operators.explain import impact, tier
from threadloom.operators.ranking import ranked

# ---- fixed values: how many alternatives and relatives a record shows, characters of a preview ----
ALTERNATIVES, RELATIVES, PREVIEW = 5, 5, 100
# ---- end of fixed values ----


def hierarchy(ids: DataFrame) -> DataFrame:
    """ids(id) -> a row per distinct attack id in them: its type, the parent in its name, children and siblings that are there too, sorted."""
    own = ids.select(F.nullif(F.regexp_extract("id", r"^(TA\d{4}|T\d{4}(?:\.\d{3})?|S\d{4})", 1), F.lit("")).alias("id")).where("id is not null").distinct()
    kind = F.when(F.col("id").startswith("TA"), "tactic").when(F.col("id").startswith("S"), "software").when(F.col("id").contains("."), "sub-technique").otherwise("technique")
    rows = own.withColumns({"type": kind, "parent": F.when(kind == "sub-technique", F.substring_index("id", ".", 1))})
    children = rows.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    held = children.join(own, "id", "left_semi")
    none = F.array().cast("array<string>")
    family = held.select(F.col("id").alias("parent"), F.col("children").alias("family"))
    return rows.join(held, "id", "left").join(family, "parent", "left").select(
        "id", "type", "parent", F.coalesce("children", none).alias("children"), F.coalesce(F.array_remove("family", F.col("id")), none).alias("siblings")
    )


def explain(pairs: DataFrame, tokens: DataFrame, stopwords: list[str], relatives: DataFrame | None = None) -> DataFrame:
    """pairs(query, text, item, candidate, score, label) and tokens(query, position, token, importance) of the best item -> a record per query.

    Prediction, first gold item by rank, margin to the second (0 without one) and its tier, tokens with their share of the largest importance
    and its class, words in common with the best candidate, what hierarchy() knows of the predicted id, and the best five."""
    r = ranked(pairs)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    shown = F.when(F.col("rank") <= ALTERNATIVES, F.struct("rank", F.col("item").alias("id"), F.round("score", 6).alias("score"), (F.col("label") == 1).alias("is_gold"), F.substring("candidate", 1, PREVIEW).alias("text_preview")))
    per = r.groupBy("query").agg(
        F.first("text").alias("text"), at(1, "item").alias("predicted_id"), at(1, "score").alias("top"), at(2, "score").alias("second"), (at(1, "label") == 1).alias("correct"), at(1, "candidate").alias("candidate"),
        F.min(F.when(F.col("label") == 1, F.struct("rank", "item")))["item"].alias("gold_id"), F.array_sort(F.collect_list(shown)).alias("alternatives"),
    )
    margin = F.coalesce(F.col("top") - F.col("second"), F.lit(0.0))
    largest = F.max(F.abs("importance")).over(Window.partitionBy("query"))
    scale = F.when(F.coalesce(largest, F.lit(0.0)) == 0, 1.0).otherwise(largest)
    marked = tokens.withColumn("normalized", F.col("importance") / scale)
    entry = F.struct("position", "token", F.round("importance", 6).alias("raw_importance"), F.round("normalized", 4).alias("normalized"), impact(F.col("normalized")).alias("impact"))
    listed = marked.groupBy("query").agg(F.array_sort(F.collect_list(entry)).alias("token_importance"))
    attack = lambda c: F.nullif(F.regexp_extract(c, r"^(TA\d{4}|T\d{4}(?:\.\d{3})?|S\d{4})", 1), F.lit(""))
    out = per.join(listed, "query", "left").select(
        "query", "text", F.struct(F.col("predicted_id").alias("id"), attack("predicted_id").alias("attack_id"), F.round("top", 6).alias("score"), "correct").alias("prediction"),
        F.struct(F.coalesce("gold_id", F.lit("?")).alias("id"), attack("gold_id").alias("attack_id")).alias("gold"), tier(margin).alias("confidence"), F.round(margin, 6).alias("margin"),
        F.coalesce("token_importance", F.array()).alias("token_importance"), E.shared_words(F.col("text"), F.col("candidate"), stopwords).alias("bm25_overlap"), "alternatives",
    )
    if relatives is None:
        return out
    few = lambda c: F.slice(F.col(c), 1, RELATIVES).alias(c)
    known = relatives.select(F.col("id").alias("_id"), F.struct("type", "parent", few("children"), few("siblings")).alias("hierarchy"))
    return out.join(known, F.col("prediction.attack_id") == F.col("_id"), "left").drop("_id")


def category(token: Column, known: Column, is_actor: Column, stopwords: list[str]) -> Column:
    """ACTOR_NAME before STOPWORD before ATTACK_VOCAB before OTHER, of a token's key."""
    key = E.token_key(token)
    return F.when(key == "", "OTHER").when(is_actor, "ACTOR_NAME").when(key.isin(stopwords), "STOPWORD").when(known, "ATTACK_VOCAB").otherwise("OTHER")


def categorised(tokens: DataFrame, vocabulary: DataFrame, corpus: DataFrame, actors: DataFrame, stopwords: list[str]) -> DataFrame:
    """tokens(.., token) with category, in_vocabulary and in_corpus; each list is a table of ``word``."""
    rows = tokens.withColumn("_key", E.token_key(F.col("token")))
    for name, table in (("in_vocabulary", vocabulary), ("in_corpus", corpus), ("_actor", actors)):
        rows = rows.join(table.select(F.col("word").alias("_key")).where("_key <> ''").distinct().withColumn(name, F.lit(True)), "_key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows.withColumn("category", category(F.col("token"), F.col("in_vocabulary"), F.col("_actor"), stopwords)).drop("_key", "_actor")


def query_metrics(tokens: DataFrame, gold_texts: DataFrame, stopwords: list[str]) -> DataFrame:
    """tokens(query, gold_id, position, token, importance, share, impact, category) and gold_texts(gold_id, text) -> per query its most important
    token, the entropy of importances (of their absolute shares, in bits), its HIGH words that aren't stop words and how many of them the gold
    text holds (rate null without any)."""
    total = F.sum(F.abs("importance")).over(Window.partitionBy("query"))
    p = F.when(total > 0, F.abs("importance") / total)
    rows = tokens.withColumn("h", F.when(p > 0, -p * F.log2(p)).otherwise(0.0)).withColumn("key", E.token_key(F.col("token")))
    high = (F.col("impact") == "HIGH") & (F.col("key") != "") & ~F.col("key").isin(stopwords)
    per = rows.groupBy("query").agg(
        F.first("gold_id").alias("gold_id"), F.max(F.struct("share", (-F.col("position")).alias("n"), "token", "category")).alias("t"), F.sum("h").alias("entropy"), F.collect_list(F.when(high, F.col("key"))).alias("high"),
    )
    own = gold_texts.select("gold_id", X.content_tokens(F.col("text"), stopwords).alias("words")).dropDuplicates(["gold_id"])
    joined = per.join(own, "gold_id", "left")
    n, hits = F.size("high"), F.size(F.filter("high", lambda w: F.coalesce(F.array_contains("words", w), F.lit(False))))
    return joined.select(
        "query", "gold_id", F.col("t.token").alias("top_token"), F.col("t.category").alias("top_category"), F.col("t.share").alias("top_share"), "entropy", n.alias("n_high"), hits.alias("overlap"),
        F.when(n > 0, hits / n).alias("overlap_rate"), F.col("words").isNotNull().alias("has_gold_text"),
    )


def top_categories(metrics: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Shares of the categories of queries' most important tokens, among right and wrong queries of verdicts(query, correct)."""
    rows = metrics.join(verdicts, "query").groupBy("correct", "top_category").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("correct")))


def importance_by(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, population deviation and mean share of importances per group."""
    return tokens.groupBy(*by).agg(F.count("*").alias("n"), F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"), F.avg("share").alias("mean_share"))


def top_words(tokens: DataFrame, k: int = 20) -> DataFrame:
    """The words of highest mean importance, lower-cased; ties by word."""
    return tokens.groupBy(F.lower("token").alias("word")).agg(F.avg("importance").alias("mean"), F.count("*").alias("n")).orderBy(F.desc("mean"), "word").limit(k)


def accuracy_by_tier(records: DataFrame) -> DataFrame:
    """(confidence, n, accuracy) of explanation records."""
    return records.groupBy("confidence").agg(F.count("*").alias("n"), F.round(F.avg(F.col("prediction.correct").cast("double")), 4).alias("accuracy"))


def intervention_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """results(by, flip, margin_delta, score_delta, rank_change), without baselines -> flips with Wilson's interval, means, and the sample deviation of margin changes.
    Nulls and not-a-numbers are left out of means."""
    from threadloom.functions.stats import wilson

    fine = lambda c: F.when(~F.isnan(c), F.col(c))
    g = results.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("flip").cast("long")).alias("flips"), F.avg(fine("margin_delta")).alias("mean_margin_delta"), F.stddev_samp(fine("margin_delta")).alias("std_margin_delta"),
        F.avg(fine("score_delta")).alias("mean_score_delta"), F.avg(F.coalesce(F.col("rank_change"), F.lit(0))).alias("mean_rank_change"),
    )
    low, high = wilson(F.col("flips"), F.col("n"))
    return g.select(*by, "n", (F.col("flips") / F.col("n")).alias("flip_rate"), low.alias("low"), high.alias("high"), "mean_margin_delta", "std_margin_delta", "mean_score_delta", "mean_rank_change")


def per_query(results: DataFrame, metric: str) -> DataFrame:
    """results(query, intervention, metric) -> the metric's mean per query and intervention, without nulls and not-a-numbers: repeats of a query are no new sample."""
    v = F.col(metric).cast("double")
    fine = results.withColumn("_v", v).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
    return fine.groupBy("intervention", "query").agg(F.avg("_v").alias(metric))


def paired_differences(results: DataFrame, metric: str, treated: str, placebo: str) -> DataFrame:
    """(query, d): the metric's mean under one intervention less that under another, for queries that have both."""
    m = per_query(results, metric)
    of = lambda name, tag: m.where(F.col("intervention") == name).select("query", F.col(metric).alias(tag))
    return of(treated, "a").join(of(placebo, "b"), "query").select("query", (F.col("a") - F.col("b")).alias("d"))
