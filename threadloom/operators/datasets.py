"""Training and evaluation sets: contexts, labelled candidates, pairs with sampled negatives, response scoring, replay, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators.running import running


def flatten_contexts(records: DataFrame, report: str, contexts: str) -> DataFrame:
    """A row per context, with the id report:NNNN, and the query text of the record: its first context that isn't blank."""
    rows = records.withColumn("query", X.first_nonempty(F.col(contexts)))
    out = rows.select("*", F.posexplode(contexts).alias("_k", "context")).where("trim(context) <> ''")
    return out.withColumns({"row_id": F.format_string("%s:%04d", F.col(report), F.col("_k")), "query_id": X.query_id(F.col(report), F.col("query"))}).drop("_k", contexts)


def context_map(mentions: DataFrame) -> DataFrame:
    """mentions(name, context) -> the set of contexts under the lower-cased name and under its letters and digits only."""
    keys = F.array_distinct(F.array(X.normalize_name(F.col("name")), X.squashed_key(F.col("name"))))
    return mentions.select(F.explode(keys).alias("key"), "context").where("key <> ''").groupBy("key").agg(F.array_sort(F.collect_set("context")).alias("contexts"))


def labelled_candidates(scored: DataFrame, gold: DataFrame, contexts: DataFrame, least: float, roll_up: bool = False, only_with_gold: bool = False) -> DataFrame:
    """scored(source, name, candidate, cosine) above a cosine, with the source's contexts by either key and label 1 where the candidate
    (or, rolled up, its parent) is gold. Sources without a gold candidate may be left out."""
    rows = scored.where(F.col("cosine") > least)
    one = contexts.select(F.col("key").alias("k1"), F.col("contexts").alias("c1"))
    two = contexts.select(F.col("key").alias("k2"), F.col("contexts").alias("c2"))
    none = F.array().cast("array<string>")
    rows = rows.join(one, X.normalize_name(F.col("name")) == F.col("k1"), "left").join(two, X.squashed_key(F.col("name")) == F.col("k2"), "left")
    rows = rows.withColumn("contexts", F.array_sort(F.array_union(F.coalesce("c1", none), F.coalesce("c2", none)))).drop("k1", "c1", "k2", "c2")
    marks = gold.select(F.col("id").alias("g")).distinct()
    rows = rows.join(marks.withColumn("own", F.lit(True)), F.col("candidate") == F.col("g"), "left").drop("g")
    label = F.coalesce("own", F.lit(False))
    if roll_up:
        rows = rows.join(marks.withColumn("up", F.lit(True)), F.substring_index("candidate", ".", 1) == F.col("g"), "left").drop("g")
        label = label | F.coalesce("up", F.lit(False))
    rows = rows.withColumn("label", label.cast("int")).drop("own", "up")
    return rows.withColumn("_any", F.max("label").over(Window.partitionBy("source"))).where("_any = 1").drop("_any") if only_with_gold else rows


def pairs_with_negatives(queries: DataFrame, vocabulary: DataFrame, n: int, seed: int) -> DataFrame:
    """queries(query, gold array) -> each gold id as a positive and, for it, the n ids of least draw that are no gold id of the query.

    Draws order a ring of the vocabulary: ids sit at hash places, a positive starts at a place of its own and takes the ids that follow. A
    ring needs a join of n + size(gold) places per positive instead of every id against every query.
    """
    ring = running(vocabulary.select("id").distinct().withColumn("draw", X.hash_draw(F.lit(seed), F.col("id"))), "draw", [F.asc("draw"), F.col("id")], {"k": ("sum", F.lit(1))}).select("id", "k")
    size = ring.agg(F.count("*").alias("m"))
    positives = queries.select("query", "gold", F.explode(F.array_distinct("gold")).alias("positive")).join(F.broadcast(size))  # one row
    start = F.floor(X.hash_draw(F.lit(seed), F.col("query"), F.col("positive")) * F.col("m"))
    span = F.least(F.lit(n) + F.size("gold"), F.col("m")) - 1
    at = positives.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), span.cast("long")))).withColumn("k", (start + F.col("step")) % F.col("m") + 1)
    drawn = at.join(ring, "k").where(~F.array_contains("gold", F.col("id")))
    rank = F.row_number().over(Window.partitionBy("query", "positive").orderBy("step"))
    negatives = drawn.withColumn("r", rank).where(F.col("r") <= n).select("query", "positive", F.col("id").alias("candidate"), F.lit(0).alias("label"))
    return positives.select("query", "positive", F.col("positive").alias("candidate"), F.lit(1).alias("label")).union(negatives)


def parse_labels(x: Column) -> Column:
    """Labels from a list's printed form or from a comma-separated text."""
    listed = F.from_json(F.translate(x, "'", '"'), "array<string>")
    split = F.filter(F.transform(F.split(x, ","), lambda v: F.trim(v)), lambda v: v != "")
    return F.when(F.trim(x).startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.coalesce(split, F.array().cast("array<string>")))


def score_responses(responses: DataFrame) -> DataFrame:
    """responses(query, gold array, response, latency, error) -> strict and lenient hits of the first id found in a reply; failed calls are counted apart."""
    found = X.attack_id(F.upper("response"))
    rows = responses.withColumn("found", found)
    strict = F.coalesce(F.array_contains("gold", F.col("found")), F.lit(False))
    lenient = strict | F.coalesce(F.exists("gold", lambda g: X.is_parent_child(F.col("found"), g)), F.lit(False))
    fine = F.col("error").isNull()
    return rows.agg(
        F.count("*").alias("n"), F.sum((~fine).cast("long")).alias("errors"), F.sum((fine & F.col("found").isNull()).cast("long")).alias("no_id"),
        F.avg(F.when(fine, strict.cast("double"))).alias("strict"), F.avg(F.when(fine, lenient.cast("double"))).alias("lenient"), F.avg(F.when(fine, F.col("latency"))).alias("latency"),
    )


def replay_sample(queries: DataFrame, share: float, n_new: int, seed: int) -> DataFrame:
    """queries(query, n_pairs): whole queries in the order of a draw, until the pairs before them reach share / (1 - share) of the new ones."""
    target = n_new * share / (1 - share)
    drawn = queries.withColumn("draw", X.hash_draw(F.lit(seed), F.col("query")))
    return running(drawn, "draw", [F.asc("draw"), F.col("query")], {"upto": ("sum", F.col("n_pairs"))}).where(F.col("upto") - F.col("n_pairs") < target).select("query", "n_pairs")


def single_label(gold: Column) -> Column:
    """The last technique of a gold array, else its first id."""
    techniques = F.filter(gold, lambda g: g.startswith("T"))
    return F.coalesce(F.when(F.size(techniques) > 0, F.element_at(techniques, -1)), F.get(gold, 0))


def compare_runs(new: DataFrame, old: DataFrame, edges: list[float]) -> DataFrame:
    """(query, best, score) of two runs -> rows matched, in one only, changed, and the histogram of score drift over the edges."""
    o = old.select(F.col("query").alias("oq"), F.col("best").alias("ob"), F.col("score").alias("os"))
    j = new.join(o, new["query"] == F.col("oq"), "full_outer")
    drift = F.abs(F.col("score") - F.col("os"))
    state = F.when(F.col("oq").isNull(), "new_only").when(F.col("query").isNull(), "old_only").when(F.col("best") != F.col("ob"), "changed").otherwise("same")
    bucket = F.when(drift.isNotNull(), F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: drift >= e)))
    return j.groupBy(state.alias("state"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def answer(tables: DataFrame, by: list[Column], values: list[Column]) -> DataFrame:
    """Means of metrics over everything and over each key by itself, in one pass of grouping sets. Keys and values are columns or expressions."""
    names = [f"key_{k}" for k in range(len(by))]
    rows = tables.select(*[c.alias(n) for c, n in zip(by, names, strict=True)], *[v.alias(f"value_{k}") for k, v in enumerate(values)])
    means = [F.avg(f"value_{k}").alias(f"value_{k}") for k in range(len(values))]
    sets = [[F.col(n)] for n in names]
    return rows.groupingSets([[], *sets], *[F.col(n) for n in names]).agg(F.count("*").alias("n"), *means)
