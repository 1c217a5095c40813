"""Around experiments: validated records, splits, training pairs, thresholds, comparisons of systems, vocabularies, run summaries, blends.

Flat pair records have query_norm, query_raw, candidate_id, candidate_norm, candidate_text, label, actor and seq, their place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import entities as E
from threadloom.functions import text as X
from threadloom.operators.assembly import POOL_SIZE, flat_queries
from threadloom.operators.retrieval import bm25

# ---- fixed values: prefix of foreign actors, shares of splits, negatives a gold item, sizes of effects ----
EXTERNAL = "external_"
TRAIN, VALIDATION, HELD_OUT, NEGATIVES = 0.8, 0.1, 0.10, 2.5
EFFECTS = (("LARGE", 0.8), ("MEDIUM", 0.5), ("SMALL", 0.2))
# ---- end of fixed values ----


def record_checks(records: DataFrame) -> DataFrame:
    """One row: rows, distinct queries, rows whose candidate text is empty or only the name, their share, positives and negatives. Rows without a query
    count as rows only."""
    fine = (F.col("query_norm") != "") & (F.col("query_raw") != "")
    text = F.coalesce("candidate_text", F.lit(""))
    empty = (text == "") | (F.trim(text) == F.coalesce("candidate_norm", F.lit("")))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    s = records.agg(F.count("*").alias("rows"), F.countDistinct(F.when(fine, F.col("query_norm"))).alias("queries"), n(fine & empty).alias("empty"), n(fine & (F.col("label") == 1)).alias("positives"), n(fine & (F.col("label") != 1)).alias("negatives"))
    return s.withColumn("empty_share", F.when(F.col("rows") > 0, F.col("empty") / F.col("rows")).otherwise(0.0))


def actor_split(queries: DataFrame, seed: int, train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """queries(query, actor, n_gold) with their split, by the rank of a hash draw within the actor: the first int(n * train) train, the next
    int(n * validation) validate, the rest test. Foreign actors and queries without gold items are left out. An actor's queries are ranked
    together; actors are many and small."""
    own = queries.where(~F.col("actor").startswith(EXTERNAL) & (F.col("n_gold") > 0))
    per = Window.partitionBy("actor")
    ranked = own.withColumns({"_k": F.row_number().over(per.orderBy(X.hash_draw(F.lit(seed), F.col("query")), "query")), "_n": F.count("*").over(per)})
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * validation)
    return ranked.withColumn("split", F.when(F.col("_k") <= a, "train").when(F.col("_k") <= a + b, "validation").otherwise("test")).drop("_k", "_n")


def test_items(records: DataFrame) -> DataFrame:
    """Queries of local actors with their gold ids (the id a candidate begins with) in order, and the type of the first."""
    q = flat_queries(records.where(~F.coalesce("actor", F.lit("unknown")).startswith(EXTERNAL)))
    gold = records.where("label = 1").select("query_norm", E.leading_id(F.coalesce(F.nullif("candidate_norm", F.lit("")), "candidate_id")).alias("id"), "seq")
    ids = gold.groupBy("query_norm", "id").agg(F.min("seq").alias("seq")).groupBy("query_norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("gold"))
    first = F.get("gold", 0)
    kind = F.when(first.startswith("TA"), "tactic").when(first.startswith("S"), "software").when(first.contains("."), "sub-technique").otherwise("technique")
    return q.select("query_norm", "query_raw", "actor").join(ids, "query_norm").withColumn("entity_type", kind)


def fitting_texts(records: DataFrame, tests: DataFrame) -> DataFrame:
    """Texts that a vectoriser may see: queries that are not in tests(query_norm) and their candidates' texts, repeats kept, without foreign actors."""
    own = records.where("query_norm <> '' and query_raw <> ''").where(~F.coalesce("actor", F.lit("unknown")).startswith(EXTERNAL)).join(tests.select("query_norm").distinct(), "query_norm", "left_anti")
    heads = own.groupBy("query_norm").agg(F.min_by("query_raw", "seq").alias("text")).select("text")
    return heads.union(own.where("candidate_text <> ''").select("candidate_text"))


def overlapping(splits: DataFrame) -> DataFrame:
    """Documents of splits(split, document) that stand in more than one; none where splits are disjoint."""
    return splits.distinct().groupBy("document").agg(F.array_sort(F.collect_list("split")).alias("splits")).where(F.size("splits") > 1)


def held_out(documents: DataFrame, share: float = HELD_OUT) -> DataFrame:
    """A share of the distinct documents (two at least), at an even stride over their sorted names."""
    d = documents.select("document").distinct()
    n = d.count()
    wanted = max(2, int(n * share))
    stride = max(1, n // wanted)
    from threadloom.operators.running import running

    # the first six bytes as a number, which sorts as the names do
    head = F.conv(F.rpad(F.substring(F.hex(F.encode("document", "UTF-8")), 1, 12), 12, "0"), 16, 10).cast("double")
    placed = running(d.withColumn("_h", head), "_h", [F.col("_h"), F.col("document")], {"_k": ("sum", F.lit(1))})
    return placed.where(((F.col("_k") - 1) % stride == 0) & (F.col("_k") <= stride * wanted)).select("document")


def training_pairs(queries: DataFrame, corpus: DataFrame, seed: int, ratio: float = NEGATIVES, k: int = POOL_SIZE) -> DataFrame:
    """queries(qid, query_raw, gold_ids) and corpus(id, text) -> (qid, id, label): every gold item, and int(golds * ratio) of the k best others by
    BM25, drawn by hash."""
    gold = queries.select("qid", F.explode("gold_ids").alias("id"))
    top = bm25(queries.select(F.col("qid").alias("query"), F.lower("query_raw").alias("text")), corpus.select(F.col("id").alias("doc"), F.lower("text").alias("text")), k)
    others = top.select(F.col("query").alias("qid"), F.col("doc").alias("id")).join(gold, ["qid", "id"], "left_anti")
    wanted = queries.select("qid", F.floor(F.size("gold_ids") * ratio).alias("_n"))
    drawn = others.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(X.hash_draw(F.lit(seed), F.col("qid"), F.col("id")), "id")))
    return gold.withColumn("label", F.lit(1)).union(drawn.join(wanted, "qid").where("_k <= _n").select("qid", "id", F.lit(0)))


def threshold_table(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """pairs(score, label) -> counts, precision, recall and F1 at each threshold, in one pass, and which is ``best``: the first of the highest F1."""
    rows = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    over, pos = F.col("score") >= F.col("threshold"), F.col("label") == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    t = rows.groupBy("threshold").agg(n(over & pos).alias("tp"), n(over & ~pos).alias("fp"), n(~over & pos).alias("fn"), n(~over & ~pos).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    t = t.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})
    best = t.agg(F.min(F.struct((-F.col("f1")).alias("f"), "threshold"))["threshold"].alias("_best"))  # one row
    return t.join(F.broadcast(best)).withColumn("best", F.col("threshold") == F.col("_best")).drop("_best")


def response_results(responses: DataFrame) -> DataFrame:
    """responses(query_raw, gold_ids, llm_response, error, seq) without errors -> (query, predicted, correct): the first id in the answer, right if
    gold; the last answer to a query counts."""
    own = responses.where("error is null or error = ''").groupBy(F.col("query_raw").alias("query")).agg(F.max_by(F.struct("gold_ids", "llm_response"), "seq").alias("r"))
    predicted = F.nullif(F.regexp_extract(F.coalesce("r.llm_response", F.lit("")), r"(TA\d{4}|T\d{4}(?:\.\d{3})?|S\d{4})", 1), F.lit(""))
    return own.select("query", predicted.alias("predicted"), F.coalesce(F.array_contains("r.gold_ids", predicted), F.lit(False)).cast("int").alias("correct"))


def first_candidates(records: DataFrame) -> DataFrame:
    """(query, correct): whether the first candidate of a query that has gold items is one of them."""
    fine = records.where("query_norm <> '' and query_raw <> ''")
    per = fine.groupBy("query_norm").agg(F.min_by("query_raw", "seq").alias("query"), F.min_by("label", "seq").alias("first"), F.max("label").alias("any"))
    return per.where("any = 1").select("query", (F.col("first") == 1).cast("int").alias("correct"))


def compare_systems(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(query, correct) and b(query, correct), matched by their text with white space collapsed: the four counts, McNemar's chi-squared without
    correction, its p and stars (null without discordant pairs)."""
    side = lambda df, tag: df.groupBy(X.collapse(F.col("query")).alias("query")).agg(F.max("correct").alias(tag))
    j = side(a, "a").join(side(b, "b"), "query")
    n = lambda x, y: F.sum(F.when((F.col("a") == x) & (F.col("b") == y), 1).otherwise(0)).cast("long")
    t = j.agg(F.count("*").alias("shared"), n(1, 1).alias("both"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither"))
    apart = F.col("only_a") + F.col("only_b")
    chi2 = F.when(apart > 0, F.pow(F.col("only_a") - F.col("only_b"), 2) / apart)
    p = F.udf(lambda x: None if x is None else math.erfc(math.sqrt(x / 2)), "double")  # one row
    rows = t.withColumn("chi2", chi2).withColumn("p_value", p("chi2"))
    return rows.withColumn("stars", F.when(F.col("p_value") < 0.001, "***").when(F.col("p_value") < 0.01, "**").when(F.col("p_value") < 0.05, "*").when(F.col("p_value").isNotNull(), "ns"))


def bundle_vocabulary(objects: DataFrame, stopwords: list[str], kinds: list[str]) -> DataFrame:
    """objects(type, name, description, revoked, deprecated) -> the distinct content words of live objects of some kinds."""
    live = objects.where(F.col("type").isin(kinds) & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False)))
    return live.select(F.explode(X.content_tokens(F.concat_ws(" ", "name", "description"), stopwords)).alias("word")).distinct()


def lexicon(records: DataFrame, stopwords: list[str], common: list[str], least: int = 5) -> DataFrame:
    """Words of distinct candidate texts (without the id before the dash), and words of three letters or more in ``least`` places or more of distinct
    queries that are no common words."""
    names = records.where("candidate_text <> ''").select("candidate_text").distinct().select(F.explode(X.content_tokens(F.regexp_replace("candidate_text", "^[A-Z0-9.]+ — ", ""), stopwords)).alias("word")).distinct()
    asked = records.where("query_raw <> ''").select("query_raw").distinct().select(F.explode(X.content_tokens(F.col("query_raw"), stopwords)).alias("word"))
    often = asked.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.length("word") > 2) & ~F.col("word").isin(common)).select("word")
    return names.union(often).distinct()


def welch(values: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """values(by, x): Welch's t of two groups, its degrees of freedom, Cohen's d over the mean of both variances, and the size of the effect."""
    s = values.groupBy().agg(*[f(F.when(F.col(by) == g, F.col("x"))).alias(f"{n}_{tag}") for tag, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    va, vb, c = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b"), F.col
    se, pooled = F.sqrt(va + vb), F.sqrt((c("v_a") + c("v_b")) / 2)
    df = F.pow(va + vb, 2) / (va * va / (c("n_a") - 1) + vb * vb / (c("n_b") - 1))
    d = F.when(pooled > 0, (c("m_a") - c("m_b")) / pooled).otherwise(0.0)
    size = F.when(F.abs(d) >= EFFECTS[0][1], EFFECTS[0][0])
    for name, least in EFFECTS[1:]:
        size = size.when(F.abs(d) >= least, name)
    smaller = F.least("n_a", "n_b") - 1
    return s.select("n_a", "n_b", F.when(se > 0, (c("m_a") - c("m_b")) / se).otherwise(0.0).alias("t"), F.when((c("v_a") > 0) & (c("v_b") > 0), df).otherwise(smaller.cast("double")).alias("df"), d.alias("d"), size.otherwise("NEGLIGIBLE").alias("effect"))


def run_summary(metrics: DataFrame) -> DataFrame:
    """metrics(model_used, num_sentences_total, num_sentences_used, num_raw_triples, num_valid_triples, num_suspicious_triples, runtime_seconds), a row
    per report -> totals per model, triples a used sentence, the valid share and valid triples a second."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    names = ("num_sentences_total", "num_sentences_used", "num_raw_triples", "num_valid_triples", "num_suspicious_triples", "runtime_seconds")
    t = metrics.groupBy("model_used").agg(F.count("*").alias("reports"), *[F.sum(n).alias(n) for n in names])
    return t.select(
        "model_used", "reports", *names, share(F.col("num_raw_triples"), F.col("num_sentences_used")).alias("triples_per_sentence"), share(F.col("num_valid_triples"), F.col("num_raw_triples")).alias("valid_share"),
        share(F.col("num_valid_triples"), F.col("runtime_seconds")).alias("valid_per_second"),
    )


def best_pages(pages: DataFrame, k: int = 3) -> DataFrame:
    """pages(report, page, valid, invalid) -> the k pages of a report with most valid triples, ties by page."""
    return pages.withColumn("rank", F.row_number().over(Window.partitionBy("report").orderBy(F.desc("valid"), "page"))).where(F.col("rank") <= k)


def blend(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """Weights (name, place, value) of two models mixed: (1 - share) of the first and share of the second. A weight that one lacks raises at the
    sum, as null is no weight."""
    j = a.select("name", "place", F.col("value").alias("x")).join(b.select("name", "place", F.col("value").alias("y")), ["name", "place"], "full_outer")
    return j.select("name", "place", F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.lit("models differ in their weights")).cast("double")).otherwise((1 - share) * F.col("x") + share * F.col("y")).alias("value"))


def soup(models: list[DataFrame]) -> DataFrame:
    """The mean of several models' weights (name, place, value)."""
    rows = models[0].select("name", "place", "value")
    for m in models[1:]:
        rows = rows.union(m.select("name", "place", "value"))
    return rows.groupBy("name", "place").agg((F.sum("value") / len(models)).alias("value"))


def means_by(rows: DataFrame, key: Column, value: str) -> DataFrame:
    """Sums of a column per value of a grouping function, such as queries per group of reports."""
    return rows.groupBy(key.alias("group")).agg(F.sum(value).alias(value))
