"""Queries around experiments, parsing of replies and tags, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import experiments, extraction, graph
from threadloom.session import table

STOP = ["the", "and", "of", "in"]


def _records(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.concat_ws(" ", F.lit("Order of"), (F.col("l_orderkey") % 300).cast("string")).alias("query_raw"), F.when(F.col("l_orderkey") % 300 == 7, "").otherwise(F.concat_ws(" ", F.lit("order of"), (F.col("l_orderkey") % 300).cast("string"))).alias("query_norm"),
        F.concat(F.lit("T1"), F.lpad((F.col("l_partkey") % 50).cast("string"), 3, "0")).alias("candidate_id"), F.concat(F.lit("T1"), F.lpad((F.col("l_partkey") % 50).cast("string"), 3, "0"), F.lit(" x")).alias("candidate_norm"),
        F.when(F.col("l_partkey") % 17 == 0, "").otherwise(F.concat(F.lit("T1 — "), F.col("l_shipdate").cast("date").cast("string"))).alias("candidate_text"), (F.col("l_quantity") > 45).cast("int").alias("label"),
        F.when(F.col("l_orderkey") % 300 % 11 == 0, "external_x").otherwise(F.concat(F.lit("actor"), (F.col("l_orderkey") % 300 % 5).cast("string"))).alias("actor"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")).alias("seq"),
    )


def record_checks(spark, sf_dir):
    """What is wrong with flat pair records made from order lines."""
    return experiments.record_checks(_records(spark, sf_dir)).withColumn("empty_share", F.round("empty_share", 6))


def actor_splits(spark, sf_dir):
    """Queries of those records by actor and split."""
    q = _records(spark, sf_dir).where("query_norm <> ''").groupBy(F.col("query_norm").alias("query")).agg(F.min("actor").alias("actor"), F.sum("label").alias("n_gold"))
    return experiments.actor_split(q, 42).groupBy("actor", "split").agg(F.count("*").alias("n"), F.min("query").alias("first"))


def test_items(spark, sf_dir):
    """Gold ids of the local actors' queries, in order."""
    out = experiments.test_items(_records(spark, sf_dir))
    return out.select("query_norm", "actor", "entity_type", F.array_join("gold", ",").alias("gold"))


def fitting_texts(spark, sf_dir):
    """How many texts of each length a vectoriser may see if orders under 50 are tests."""
    r = _records(spark, sf_dir)
    tests = r.where("try_cast(substring(query_norm, 10) as int) < 50").select("query_norm")
    return experiments.fitting_texts(r, tests).groupBy(F.length("text").alias("length")).agg(F.count("*").alias("n"))


def training_pairs(spark, sf_dir):
    """Positives and drawn negatives for benchmark items against conversations."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query_raw"), F.array(F.concat(F.lit("c"), F.col("item_id").cast("string")), F.concat(F.lit("c"), (F.col("item_id") + 1).cast("string"))).alias("gold_ids"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")).select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), "text")
    return experiments.training_pairs(b, c, 42).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("queries"))


def threshold_table(spark, sf_dir):
    """Values as scores and purchases as labels at nine thresholds."""
    e = table(spark, sf_dir, "events").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    out = experiments.threshold_table(e, [10.0 * k for k in range(1, 10)])
    return out.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "best")


def _answers(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    tid = lambda x: F.concat(F.lit("T1"), F.lpad((x % 60).cast("string"), 3, "0"))
    text = F.concat(F.lit(" Query  "), (k % 900).cast("string"), F.lit(" "))
    return p.select(text.alias("query_raw"), F.array(tid(k), tid(k + 1)).alias("gold_ids"), F.when(k % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("I say "), tid(k + k % 4), F.lit(" or T1999"))).alias("llm_response"), F.when(k % 10 == 0, F.lit("timeout")).alias("error"), k.alias("seq"))


def response_results(spark, sf_dir):
    """Answers made from parts, the last per query."""
    return experiments.response_results(_answers(spark, sf_dir))


def system_comparison(spark, sf_dir):
    """The same against a rule, by McNemar's test."""
    other = spark.range(900).select(F.concat(F.lit("Query "), F.col("id").cast("string")).alias("query"), (F.col("id") % 2).cast("int").alias("correct"))
    out = experiments.compare_systems(experiments.response_results(_answers(spark, sf_dir)), other)
    return out.withColumn("chi2", F.round("chi2", 6)).drop("p_value")


def first_candidates(spark, sf_dir):
    """Whether the first candidate is gold, over the records' queries."""
    return experiments.first_candidates(_records(spark, sf_dir)).groupBy("correct").agg(F.count("*").alias("n"))


def domain_lexicon(spark, sf_dir):
    """Words of candidate texts and frequent words of queries, by length."""
    b = table(spark, sf_dir, "benchmark")
    r = b.select(F.concat(F.lit("T1 — "), F.substring_index("text", " ", 6)).alias("candidate_text"), F.col("text").alias("query_raw"))
    return experiments.lexicon(r, STOP, ["that"], 5).groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n"))


def bundle_vocabulary(spark, sf_dir):
    """Words of live objects of two kinds, made from parts."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 == 0, "tool").when(F.col("p_size") % 3 == 1, "malware").otherwise("intrusion-set").alias("type"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), (F.col("p_size") > 45).alias("revoked"), F.lit(None).cast("boolean").alias("deprecated"))
    return experiments.bundle_vocabulary(p, STOP, ["tool", "malware"])


def welch_test(spark, sf_dir):
    """Values of clicks against those of views."""
    out = experiments.welch(table(spark, sf_dir, "events").select("event_type", F.col("value").alias("x")), "event_type", "click", "view")
    return out.select("n_a", "n_b", *[F.round(c, 6).alias(c) for c in ("t", "df", "d")], "effect")


def run_summaries(spark, sf_dir):
    """Extraction runs made from orders, per model."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    m = o.select(
        F.col("o_orderpriority").alias("model_used"), (k % 90 + 10).alias("num_sentences_total"), (k % 9 + 1).alias("num_sentences_used"), (k % 40).alias("num_raw_triples"), F.floor((k % 40) / 3).alias("num_valid_triples"), (k % 2).alias("num_suspicious_triples"),
        (F.floor(F.col("o_totalprice") / 10) / 100).alias("runtime_seconds"),
    )
    out = experiments.run_summary(m)
    return out.select(*[c for c in out.columns[:7]], *[F.round(c, 6).alias(c) for c in out.columns[7:]])


def best_pages(spark, sf_dir):
    """Three order lines of the highest quantity per order, as pages of a report."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("page"), F.col("l_quantity").cast("long").alias("valid"), F.lit(0).alias("invalid"))
    return experiments.best_pages(t).select("report", "page", "valid", F.col("rank").cast("long").alias("rank"))


def weight_blends(spark, sf_dir):
    """Embeddings as two models' weights, blended and averaged."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("name"), F.col("vec_id").alias("place"), F.get("embedding", 0).cast("double").alias("value"), F.get("embedding", 1).cast("double").alias("other"))
    a, b = e.select("name", "place", "value"), e.select("name", "place", F.col("other").alias("value"))
    out = experiments.blend(a, b, 0.25).withColumnRenamed("value", "blend").join(experiments.soup([a, b, a]).withColumnRenamed("value", "soup"), ["name", "place"])
    return out.groupBy("name").agg(F.round(F.sum("blend"), 5).alias("blend"), F.round(F.sum("soup"), 5).alias("soup"))


def reply_lists(spark, sf_dir):
    """Replies in four forms, read loosely and strictly."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    one = F.concat(F.lit('{"subject": {"name": "'), "c_name", F.lit('", "type": "tool"}, "relation": "uses", "object": {"text": "'), "c_mktsegment", F.lit('"}}'))
    reply = F.when(k % 4 == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(k % 4 == 1, one).when(k % 4 == 2, F.concat(F.lit("See: ["), one, F.lit(", "), one, F.lit("]. Done"))).otherwise(F.lit("none ]["))
    loose, strict = extraction.triple_list(extraction.loose_json_list(reply)), extraction.triple_list(extraction.any_json(reply))
    return c.select("c_custkey", F.size(loose).cast("long").alias("loose"), F.size(strict).cast("long").alias("strict"), F.get(strict, 0)["s_name"].alias("subject"), F.get(strict, 0)["predicate"].alias("predicate"), F.get(strict, 0)["o_name"].alias("object"))


def chunk_records(spark, sf_dir):
    """What a report's file holds for units made from customers, counted by their triples."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    t = lambda kind, p: F.struct(F.col("c_name").alias("s_name"), F.lit(kind).alias("s_type"), F.lit(p).alias("predicate"), F.lit("x").alias("o_name"), F.lit("tool").alias("o_type"), F.lit("q").alias("quote"))
    units = c.select(F.col("c_name").alias("sentence"), F.col("c_nationkey").alias("page_no"), (k % 1000).alias("i"), F.when(k % 3 == 0, F.array(t("malware", " uses "), t("widget", "uses"))).when(k % 3 == 1, F.array(t("malware", "befriends"))).otherwise(F.array(t("tool", "uses"), t("malware", "uses"))).alias("triples"))
    out = extraction.chunk_data(units, ["malware", "tool"], ["uses"])
    return out.groupBy(F.size("triple").alias("triples"), F.col("metadata.page_number").alias("page"), F.col("metadata.source").alias("source")).agg(F.count("*").alias("n"), F.min("metadata.id").alias("first_id"))


def plain_entity_spans(spark, sf_dir):
    """Spans of codes made from users' events, and what tag names mean."""
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).otherwise(0)
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("t"), code.alias("c")))).alias("s"))
    spans = graph.plain_entities(F.transform("s", lambda x: x["t"]), F.transform("s", lambda x: x["c"]))
    kind = graph.tag_type(F.get(graph.named_tags(F.transform("s", lambda x: x["c"] * 4)), 0))
    return g.select("user_id", F.size(spans).cast("long").alias("n"), F.coalesce(F.get(spans, 0)["start"], F.lit(-1)).cast("long").alias("start"), F.coalesce(F.get(spans, 0)["end"], F.lit(-1)).cast("long").alias("end"), F.get(spans, 0)["text"].alias("text"), kind.alias("kind"))


_REC = """WITH r AS (SELECT 'Order of ' || (l_orderkey % 300) AS raw, CASE WHEN l_orderkey % 300 = 7 THEN '' ELSE 'order of ' || (l_orderkey % 300) END AS norm, 'T1' || lpad((l_partkey % 50)::VARCHAR, 3, '0') AS cid, CASE WHEN l_partkey % 17 = 0 THEN '' ELSE 'T1 — ' || l_shipdate::DATE END AS text,
    (l_quantity > 45)::INT AS label, CASE WHEN l_orderkey % 300 % 11 = 0 THEN 'external_x' ELSE 'actor' || (l_orderkey % 300 % 5) END AS actor, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 100 + l_quantity::BIGINT AS seq FROM lineitem)"""
_ANS = "WITH p AS (SELECT p_partkey AS k, 'Query ' || (p_partkey % 900) AS q, CASE WHEN p_partkey % 3 <> 0 THEN 'T1' || lpad(((p_partkey + p_partkey % 4) % 60)::VARCHAR, 3, '0') END AS x FROM part WHERE p_partkey % 10 <> 0), a AS (SELECT q, arg_max({'k': k, 'x': x}, k) AS r FROM p GROUP BY q), c AS (SELECT q, r.x AS predicted, coalesce(r.x IN ('T1' || lpad((r.k % 60)::VARCHAR, 3, '0'), 'T1' || lpad(((r.k + 1) % 60)::VARCHAR, 3, '0')), false)::INT AS correct FROM a)"
_WORDS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ('the', 'and', 'of', 'in'))"

QUERIES = {f.__name__: f for f in (
    record_checks, actor_splits, test_items, fitting_texts, training_pairs, threshold_table, response_results, system_comparison, first_candidates, domain_lexicon, bundle_vocabulary, welch_test, run_summaries, best_pages, weight_blends, reply_lists, chunk_records, plain_entity_spans,
)}
ORACLE = {
    "record_checks": _REC + """ SELECT count(*) AS "rows", count(DISTINCT norm) FILTER (norm <> '') AS queries, count(*) FILTER (norm <> '' AND text = '') AS empty, count(*) FILTER (norm <> '' AND label = 1) AS positives, count(*) FILTER (norm <> '' AND label <> 1) AS negatives, round(count(*) FILTER (norm <> '' AND text = '') / count(*), 6) AS empty_share FROM r""",
    "actor_splits": _REC + """, q AS (SELECT norm AS query, min(actor) AS actor, sum(label) AS g FROM r WHERE norm <> '' GROUP BY 1), o AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY ('0x' || substr(md5('42|' || query), 1, 12))::UBIGINT, query) AS k, count(*) OVER (PARTITION BY actor) AS n FROM q WHERE NOT starts_with(actor, 'external_') AND g > 0)
        SELECT actor, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(query) AS first FROM o GROUP BY ALL""",
    "test_items": _REC + """, o AS (SELECT * FROM r WHERE norm <> '' AND NOT starts_with(actor, 'external_')), h AS (SELECT norm, arg_min(actor, seq) AS actor FROM o GROUP BY 1), g AS (SELECT norm, cid, min(seq) AS seq FROM o WHERE label = 1 GROUP BY ALL)
        SELECT norm AS query_norm, max(actor) AS actor, 'technique' AS entity_type, string_agg(cid, ',' ORDER BY seq, cid) AS gold FROM g JOIN h USING (norm) GROUP BY norm""",
    "fitting_texts": _REC + ", o AS (SELECT * FROM r WHERE norm <> '' AND NOT starts_with(actor, 'external_') AND replace(norm, 'order of ', '')::INT >= 50) SELECT length(t) AS length, count(*) AS n FROM (SELECT DISTINCT raw AS t FROM o UNION ALL SELECT text FROM o WHERE text <> '') GROUP BY 1",
    "threshold_table": """WITH e AS (SELECT value AS s, event_type = 'purchase' AS y FROM events), t AS (SELECT t * 10.0::DOUBLE AS threshold, count(*) FILTER (s >= t * 10 AND y) AS tp, count(*) FILTER (s >= t * 10 AND NOT y) AS fp, count(*) FILTER (s < t * 10 AND y) AS fn, count(*) FILTER (s < t * 10 AND NOT y) AS tn FROM e, (SELECT unnest(range(1, 10)) AS t) GROUP BY 1),
        f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM t)
        SELECT threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, threshold = (SELECT arg_min(threshold, {'f': -f, 't': threshold}) FROM f) AS best FROM f""",
    "response_results": _ANS + " SELECT ' Query  ' || substr(q, 7) || ' ' AS query, predicted, correct FROM c",
    "system_comparison": _ANS + """, j AS (SELECT c.correct AS a, substr(q, 7)::INT % 2 AS b FROM c), t AS (SELECT count(*) AS shared, count(*) FILTER (a = 1 AND b = 1) AS "both", count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 0 AND b = 0) AS neither FROM j),
        s AS (SELECT *, pow(only_a - only_b, 2) / (only_a + only_b) AS x FROM t) SELECT shared, "both", only_a, only_b, neither, round(x, 6) AS chi2, CASE WHEN x > 10.827566 THEN '***' WHEN x > 6.634897 THEN '**' WHEN x > 3.841459 THEN '*' ELSE 'ns' END AS stars FROM s""",
    "first_candidates": _REC + " SELECT correct, count(*) AS n FROM (SELECT arg_min(label, seq) AS correct FROM r WHERE norm <> '' GROUP BY norm HAVING max(label) = 1) GROUP BY 1",
    "domain_lexicon": f"""WITH b AS (SELECT DISTINCT text, array_to_string(string_split(text, ' ')[1:6], ' ') AS c FROM benchmark), n AS (SELECT DISTINCT unnest({_WORDS.format('c')}) AS word FROM b), q AS (SELECT unnest({_WORDS.format('text')}) AS word FROM b), o AS (SELECT word FROM q GROUP BY 1 HAVING count(*) >= 5 AND length(word) > 2 AND word <> 'that')
        SELECT length(word) AS length, count(*) AS n FROM (FROM n UNION FROM o) GROUP BY 1""",
    "bundle_vocabulary": f"SELECT DISTINCT unnest({_WORDS.format('''p_name || ' ' || p_type''')}) AS word FROM part WHERE p_size % 3 <> 2 AND p_size <= 45",
    "welch_test": """WITH s AS (SELECT count(*) FILTER (event_type = 'click') AS n_a, count(*) FILTER (event_type = 'view') AS n_b, avg(value) FILTER (event_type = 'click') AS ma, avg(value) FILTER (event_type = 'view') AS mb, var_samp(value) FILTER (event_type = 'click') AS va, var_samp(value) FILTER (event_type = 'view') AS vb FROM events), d AS (SELECT *, (ma - mb) / sqrt((va + vb) / 2) AS d FROM s)
        SELECT n_a, n_b, round((ma - mb) / sqrt(va / n_a + vb / n_b), 6) AS t, round(pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)), 6) AS df, round(d, 6) AS d, CASE WHEN abs(d) >= 0.8 THEN 'LARGE' WHEN abs(d) >= 0.5 THEN 'MEDIUM' WHEN abs(d) >= 0.2 THEN 'SMALL' ELSE 'NEGLIGIBLE' END AS effect FROM d""",
    "run_summaries": """WITH m AS (SELECT o_orderpriority AS m, o_orderkey % 90 + 10 AS a, o_orderkey % 9 + 1 AS b, o_orderkey % 40 AS c, (o_orderkey % 40) // 3 AS d, o_orderkey % 2 AS e, floor(o_totalprice / 10) / 100 AS f FROM orders), t AS (SELECT m, count(*) AS n, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d, sum(e)::BIGINT AS e, sum(f) AS f FROM m GROUP BY 1)
        SELECT m AS model_used, n AS reports, a AS num_sentences_total, b AS num_sentences_used, c AS num_raw_triples, d AS num_valid_triples, e AS num_suspicious_triples, round(f, 6) AS runtime_seconds, round(c / b, 6) AS triples_per_sentence, round(d / c, 6) AS valid_share, round(d / f, 6) AS valid_per_second FROM t""",
    "best_pages": "SELECT l_orderkey AS report, l_linenumber AS page, l_quantity::BIGINT AS valid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::BIGINT DESC, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 3",
    "weight_blends": "SELECT label::VARCHAR AS name, round(sum(0.75 * embedding[1]::DOUBLE + 0.25 * embedding[2]::DOUBLE), 5) AS blend, round(sum((2 * embedding[1]::DOUBLE + embedding[2]::DOUBLE) / 3), 5) AS soup FROM embeddings GROUP BY 1",
    "reply_lists": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS loose, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS strict, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS subject, CASE WHEN c_custkey % 4 < 3 THEN 'uses' END AS predicate, CASE WHEN c_custkey % 4 < 3 THEN c_mktsegment END AS object FROM customer",
    "chunk_records": "SELECT CASE c_custkey % 3 WHEN 0 THEN 1 ELSE 2 END AS triples, c_nationkey AS page, 'TEXT' AS source, count(*) AS n, min(lpad((c_custkey % 1000)::VARCHAR, 3, '0')) AS first_id FROM customer WHERE c_custkey % 3 <> 1 GROUP BY ALL",
    "plain_entity_spans": """WITH e AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS c FROM events), g AS (SELECT *, sum((c <> 2)::INT) OVER (PARTITION BY user_id ORDER BY i) AS isle FROM e),
        s AS (SELECT user_id, isle, min(i) AS start, max(i) + 1 AS "end", string_agg(t, ' ' ORDER BY i) AS text, arg_min(c, i) AS c FROM g GROUP BY ALL), f AS (SELECT user_id, count(*) AS n, min({'s': start, 'e': "end", 't': text}) AS f FROM s WHERE c = 1 GROUP BY 1)
        SELECT u.user_id, coalesce(n, 0) AS n, coalesce(f.f.s, -1) AS start, coalesce(f.f.e, -1) AS "end", f.f.t AS text, CASE u.c WHEN 1 THEN 'location' WHEN 2 THEN 'malware' END AS kind FROM (SELECT user_id, arg_min(c, i) AS c FROM e GROUP BY 1) u LEFT JOIN f USING (user_id)""",
}
