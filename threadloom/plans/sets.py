"""Queries of dataset builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import datasets
from threadloom.session import table

_D = "('0x' || substr(md5({}), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0"


def flatten_contexts(spark, sf_dir):
    """Turns of a conversation as the contexts of a report."""
    c = table(spark, sf_dir, "conversations")
    r = c.groupBy(F.col("conv_id").cast("string").alias("report")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("contexts"))
    return datasets.flatten_contexts(r, "report", "contexts").select("row_id", "query_id", F.md5("context").alias("context_md5"))


def pairs_negatives(spark, sf_dir):
    """Three negatives for each nation that a customer group names, over suppliers' keys."""
    q = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("query")).agg(F.array_sort(F.collect_set(F.col("c_custkey") % 40)).alias("gold"))
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    out = datasets.pairs_with_negatives(q, v, 3, 11)
    return out.groupBy("query", "label").agg(F.count("*").alias("n"), F.sum("candidate").cast("long").alias("candidates"))


def replay_sample(spark, sf_dir):
    q = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("query")).agg(F.count("*").alias("n_pairs"))
    return datasets.replay_sample(q, 0.25, 3000, 5)


def response_scores(spark, sf_dir):
    """Replies with ids made from part keys."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    ids = lambda x: F.concat(F.lit("T1"), F.lpad((x % 200).cast("string"), 3, "0"))
    r = p.select(
        k.alias("query"), F.array(ids(k), ids(k + 7)).alias("gold"), F.when(k % 5 == 0, F.lit("no idea")).when(k % 5 == 1, F.concat(F.lit("It is "), F.lower(ids(k)), F.lit(".001."))).when(k % 5 == 2, ids(k + 1)).otherwise(F.concat(F.lit("("), ids(k + 7), F.lit(")"))).alias("response"),
        F.col("p_size").cast("double").alias("latency"), F.when(k % 13 == 0, F.lit("timeout")).alias("error"),
    )
    out = datasets.score_responses(r)
    return out.withColumns({c: F.round(c, 6) for c in ("strict", "lenient", "latency")})


def run_comparison(spark, sf_dir):
    """Best events of a user and type by value among those of 30 and more, against those by value rounded down under 70; every event is in one of them."""
    e = table(spark, sf_dir, "events").withColumn("query", F.concat_ws("-", "user_id", "event_type"))
    best = lambda df: df.groupBy("query").agg(F.max(F.struct("score", (-F.col("event_id")).alias("i"))).alias("b")).select("query", (-F.col("b.i")).alias("best"), F.col("b.score").alias("score"))
    new = best(e.where("value >= 30").withColumn("score", F.col("value")))
    old = best(e.where("value < 70").withColumn("score", F.floor("value").cast("double")))
    return datasets.compare_runs(new, old, [0.0, 0.1, 0.5, 1.0]).withColumn("bucket", F.col("bucket").cast("long"))


QUERIES = {f.__name__: f for f in (flatten_contexts, pairs_negatives, replay_sample, response_scores, run_comparison)}
ORACLE = {
    "flatten_contexts": """WITH r AS (SELECT conv_id::VARCHAR AS report, list(text ORDER BY turn) AS c FROM conversations GROUP BY 1), q AS (SELECT report, c, list_filter(c, lambda x: trim(x, ' ') <> '')[1] AS query FROM r), x AS (SELECT report, query, c, unnest(range(len(c))) AS k FROM q)
        SELECT report || ':' || lpad(k::VARCHAR, 4, '0') AS row_id, substr(sha1(report || '|' || query), 1, 12) AS query_id, md5(c[k + 1]) AS context_md5 FROM x WHERE trim(c[k + 1], ' ') <> ''""",
    "pairs_negatives": f"""WITH q AS (SELECT c_nationkey AS query, list_sort(list(DISTINCT c_custkey % 40)) AS gold FROM customer GROUP BY 1), v AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY {_D.format("'11|' || s_suppkey")}, s_suppkey) AS k, count(*) OVER () AS m FROM supplier),
        p AS (SELECT query, gold, unnest(gold) AS positive, (SELECT max(m) FROM v) AS m FROM q), s AS (SELECT *, floor({_D.format("'11|' || query || '|' || positive")} * m)::BIGINT AS start, unnest(range(least(3 + len(gold), m))) AS step FROM p),
        d AS (SELECT s.query, positive, id, row_number() OVER (PARTITION BY s.query, positive ORDER BY step) AS r FROM s JOIN v ON v.k = (start + step) % s.m + 1 WHERE NOT list_contains(gold, id)),
        o AS (SELECT query, positive AS candidate, 1 AS label FROM p UNION ALL SELECT query, id, 0 FROM d WHERE r <= 3) SELECT query, label, count(*) AS n, sum(candidate)::BIGINT AS candidates FROM o GROUP BY ALL""",
    "replay_sample": f"""WITH q AS (SELECT o_custkey AS query, count(*) AS n_pairs, {_D.format("'5|' || o_custkey")} AS draw FROM orders GROUP BY o_custkey), c AS (SELECT *, sum(n_pairs) OVER (ORDER BY draw, query) AS upto FROM q) SELECT query, n_pairs FROM c WHERE upto - n_pairs < 1000""",
    "response_scores": r"""WITH r AS (SELECT p_partkey AS k, p_size::DOUBLE AS latency, 'T1' || lpad((p_partkey % 200)::VARCHAR, 3, '0') AS g1, 'T1' || lpad(((p_partkey + 7) % 200)::VARCHAR, 3, '0') AS g2, 'T1' || lpad(((p_partkey + 1) % 200)::VARCHAR, 3, '0') AS o FROM part),
        s AS (SELECT *, upper(CASE k % 5 WHEN 0 THEN 'no idea' WHEN 1 THEN 'It is ' || lower(g1) || '.001.' WHEN 2 THEN o ELSE '(' || g2 || ')' END) AS t, k % 13 <> 0 AS fine FROM r), f AS (SELECT *, nullif(regexp_extract(t, '\b(TA\d{4}|T\d{4}(?:\.\d{3})?|[SGM]\d{4})\b', 1), '') AS x FROM s),
        m AS (SELECT *, coalesce(x IN (g1, g2), false) AS strict, coalesce(x IN (g1, g2) OR (x <> g1 AND split_part(x, '.', 1) = g1) OR (x <> g2 AND split_part(x, '.', 1) = g2), false) AS lenient FROM f)
        SELECT count(*) AS n, count(*) FILTER (NOT fine) AS errors, count(*) FILTER (fine AND x IS NULL) AS no_id, round(avg(strict::INT) FILTER (fine), 6) AS strict, round(avg(lenient::INT) FILTER (fine), 6) AS lenient, round(avg(latency) FILTER (fine), 6) AS latency FROM m""",
    "run_comparison": """WITH q AS (SELECT *, user_id || '-' || event_type AS q FROM events), a AS (SELECT q, -max({'s': value, 'i': -event_id}).i AS best, max(value) AS score FROM q WHERE value >= 30 GROUP BY 1),
        b AS (SELECT q, -max({'s': floor(value), 'i': -event_id}).i AS best, max(floor(value)) AS score FROM q WHERE value < 70 GROUP BY 1),
        j AS (SELECT a.q AS x, b.q AS y, a.best <> b.best AS d, abs(a.score - b.score) AS v FROM a FULL JOIN b ON a.q = b.q)
        SELECT CASE WHEN y IS NULL THEN 'new_only' WHEN x IS NULL THEN 'old_only' WHEN d THEN 'changed' ELSE 'same' END AS state, CASE WHEN v IS NOT NULL THEN (v >= 0)::INT + (v >= 0.1)::INT + (v >= 0.5)::INT + (v >= 1)::INT END AS bucket, count(*) AS n FROM j GROUP BY ALL""",
}
