"""Queries of explanations, counterfactuals, propagation and paired kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import explain, kernels, propagate, ranking
from threadloom.session import table


def surface_forms(spark, sf_dir):
    """Buckets of names in several cases, and a substitute recast to each."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.col("p_partkey").alias("k"))
    name = F.when(F.col("k") % 5 == 0, F.upper("p_brand")).when(F.col("k") % 5 == 1, F.lower("p_name")).when(F.col("k") % 5 == 2, explain.title(F.col("p_name"))).when(F.col("k") % 5 == 3, F.lit("CozyDuke")).otherwise(F.col("p_name"))
    rows = p.select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", "name", explain.surface_form(F.col("name")).alias("form"), explain.recast(F.lit("wizard spider"), F.col("name")).alias("recast"), explain.insert_actor(F.col("name"), F.lit("APT0")).alias("inserted"))


def counterfactual_shift(spark, sf_dir):
    """Rankings of users' events by value, against values pulled towards 50 for views: flips, moves and agreement."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"), "event_type")
    after = e.withColumn("score", F.when(F.col("event_type") == "view", 50 + (F.col("score") - 50) / 2).otherwise(F.col("score")))
    s = explain.shift(ranking.ranked(e), ranking.ranked(after))
    return s.withColumns({c: F.round(c, 6) for c in ("gold_score_delta", "margin_delta", "rbo", "tau")}).withColumns({"gold_rank_delta": F.col("gold_rank_delta").cast("long"), "top_overlap": F.col("top_overlap").cast("long")})


def flip_rates(spark, sf_dir):
    """Share of flips by margin tier, with Wilson intervals."""
    from threadloom.functions.stats import wilson

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.col("value").alias("score"), F.lit(1).alias("label"), "event_type")
    after = e.withColumn("score", F.when(F.col("event_type") == "view", 50 + (F.col("score") - 50) / 2).otherwise(F.col("score")))
    s = explain.shift(ranking.ranked(e), ranking.ranked(after))
    g = s.groupBy(explain.tier(-F.col("margin_delta")).alias("tier")).agg(F.count("*").alias("n"), F.sum(F.col("flip").cast("long")).alias("flips"))
    low, high = wilson(F.col("flips"), F.col("n"))
    return g.select("tier", "n", "flips", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def evidence_words(spark, sf_dir):
    """Most important words of items, with hash draws as importance."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("place", "token"))
    return explain.evidence(b.withColumn("share", 2 * X.hash_draw(F.lit("e"), F.col("item_id"), F.col("place")) - 1), "item_id").select("item_id", "text")


def _linked_parts(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = lambda x: F.element_at(F.array(*[F.lit(t) for t in ("malware", "tool", "indicator", "vulnerability", "country")]), (x % 5 + 1).cast("int"))
    other, sure = F.floor(k * 3 / 2), lambda x: (x * 37 % 100) / 100.0
    return p.select(
        k.alias("seq"), F.concat(F.lit(" Item "), k.cast("string"), F.lit("s")).alias("s_name"), kind(k).alias("s_type"), sure(k).alias("s_confidence"),
        F.element_at(F.array(*[F.lit(x) for x in ("uses", "targets", "exploits", "indicates")]), (k % 4 + 1).cast("int")).alias("predicate"),
        F.concat(F.lit("item  "), other.cast("string")).alias("o_name"), kind(other).alias("o_type"), (sure(other) / 2).alias("o_confidence"), (F.col("p_size") / 60.0).alias("confidence"),
    )


def szf_propagation(spark, sf_dir):
    """States of edges that link parts, each to the one of one and a half its number."""
    return propagate.run(_linked_parts(spark, sf_dir))[1].groupBy("state", "predicate").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def szf_nodes(spark, sf_dir):
    """The parts of the same links, with their names and confidences after propagation."""
    return propagate.run(_linked_parts(spark, sf_dir))[0].withColumn("confidence", F.round("confidence", 6))


def wilcoxon_bca(spark, sf_dir):
    """Paired tests of scores against 50 by event type, over users."""
    e = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg((F.round(F.avg("value"), 3) - 50).alias("d"))
    return kernels.paired_tests(e, "event_type")


_TITLE = "list_aggregate(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '')"
_R = "SELECT user_id AS query, event_id AS item, {score} AS score, (event_type = 'purchase')::INT AS label FROM events"
_PER = """SELECT query, max(item) FILTER (rank = 1) AS best, min({{'rank': rank, 'score': score}}) FILTER (label = 1) AS gold, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin, list(item ORDER BY rank) FILTER (rank <= 5) AS top
    FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM ({r})) GROUP BY query"""
_SHIFT = f"WITH a AS ({_PER.format(r=_R.format(score='value'))}), b AS ({_PER.format(r=_R.format(score='''CASE WHEN event_type = 'view' THEN 50 + (value - 50) / 2 ELSE value END'''))})"
_NAMES = f"WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_name) WHEN 2 THEN {_TITLE.format(x='p_name')} WHEN 3 THEN 'CozyDuke' ELSE p_name END AS name FROM part), f AS (SELECT *, len(regexp_split_to_array(trim(name), '\\s+')) AS w, regexp_matches(name, '[A-Za-z]') AND name = upper(name) AS up, regexp_matches(name, '[A-Za-z]') AND name = lower(name) AS lo, regexp_matches(name, '[A-Za-z]') AND name = {_TITLE.format(x='name')} AS ti FROM n)"

#: Written from the rules: nodes of 0.80 and compatible edges of 0.75 are forced by themselves, and forcing crosses compatible edges both ways.
_SZF = """WITH RECURSIVE r AS (SELECT p_partkey AS k, ' Item ' || p_partkey || 's' AS sn, p_partkey % 5 + 1 AS sk, (p_partkey * 37 % 100) / 100.0::DOUBLE AS sc, ['uses', 'targets', 'exploits', 'indicates'][p_partkey % 4 + 1] AS p, (p_partkey * 3 // 2) AS j, p_size / 60.0::DOUBLE AS c FROM part),
    l AS (SELECT *, ['malware', 'tool', 'indicator', 'vulnerability', 'country'][sk] AS st, ['malware', 'tool', 'indicator', 'vulnerability', 'country'][j % 5 + 1] AS ot, 'item ' || k || '::' || ['malware', 'tool', 'indicator', 'vulnerability', 'country'][sk] AS a,
        'item ' || j || '::' || ['malware', 'tool', 'indicator', 'vulnerability', 'country'][j % 5 + 1] AS b, (j * 37 % 100) / 200.0::DOUBLE AS oc FROM r),
    e AS (SELECT * FROM l WHERE p = 'targets' OR (p = 'uses' AND st IN ('malware', 'tool', 'threat-actor', 'intrusion-set') AND ot IN ('attack-pattern', 'tool', 'infrastructure', 'malware')) OR (p = 'exploits' AND st IN ('malware', 'tool', 'threat-actor') AND ot = 'vulnerability')
        OR (p = 'indicates' AND st = 'indicator' AND ot IN ('malware', 'tool', 'attack-pattern', 'campaign', 'intrusion-set'))),
    ends AS (SELECT a AS node, 2 * k AS k, sn AS name, st AS kind, sc AS c FROM l UNION ALL SELECT b, 2 * k + 1, 'item  ' || j, ot, oc FROM l),
    g(node) AS (SELECT node FROM ends WHERE c >= 0.80 UNION SELECT a FROM e WHERE c >= 0.75 UNION SELECT b FROM e WHERE c >= 0.75 UNION SELECT CASE WHEN e.a = g.node THEN e.b ELSE e.a END FROM g JOIN e ON e.a = g.node OR e.b = g.node),
    w AS (SELECT p, c, CASE WHEN c >= 0.75 THEN 'seed' WHEN a IN (SELECT node FROM g) THEN 'forced' ELSE 'kept' END AS state FROM e)"""

QUERIES = {f.__name__: f for f in (surface_forms, counterfactual_shift, flip_rates, evidence_words, szf_propagation, szf_nodes, wilcoxon_bca)}
ORACLE = {
    "surface_forms": _NAMES + """, g AS (SELECT *, CASE WHEN w = 1 AND NOT up AND NOT lo AND NOT ti AND regexp_matches(name[2:], '[A-Z]') THEN 'mixed_case_special' WHEN w = 1 AND up AND regexp_matches(name, '[0-9]') THEN '1word_upper_digit' WHEN w = 1 AND up THEN '1word_upper_nodigit'
        WHEN w = 1 AND ti THEN '1word_title' WHEN w = 1 THEN 'other' WHEN w = 2 AND ti THEN '2word_title' WHEN w = 2 THEN '2word_other' ELSE '3plus_words' END AS form FROM f)
        SELECT p_partkey, name, form, CASE WHEN form = 'mixed_case_special' THEN 'Wizard Spider' WHEN up THEN 'WIZARD SPIDER' WHEN ti THEN 'Wizard Spider' WHEN lo THEN 'wizard spider' ELSE 'wizard spider' END AS recast,
        'APT0 was observed ' || CASE WHEN regexp_matches(name, '^[A-Z][a-z]') AND NOT regexp_matches(name, '^[A-Za-z][A-Za-z0-9]*[A-Z]') THEN lower(name[1:1]) || name[2:] ELSE name END AS inserted FROM g""",
    "evidence_words": r"""WITH t AS (SELECT item_id, unnest(range(len(w))) AS place, w FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
        s AS (SELECT item_id, place, regexp_replace(w[place + 1], '^[,.?!;:"''()\[\]{}]+|[,.?!;:"''()\[\]{}]+$', '', 'g') AS word, 2 * (('0x' || substr(md5('e|' || item_id || '|' || place), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0) - 1 AS share FROM t),
        r AS (SELECT *, abs(share) < 0.5 AS medium, CASE WHEN abs(share) < 0.5 THEN abs(share) ELSE share END AS weight FROM s WHERE word <> '' AND abs(share) >= 0.2),
        b AS (SELECT item_id, lower(word) AS key, min({'m': medium, 'w': -weight, 'p': place, 'x': word}) AS b FROM r GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY b.m, b.w, b.p) AS rank, sum((NOT b.m)::INT) OVER (PARTITION BY item_id) AS high FROM b),
        l AS (SELECT item_id, list(b.x ORDER BY rank) AS x FROM k WHERE rank <= 3 AND (NOT b.m OR high < 2) GROUP BY item_id)
        SELECT item_id, CASE len(x) WHEN 1 THEN x[1] WHEN 2 THEN x[1] || ' and ' || x[2] ELSE x[1] || ', ' || x[2] || ', and ' || x[3] END AS text FROM l""",
    "szf_propagation": _SZF + " SELECT state, p AS predicate, count(*) AS n, round(avg(CASE WHEN state <> 'kept' THEN greatest(c, 0.9) ELSE c END), 6) AS confidence FROM w GROUP BY ALL",
    "szf_nodes": _SZF + """, f AS (SELECT node, min({'k': k, 'name': name, 'kind': kind}) AS f, max(c) AS c FROM ends GROUP BY node)
        SELECT f.node, f.f.name AS name, f.f.kind AS type, g.node IS NOT NULL AS forced, round(CASE WHEN g.node IS NOT NULL THEN greatest(f.c, 0.9) ELSE f.c END, 6) AS confidence FROM f LEFT JOIN (SELECT DISTINCT node FROM g) g ON f.node = g.node""",
    "counterfactual_shift": _SHIFT + """, j AS (SELECT a.query, a.best <> b.best AS flip, b.gold.rank - a.gold.rank AS gold_rank_delta, round(b.gold.score - a.gold.score, 6) AS gold_score_delta, round(b.margin - a.margin, 6) AS margin_delta, a.top AS x, b.top AS y, least(5, len(a.top), len(b.top)) AS n FROM a JOIN b ON a.query = b.query),
        p AS (SELECT query, coalesce(list_position(x, i), 6) AS p, coalesce(list_position(y, i), 6) AS q FROM (SELECT query, x, y, unnest(list_distinct(x || y)) AS i FROM j)),
        t AS (SELECT u.query, sum(sign(u.p - v.p) * sign(u.q - v.q)) / sqrt(sum(abs(sign(u.p - v.p)))::DOUBLE * sum(abs(sign(u.q - v.q)))) AS tau FROM p u JOIN p v ON u.query = v.query GROUP BY u.query)
        SELECT j.query, flip, gold_rank_delta, gold_score_delta, margin_delta, len(list_intersect(x, y)) AS top_overlap, round(list_sum(list_transform(range(1, n + 1), lambda d: pow(0.8, d - 1) * len(list_intersect(x[1:d], y[1:d])) / d)) * 0.2 / (1 - pow(0.8, n)), 6) AS rbo, round(tau, 6) AS tau FROM j JOIN t USING (query)""",
    "flip_rates": _SHIFT + """, j AS (SELECT a.best <> b.best AS flip, a.margin - b.margin AS m FROM a JOIN b ON a.query = b.query), g AS (SELECT CASE WHEN m >= 0.3 THEN 'HIGH' WHEN m >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS tier, count(*) AS n, count(*) FILTER (flip) AS flips FROM j GROUP BY 1), w AS (SELECT *, flips / n AS p, 1.959963984540054::DOUBLE AS z FROM g)
        SELECT tier, n, flips, round(CASE WHEN flips = 0 THEN 0 ELSE (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) END, 6) AS low, round(CASE WHEN flips = n THEN 1 ELSE (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) END, 6) AS high FROM w""",
}
