"""Queries on graphs, taxonomies and sequences made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import explain, graph, sampling
from threadloom.session import table


def _triples(spark: SparkSession, sf_dir: str):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("User "), F.col("user_id") % 50).alias("subject"), F.lit("actor").alias("subject_type"), F.lit("did").alias("predicate"),
        F.col("event_type").alias("object"), F.lit("action").alias("object_type"), F.date_format("ts", "yyyy-MM-dd").alias("context"),
    )


def graph_upsert_contexts(spark, sf_dir):
    """Two batches of triples upserted in turn, the second twice."""
    t = _triples(spark, sf_dir)
    a, b = graph.nodes_of(t.where("seq % 2 = 0")), graph.nodes_of(t.where("seq % 2 = 1"))
    out = graph.upsert_nodes(graph.upsert_nodes(a, b), b)
    return out.select("id", "name", "type", F.size("contexts").cast("long").alias("n_contexts"), F.md5(F.array_join("contexts", ",")).alias("contexts_md5"))


def graph_edges(spark, sf_dir):
    return graph.edges_of(_triples(spark, sf_dir))


def _nation_edges(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").alias("src"), ((F.col("s_nationkey") * 7 + F.floor(F.col("s_suppkey") / 1000) + 1) % 25).cast("int").alias("dst")).distinct()


def szf_reachability(spark, sf_dir):
    """Nations reachable from those of region 0 over links made from suppliers."""
    seeds = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    return graph.reach(seeds, _nation_edges(spark, sf_dir)).select("node", F.col("distance").cast("long").alias("distance"))


def hierarchy_expand(spark, sf_dir):
    """Predicted nations of customers with their regions, one hop."""
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("id"))
    parent = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return graph.expand(p, parent).groupBy("id").agg(F.count("*").alias("n"))


def error_taxonomy(spark, sf_dir):
    """Wrong ids, made from part keys, against two gold ids each."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    one = lambda k, s: F.concat(F.when(k % 11 == 0, "TA00").otherwise("T1"), F.lpad((k % 90).cast("string"), 3, "0"), F.when(s % 2 == 0, F.concat(F.lit(".00"), (s % 4).cast("string"))).otherwise(""))
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = p.select("p_partkey", one(k, s).alias("predicted"), F.array(one(k + (s % 3) * 2, s + 1), one(k + s, s + 2)).alias("gold"))
    return rows.groupBy(graph.error_class(F.col("predicted"), F.col("gold")).alias("error")).agg(F.count("*").alias("n"))


def neighbor_pairs_lead(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return graph.neighbour_pairs(e, "user_id", ["ts", "event_id"], "event_type").groupBy("a", "b").agg(F.count("*").alias("n"))


def bio_islands(spark, sf_dir):
    """Spans of tags made from event types, in each user's order."""
    e = table(spark, sf_dir, "events")
    tag = F.when(F.col("event_type") == "signup", F.lit("B-X")).when(F.col("event_type") == "click", F.lit("I-X")).when(F.col("event_type") == "view", F.lit("I-Y")).otherwise(F.lit("O"))
    tags = e.select("user_id", "event_id", F.col("event_type").alias("token"), tag.alias("tag"))
    return graph.bio_spans(tags, "user_id", "event_id").select("user_id", "kind", "first", "n", "text")


def dedupe_keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.round("value", 6).alias("value"))
    return graph.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def consensus_exact_quorum(spark, sf_dir):
    """Votes of hours for (user, type), counted with and without repeats."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.hour("ts").alias("voter"))
    loose = graph.exact_quorum(e, ["user_id", "event_type"], "voter", 3, False).withColumnRenamed("votes", "n_votes")
    strict = graph.exact_quorum(e, ["user_id", "event_type"], "voter", 3, True).withColumnRenamed("votes", "n_voters")
    return loose.join(strict, ["user_id", "event_type"], "left")


def stratified_split_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stratum"))
    return sampling.stratified_split(e, 0.8, 0.1, 42)


def negative_sampling_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    return sampling.training_pairs(e, 2.5, 7)


def stream_resume(spark, sf_dir):
    """What a resumed run still has to do: neither finished nor already in the graph."""
    o = table(spark, sf_dir, "orders")
    done = o.where("o_orderstatus = 'F'").select("o_custkey").distinct()
    c = table(spark, sf_dir, "customer")
    return c.join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left_anti").select("c_custkey", "c_name")


def rbo_jaccard_tau(spark, sf_dir):
    """Agreement of two scorers on each user's five best events: value, and value folded at 50."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    a = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    b = Window.partitionBy("user_id").orderBy(F.abs(F.col("value") - 50), "event_id")
    r = e.withColumns({"ra": F.row_number().over(a), "rb": F.row_number().over(b)}).where("ra <= 5 or rb <= 5")
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= 5, F.struct(F.col(c).alias("r"), F.col("event_id").alias("i"))))), lambda x: x["i"])
    lists = r.groupBy("user_id").agg(pick("ra").alias("a"), pick("rb").alias("b"))
    a, b = F.col("a"), F.col("b")
    return lists.select("user_id", F.round(explain.rbo(a, b, 5, 0.8), 6).alias("rbo"), F.round(X.jaccard(a, b), 6).alias("jaccard"), F.round(explain.tau_b(a, b, 5), 6).alias("tau"))


_T = "WITH t AS (SELECT event_id AS seq, 'User ' || (user_id % 50) AS subject, event_type AS object, strftime(ts, '%Y-%m-%d') AS context FROM events)"
_DRAW = "('0x' || substr(md5({}), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0"

QUERIES = {f.__name__: f for f in (graph_upsert_contexts, graph_edges, szf_reachability, hierarchy_expand, error_taxonomy, neighbor_pairs_lead, bio_islands, dedupe_keep_first, consensus_exact_quorum, stratified_split_hash, negative_sampling_hash, stream_resume, rbo_jaccard_tau)}
ORACLE = {
    "graph_upsert_contexts": _T + """, s AS (SELECT seq, subject AS name, 'actor' AS type, context FROM t UNION ALL SELECT seq, object, 'action', context FROM t),
        n AS (SELECT sha256(lower(trim(type)) || '|' || lower(trim(name))) AS id, arg_min(name, (seq % 2) * 1000000000000 + seq) AS name, arg_min(type, seq) AS type, list_sort(list(DISTINCT context)) AS c FROM s GROUP BY 1)
        SELECT id, name, type, len(c) AS n_contexts, md5(array_to_string(c, ',')) AS contexts_md5 FROM n""",
    "graph_edges": _T + " SELECT DISTINCT sha256('actor|' || lower(subject)) AS source, 'DID' AS relation, sha256('action|' || lower(object)) AS target FROM t",
    "szf_reachability": """WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS src, (s_nationkey * 7 + s_suppkey // 1000 + 1) % 25 AS dst FROM supplier),
        r(node, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_regionkey = 0 UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON r.node = e.src WHERE r.d < 26) SELECT node, min(d) AS distance FROM r GROUP BY node""",
    "hierarchy_expand": "WITH p AS (SELECT c_custkey AS q, 'n' || c_nationkey AS id FROM customer UNION SELECT c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT id, count(*) AS n FROM p GROUP BY id",
    "error_taxonomy": """WITH RECURSIVE f AS (SELECT p_partkey AS k, p_size AS s FROM part), x AS (SELECT k, [k, k + (s % 3) * 2, k + s] AS ks, [s, s + 1, s + 2] AS ss FROM f),
        i AS (SELECT k, list_transform(range(1, 4), lambda j: (CASE WHEN ks[j] % 11 = 0 THEN 'TA00' ELSE 'T1' END) || lpad((ks[j] % 90)::VARCHAR, 3, '0') || CASE WHEN ss[j] % 2 = 0 THEN '.00' || (ss[j] % 4) ELSE '' END) AS v FROM x),
        g AS (SELECT k, v[1] AS p, v[2:3] AS g FROM i)
        SELECT CASE WHEN (p LIKE 'TA%' AND len(list_filter(g, lambda z: z LIKE 'TA%')) = 0) OR (p NOT LIKE 'TA%' AND len(list_filter(g, lambda z: z LIKE 'TA%')) > 0 AND len(list_filter(g, lambda z: z LIKE 'T1%')) = 0) THEN 'TACTIC_VS_TECHNIQUE'
            WHEN len(list_filter(g, lambda z: contains(p, '.') <> contains(z, '.') AND split_part(p, '.', 1) = split_part(z, '.', 1))) > 0 THEN 'WRONG_GRANULARITY'
            WHEN len(list_filter(g, lambda z: contains(p, '.') AND contains(z, '.') AND split_part(p, '.', 1) = split_part(z, '.', 1))) > 0 THEN 'SIBLING_TECHNIQUE'
            WHEN len(list_filter(g, lambda z: abs(try_cast(regexp_extract(p, '^T+([0-9]+)', 1) AS INT) - try_cast(regexp_extract(z, '^T+([0-9]+)', 1) AS INT)) <= 5)) > 0 THEN 'NEARBY_TECHNIQUE' ELSE 'UNRELATED' END AS error, count(*) AS n FROM g GROUP BY 1""",
    "neighbor_pairs_lead": "WITH l AS (SELECT event_type AS a, lead(event_type, 1) OVER w AS n1, lead(event_type, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), p AS (SELECT a, n1 AS b FROM l UNION ALL SELECT a, n2 FROM l) SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL",
    "bio_islands": """WITH t AS (SELECT user_id, event_id, event_type AS token, CASE event_type WHEN 'signup' THEN 'B' WHEN 'click' THEN 'I' WHEN 'view' THEN 'I' ELSE 'O' END AS bio, CASE WHEN event_type IN ('signup', 'click') THEN 'X' WHEN event_type = 'view' THEN 'Y' END AS kind FROM events),
        l AS (SELECT *, lag(bio) OVER w AS pb, lag(kind) OVER w AS pk FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        s AS (SELECT *, sum((bio = 'B' OR (bio = 'I' AND (pb IS NULL OR pb = 'O' OR pk <> kind)))::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS span FROM l)
        SELECT user_id, any_value(kind) AS kind, min(event_id) AS first, count(*) AS n, string_agg(token, ' ' ORDER BY event_id) AS text FROM s WHERE bio <> 'O' GROUP BY user_id, span""",
    "dedupe_keep_first": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "consensus_exact_quorum": "SELECT user_id, event_type, count(*) AS n_votes, CASE WHEN count(DISTINCT hour(ts)) >= 3 THEN count(DISTINCT hour(ts)) END AS n_voters FROM events GROUP BY ALL HAVING count(*) >= 3",
    "stratified_split_hash": f"""WITH d AS (SELECT event_id AS id, event_type AS stratum, {_DRAW.format("'42|' || event_id")} AS draw FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw, id) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM d)
        SELECT id, stratum, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""",
    "negative_sampling_hash": f"""WITH d AS (SELECT user_id AS query, event_id AS item, (event_type = 'purchase')::INT AS label, {_DRAW.format("'7|' || user_id || '|' || event_id")} AS draw FROM events),
        r AS (SELECT *, sum(label) OVER (PARTITION BY query) AS pos, row_number() OVER (PARTITION BY query, label ORDER BY draw, item) AS k FROM d) SELECT query, item, label FROM r WHERE label = 1 OR k <= floor(2.5 * pos)""",
    "stream_resume": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "rbo_jaccard_tau": """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS ra, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50), event_id) AS rb FROM events),
        l AS (SELECT user_id, list(event_id ORDER BY ra) FILTER (ra <= 5) AS a, list(event_id ORDER BY rb) FILTER (rb <= 5) AS b FROM r GROUP BY user_id)
        , n AS (SELECT *, least(5, len(a), len(b)) AS n, list_distinct(a || b) AS u FROM l),
        p AS (SELECT user_id, coalesce(list_position(a, i), 6) AS p, coalesce(list_position(b, i), 6) AS q FROM (SELECT user_id, a, b, unnest(u) AS i FROM n)),
        t AS (SELECT x.user_id, sum(sign(x.p - y.p) * sign(x.q - y.q)) / sqrt(sum(abs(sign(x.p - y.p)))::DOUBLE * sum(abs(sign(x.q - y.q)))) AS tau FROM p x JOIN p y ON x.user_id = y.user_id GROUP BY x.user_id)
        SELECT user_id, round(list_sum(list_transform(range(1, n + 1), lambda d: pow(0.8, d - 1) * len(list_intersect(a[1:d], b[1:d])) / d)) * 0.2 / (1 - pow(0.8, n)), 6) AS rbo, round(len(list_intersect(a, b)) / len(u), 6) AS jaccard, round(tau, 6) AS tau FROM n JOIN t USING (user_id)""",
}
