"""Queries over texts: ids, normalisation, units, tokens, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.session import table


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


def doc_id_hash(spark, sf_dir):
    """Content, node and query ids."""
    d = _docs(spark, sf_dir, "text", "lang", "source")
    return d.select("doc_id", X.document_id(F.col("text")).alias("content_id"), X.node_id(F.col("source"), F.col("lang")).alias("node_id"), X.query_id(F.col("source"), F.col("text")).alias("query_id"), F.sha1("text").alias("text_sha1"))


def doc_text_normalize(spark, sf_dir):
    d = _docs(spark, sf_dir, "text")
    return d.select("doc_id", F.md5(X.normalize_name(F.col("text"))).alias("name_md5"), F.md5(X.squashed_key(F.regexp_replace("text", r"[^\x00-\x7F]", ""))).alias("key_md5"), F.md5(X.relation_type(F.regexp_replace("text", r"[^\x00-\x7F]", ""))).alias("relation_md5"))


def page_markdown_clean(spark, sf_dir):
    """Cleanup of markdown around a page's URL."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("[see]("), "url", F.lit(") is  used by [it](x) (Citation: "), F.col("page_id").cast("string"), F.lit(") at "), "url", F.lit(" ( ) , often .")).alias("md"))
    return p.select("page_id", X.clean_markdown(F.col("md")).alias("clean"))


def doc_sentence_split(spark, sf_dir):
    d = _docs(spark, sf_dir, "text").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("k", "s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("chars"), F.max(F.length("s")).cast("long").alias("longest"))


def unit_gate(spark, sf_dir):
    """Sentences that pass the gate: 40 characters or more, and a phrase hit or a capitalised word; rejects by reason."""
    s = F.trim(F.col("s"))
    rows = _docs(spark, sf_dir, "lang", "text").select("doc_id", "lang", F.explode(X.sentences(F.col("text"))).alias("s"))
    phrase, named = s.rlike(r"(^|[^A-Za-z])(token|license|that)([^A-Za-z]|$)"), s.rlike(r"(^|[^A-Za-z])[A-Z][a-z]+")
    stage = F.when(F.length(s) < 40, "too_short").when(phrase, "phrase").when(named, "named").otherwise("no_hit")
    return rows.select("lang", stage.alias("stage")).groupBy("lang", "stage").agg(F.count("*").alias("n"))


def doc_tokenize_counts(spark, sf_dir):
    d = _docs(spark, sf_dir, "text").withColumn("t", X.tokens(F.col("text")))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), X.token_count(F.col("text")).cast("long").alias("n_words"), F.size(X.content_tokens(F.col("text"), ["the", "of", "and"])).cast("long").alias("n_content"))


def doc_boilerplate_filter(spark, sf_dir):
    d = _docs(spark, sf_dir, "source", "text").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return d.groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(X.is_boilerplate(F.col("line")).cast("long")).alias("n_boilerplate"))


def corpus_vocabulary(spark, sf_dir):
    """Tokens in five documents or more: document and corpus frequency."""
    d = _docs(spark, sf_dir, "text").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    per = d.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("cf")).where("df >= 5")


def token_entropy(spark, sf_dir):
    """Shannon entropy in bits of each document's token distribution."""
    d = _docs(spark, sf_dir, "text").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    # -sum(p log p) = log N - sum(n log n) / N, in one aggregation
    return d.groupBy("doc_id").agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("entropy"))


def jaccard_quote_overlap(spark, sf_dir):
    """Each turn against the next one of its conversation."""
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    j = a.join(b, ["conv_id", "turn"])
    x, y = X.tokens(F.col("a")), X.tokens(F.col("b"))
    return j.select("conv_id", "turn", F.round(X.jaccard(F.array_distinct(x), F.array_distinct(y)), 6).alias("jaccard"), X.quote_overlap(F.col("a"), F.col("b")).alias("overlaps"))


def json_props_extract(spark, sf_dir):
    """Fields of the JSON properties, parsed against a schema; bad rows give nulls."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p"), F.get_json_object("props", "$.k").alias("raw"))
    return e.select("event_id", F.col("p.k").alias("k"), F.col("raw").alias("k_text"))


def technique_ids(spark, sf_dir):
    """Classes, parents and ordinals of ids made from part keys."""
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("T", "TA", "S", "G", "M", "X")]), (F.col("p_partkey") % 6 + 1).cast("int")), F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("."), F.lpad(F.col("p_size").cast("string"), 3, "0"))).otherwise(""))
    d = p.select("p_partkey", "p_size", raw.alias("id"))
    return d.select("p_partkey", "id", X.technique_class(F.col("id")).alias("class"), X.parent_technique(F.col("id")).alias("parent"), X.attack_id(F.concat(F.lit("see "), "id", F.lit(", too"))).alias("found"), X.ordinal(F.col("p_size")).alias("place"))


def entity_canonical(spark, sf_dir):
    """Canonical entity types and predicates of event types and priorities."""
    e = table(spark, sf_dir, "events").select("event_type").distinct()
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("event_type")).distinct()
    return e.union(c).select("event_type", X.canonical_entity(F.col("event_type")).alias("entity"), X.canonical_predicate(F.col("event_type")).alias("predicate"), X.normalize_entity(F.concat("event_type", F.lit(" _- x"))).alias("label"))


_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_SENT = r"list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_BP = " OR ".join("regexp_matches(s, '(?i)" + p.replace("'", "''").replace(r"-", r"\x{E000}-\x{F8FF}") + "')" for p in X.BOILERPLATE)
_ENT = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.ENTITY_ALIASES.items())
_PRED = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.PREDICATE_ALIASES.items())

QUERIES = {f.__name__: f for f in (doc_id_hash, doc_text_normalize, page_markdown_clean, doc_sentence_split, unit_gate, doc_tokenize_counts, doc_boilerplate_filter, corpus_vocabulary, token_entropy, jaccard_quote_overlap, json_props_extract, technique_ids, entity_canonical)}
ORACLE = {
    "doc_id_hash": "SELECT doc_id, substr(sha256(text), 1, 16) AS content_id, sha256(lower(trim(source)) || '|' || lower(trim(lang))) AS node_id, substr(sha1(source || '|' || text), 1, 12) AS query_id, sha1(text) AS text_sha1 FROM documents",
    "doc_text_normalize": r"""SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS name_md5, md5(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[^\w]+', '', 'g')) AS key_md5,
        md5(CASE WHEN r = '' THEN 'RELATED_TO' ELSE r END) AS relation_md5 FROM (SELECT *, regexp_replace(upper(trim(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), ' ')), '[^A-Z0-9]+', '_', 'g') AS r FROM documents)""",
    "page_markdown_clean": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('[see](' || url || ') is  used by [it](x) (Citation: ' || page_id || ') at ' || url || ' ( ) , often .',
        '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), 'https?://\S+', '', 'g'), '\(Citation:\s*[^)]*\)', '', 'g'), '\(\s*\)', '', 'g'), '  +', ' ', 'g'), '\s+([.,;:])', '\1', 'g')) AS clean FROM pages""",
    "doc_sentence_split": f"SELECT doc_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS chars, max(length(s)) AS longest FROM (SELECT doc_id, unnest({_SENT}) AS s FROM documents) GROUP BY doc_id",
    "unit_gate": rf"""SELECT lang, CASE WHEN length(s) < 40 THEN 'too_short' WHEN regexp_matches(s, '(^|[^A-Za-z])(token|license|that)([^A-Za-z]|$)') THEN 'phrase' WHEN regexp_matches(s, '(^|[^A-Za-z])[A-Z][a-z]+') THEN 'named' ELSE 'no_hit' END AS stage, count(*) AS n
        FROM (SELECT lang, trim(unnest({_SENT}), ' ') AS s FROM documents) GROUP BY ALL""",
    "doc_tokenize_counts": rf"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda x: x <> '')) AS n_words, len(list_filter(t, lambda x: length(x) > 1 AND x NOT IN ('the', 'of', 'and'))) AS n_content FROM (SELECT *, {_TOK.format('text')} AS t FROM documents)",
    "doc_boilerplate_filter": f"SELECT source, count(*) AS n_lines, sum((length(s) < 8 OR {_BP})::BIGINT)::BIGINT AS n_boilerplate FROM (SELECT source, trim(unnest(string_split(text, chr(10))), ' ') AS s FROM documents) GROUP BY source",
    "corpus_vocabulary": f"SELECT token, count(*) AS df, sum(n)::BIGINT AS cf FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS token FROM documents) GROUP BY ALL) GROUP BY token HAVING count(*) >= 5",
    "token_entropy": f"SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT doc_id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS t FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS token FROM documents) GROUP BY ALL)) GROUP BY doc_id",
    "jaccard_quote_overlap": rf"""WITH w AS (SELECT a.conv_id, a.turn, list_distinct({_TOK.format('a.text')}) AS x, list_distinct({_TOK.format('b.text')}) AS y,
        list_distinct(list_filter(string_split(lower(trim(regexp_replace(a.text, '\s+', ' ', 'g'))), ' '), lambda t: t <> '')) AS p, list_distinct(list_filter(string_split(lower(trim(regexp_replace(b.text, '\s+', ' ', 'g'))), ' '), lambda t: t <> '')) AS q
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
        SELECT conv_id, turn, round(CASE WHEN len(list_distinct(x || y)) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(x || y)) ELSE 0 END, 6) AS jaccard,
        len(p) > 0 AND len(q) > 0 AND len(list_intersect(p, q)) >= greatest(3, least(len(p), len(q)) // 2) AS overlaps FROM w""",
    "json_props_extract": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text FROM events",
    "technique_ids": r"""WITH d AS (SELECT p_partkey, p_size, ['T', 'TA', 'S', 'G', 'M', 'X'][p_partkey % 6 + 1] || lpad(p_partkey::VARCHAR, 4, '0') || CASE WHEN p_size % 3 = 0 THEN '.' || lpad(p_size::VARCHAR, 3, '0') ELSE '' END AS id FROM part)
        SELECT p_partkey, id, CASE WHEN id LIKE 'TA%' THEN 'TA' WHEN id LIKE 'T%' AND contains(id, '.') THEN 'T_sub' WHEN id LIKE 'T%' THEN 'T' WHEN id LIKE 'S%' THEN 'S' WHEN id LIKE 'G%' THEN 'G' WHEN id LIKE 'M%' THEN 'M' ELSE 'unknown' END AS class,
        CASE WHEN contains(id, '.') THEN split_part(id, '.', 1) END AS parent, nullif(regexp_extract('see ' || id || ', too', '\b(TA\d{4}|T\d{4}(?:\.\d{3})?|[SGM]\d{4})\b', 1), '') AS found,
        p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS place FROM d""",
    "entity_canonical": rf"""WITH d AS (SELECT DISTINCT event_type FROM events UNION ALL SELECT DISTINCT c_mktsegment FROM customer), n AS (SELECT event_type, translate(trim(lower(event_type)), ' _', '--') AS k FROM d)
        SELECT event_type, CASE k {_ENT} ELSE k END AS entity, CASE k {_PRED} ELSE k END AS predicate, trim(lower(regexp_replace(event_type || ' _- x', '[\s\-_]+', ' ', 'g'))) AS label FROM n""",
}
