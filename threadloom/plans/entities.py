"""Queries of the loose normalisers, on names made from parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import entities as E
from threadloom.session import table

_NAMES = [
    "used T1059.001 here", "cve-2021-44228 rce", "https://Evil.Example.com/path/x", "10.0.0.1", "Mimikatz.exe", "'Cobalt  Strike'", "APT28", "the Lazarus group", "spear-phish mail", "a trojan loader",
    "Metasploit framework", "DNS server", "Acme Corp", "plain words", "x-agent.dll", "",
]
_KINDS = ["", "Attack Pattern", "Org", "c2", "MALWARE", "server"]
_VERBS = ["", "Executes", "connects  to", "befriends", "part of", "installs", "hosted on"]
_URLS = ["https://attack.mitre.org/techniques/T1059/001/", "http://ATTACK.mitre.org/software/s0002", "https://attack.mitre.org/groups/G0016", "https://example.org/techniques/T1059", "attack.mitre.org/tactics/TA0001", "attack.mitre.org/techniques/T1204"]


def _pick(values: list[str], k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _named(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k % 5 == 4, F.col("p_name")).otherwise(_pick(_NAMES, k))
    return p.select("p_partkey", name.alias("name"), _pick(_KINDS, F.floor(k / 3)).alias("kind"), _pick(_VERBS, k).alias("verb"))


def entity_labels(spark, sf_dir):
    """Labels, types and predicates of loosely written names."""
    n, c = _named(spark, sf_dir), F.col
    return n.select("p_partkey", E.entity_label(c("name"), c("kind")).alias("label"), E.inferred_type(c("name")).alias("inferred"), E.implicit_type(c("name")).alias("implicit"), E.loose_type(c("kind")).alias("kind"), E.loose_predicate(c("verb")).alias("predicate"))


def triple_keys(spark, sf_dir):
    """Comparison keys and nested forms of triples, counted."""
    n, c = _named(spark, sf_dir), F.col
    key, told = E.triple_key(c("name"), c("verb"), c("name")), E.unified(c("name"), c("kind"), c("verb"), c("name"), c("kind"))
    return n.select(key.alias("k"), told.alias("u")).groupBy(F.col("k.subject").alias("subject"), F.col("k.predicate").alias("predicate"), F.col("u.predicate").alias("canonical"), F.col("u.subject.type").alias("type")).agg(F.count("*").alias("n"))


def link_targets(spark, sf_dir):
    """Kinds and ids of links, and the types of their targets."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    found = p.select(E.link_target(_pick(_URLS, k)).alias("t"), F.array(F.when(k % 3 == 0, F.lit("UcoexGroup")).otherwise(F.lit("Thing"))).alias("labels"), F.when(k % 7 == 0, F.lit(" campaign ")).alias("kind"))
    return found.groupBy(F.col("t.kind").alias("kind"), F.col("t.id").alias("id"), E.target_type(F.coalesce("t.id", F.lit("?")), F.col("labels"), F.col("kind")).alias("type")).agg(F.count("*").alias("n"))


def text_cleaners(spark, sf_dir):
    """Bundle, relation and mention texts made from benchmark items, and the file names and keys of their documents."""
    b = table(spark, sf_dir, "benchmark")
    t = F.concat(F.lit("[See]("), F.lit("http://x/"), F.col("item_id"), F.lit(")  "), F.col("text"), F.lit(" (Citation: A 1)  https://y/z end"))
    name = F.concat(F.lit("Rep:ort/"), F.col("item_id"), F.lit("?.pdf "))
    return b.select(
        "item_id", F.md5(E.clean_bundle_text(t)).alias("bundle_md5"), F.md5(E.clean_relation_text(t)).alias("relation_md5"), F.md5(E.clean_mention_text(t)).alias("mention_md5"), E.safe_filename(name).alias("file"),
        E.document_key(name, F.when(F.col("item_id") % 3 == 0, F.md5("text")).otherwise(F.lit(""))).alias("document"), E.preview_name(F.concat(F.lit("T1 — "), F.upper(F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0)), F.lit(": more"))).alias("name"),
    )


def chunk_relevance(spark, sf_dir):
    """Conversations as chunks: dense in telling terms, or holding a keyword."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("s"))
    sentences = E.trimmed_sentences(F.col("s"))
    return c.select("conv_id", F.size(sentences).cast("long").alias("n"), E.word_count(F.array_join("s", " ")).cast("long").alias("words"), E.is_dense(F.col("s"), 0.005, 200).alias("dense"), E.has_keyword(F.col("s")).alias("keyword"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(values: dict[str, str], x: str, other: str | None = None) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + f" ELSE {other or x} END"


_T, _C, _I, _D = r"(?i)\bT\d{4}(?:\.\d{3})?\b", r"(?i)\bCVE-\d{4}-\d{4,7}\b", E.IPV4, r"(?i)\b(?:[a-z0-9-]{1,63}\.)+[a-z]{2,63}\b"
_ENDS = "(" + "|".join(e.replace(".", r"\.") for e in E.EXTENSIONS) + ")$"
_N = f"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN p_name ELSE {_list(_NAMES)}[p_partkey % {len(_NAMES)} + 1] END AS name, {_list(_KINDS)}[p_partkey // 3 % {len(_KINDS)} + 1] AS kind, {_list(_VERBS)}[p_partkey % {len(_VERBS)} + 1] AS verb FROM part),
    m AS (SELECT *, trim(name, ' ') AS s, {_case(E.TYPE_ALIASES, "trim(lower(kind), ' ')")} AS k, trim(regexp_replace(lower(verb), '\\s+', ' ', 'g'), ' ') AS v FROM n),
    i AS (SELECT *, CASE WHEN regexp_matches(s, '{_T}') THEN 'attack-pattern' WHEN regexp_matches(s, '{_C}') THEN 'vulnerability' WHEN regexp_matches(s, '{_I}') OR regexp_matches(s, '{_D}') THEN 'infrastructure' END AS implicit,
        regexp_replace(lower(regexp_replace(trim(regexp_replace(s, '["''`]', '', 'g'), ' '), '\\s+', ' ', 'g')), '{_ENDS}', '') AS base FROM m)"""
_HINTED = " ".join(f"WHEN regexp_matches(lower(s), '{words}') THEN '{kind}'" for kind, words in E.HINTS)
_CLEAN = r"trim(regexp_replace({}, '[\s\x{{a0}}]+', ' ', 'g'), ' ')"

QUERIES = {f.__name__: f for f in (entity_labels, triple_keys, link_targets, text_cleaners, chunk_relevance)}
ORACLE = {
    "entity_labels": _N + f""" SELECT p_partkey, CASE WHEN name = '' THEN '' WHEN regexp_matches(s, '{_T}') THEN upper(regexp_extract(s, '{_T}', 0)) WHEN regexp_matches(s, '{_C}') THEN upper(regexp_extract(s, '{_C}', 0))
        WHEN coalesce(nullif(k, ''), implicit, '') = 'infrastructure' THEN string_split(regexp_replace(lower(s), '^https?://', ''), '/')[1] ELSE {_case(E.NAME_ALIASES, 'base')} END AS label,
        CASE WHEN implicit IS NOT NULL THEN implicit {_HINTED} ELSE 'identity' END AS inferred, implicit, k AS kind, CASE WHEN verb = '' THEN 'uses' ELSE {_case(E.PREDICATES, 'v', f"CASE WHEN list_contains({_list(E.RELATIONS)}, v) THEN v ELSE 'related-to' END")} END AS predicate FROM i""",
    "triple_keys": _N + f""" SELECT regexp_replace(trim(lower(name), ' '), '[\\s\\-_]+', ' ', 'g') AS subject, {_case({'executes': 'uses', 'leverages': 'uses', 'employs': 'uses'}, "trim(lower(verb), ' ')")} AS predicate,
        CASE WHEN verb = '' THEN 'related-to' ELSE replace(replace(trim(lower(verb), ' '), ' ', '-'), '_', '-') END AS canonical,
        CASE WHEN kind = '' THEN 'unknown' ELSE {_case({'org': 'organization'}, "replace(lower(kind), ' ', '-')")} END AS type, count(*) AS n FROM n GROUP BY ALL""",
    "link_targets": f"""WITH p AS (SELECT p_partkey AS k, {_list(_URLS)}[p_partkey % {len(_URLS)} + 1] AS u FROM part), f AS (SELECT k, regexp_extract(u, '{E.LINK}', ['kind', 'base', 'sub']) AS m FROM p),
        t AS (SELECT k, CASE lower(m.kind) WHEN 'techniques' THEN 'technique' WHEN 'software' THEN 'software' WHEN 'tactics' THEN 'tactic' WHEN 'groups' THEN 'group' END AS kind, CASE WHEN m.kind = '' THEN NULL WHEN lower(m.kind) = 'techniques' AND m.sub <> '' THEN upper(m.base) || '.' || m.sub ELSE upper(m.base) END AS id FROM f)
        SELECT kind, id, CASE WHEN id LIKE 'TA%' THEN 'TACTIC' WHEN id LIKE 'T%.%' THEN 'SUB_TECHNIQUE' WHEN id LIKE 'T%' THEN 'TECHNIQUE' WHEN id LIKE 'S%' THEN 'SOFTWARE' WHEN k % 3 = 0 THEN 'GROUP' WHEN k % 7 = 0 THEN 'CAMPAIGN' ELSE 'UNKNOWN' END AS type, count(*) AS n FROM t GROUP BY ALL""",
    "text_cleaners": rf"""WITH t AS (SELECT item_id, text, '[See](http://x/' || item_id || ')' || chr(160) || ' ' || text || ' (Citation: A 1)  https://y/z end' AS t, 'Rep:ort/' || item_id || '?.pdf ' AS n FROM benchmark)
        SELECT item_id, md5(trim(regexp_replace('See' || chr(160) || ' ' || text || '   end', '\s+', ' ', 'g'), ' ')) AS bundle_md5, md5(trim(regexp_replace('See' || chr(160) || ' ' || text || '   https://y/z end', '\s+', ' ', 'g'), ' ')) AS relation_md5,
        md5(trim(regexp_replace('See  ' || text || ' (Citation: A 1)  https://y/z end', '\s+', ' ', 'g'), ' ')) AS mention_md5, 'Rep_ort_' || item_id || '_.pdf ' AS file, CASE WHEN item_id % 3 = 0 THEN md5(text) ELSE sha256('rep:ort/' || item_id || '?.pdf') END AS document,
        nullif(upper(w[1][1:1]) || lower(w[1][2:]) || CASE WHEN len(w) > 1 THEN ' ' || upper(w[2][1:1]) || lower(w[2][2:]) ELSE '' END, '') AS name FROM (SELECT *, string_split(regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0), ' ') AS w FROM t)""",
    "chunk_relevance": rf"""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS s FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, s, array_to_string(s, ' ') AS b FROM c), w AS (SELECT *, len(regexp_extract_all(b, '\w+')) AS words FROM b)
        SELECT conv_id, len(list_filter(s, lambda x: length(trim(x, ' ')) >= 3)) AS n, words, trim(b, ' ') <> '' AND (len(regexp_extract_all(b, '{E.TERMS}')) / greatest(1, words) >= 0.005 OR words >= 200) AS dense, {" OR ".join(f"contains(lower(b), '{k}')" for k in E.KEYWORDS)} AS keyword FROM w""",
}
