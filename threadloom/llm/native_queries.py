"""Queries of the two native operators, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import quality_rules, secrets
from threadloom.llm.common import read


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, from a fresh ledger; base spans are those of the three base kinds."""
    found = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = len(secrets.BASE_RULES)
    base = F.filter("spans", lambda s: s["rank"] < n)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document under thresholds adapted to its language and source."""
    judged = quality_rules.quality(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _kind_sql(rank: int, rule) -> str:
    kind, _, pattern, group, least = rule
    # RE2 folds some letters beyond ASCII under (?i), so the keywords are spelt out here
    for word in ("password", "passwd", "secret", "token", "api", "key"):
        pattern = pattern.replace(word, "".join(f"[{c.upper()}{c}]" for c in word)) if pattern.startswith("(?i)") else pattern
    pattern = pattern.removeprefix("(?i)").replace("'", "''")
    measured = "m[i]" if not group else f"regexp_extract(m[i], '{pattern}', {group})"
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, starts[i] AS s, starts[i] + length(m[i]) AS e FROM (
        SELECT rid, m, i, list_transform(range(1, len(m) + 1), lambda k: list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0))::BIGINT[] AS starts,
        FROM (SELECT rid, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t) WHERE len(m) > 0))
        WHERE length({measured}) >= {least}"""


_N = len(secrets.BASE_RULES)
_SECRETS_SQL = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_kind_sql(k, r) for k, r in enumerate(secrets.RULES))}),
per AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {_N}), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM found GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN per USING (rid)"""

_SPACE = r"[\x20\x09-\x0D]+"
_RULE_ROWS = " UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{rule}' AS rule, CASE WHEN {size} > 0 THEN (1000 * {part}) // {size} ELSE 0 END AS value FROM b" for rule, (part, size, _) in quality_rules.RULES.items())
_SIZE_ROWS = " UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{size}', {size} FROM b" for size in quality_rules.SIZES)
_SIZE_OF = ", ".join(f"('{rule}', '{size}', {error})" for rule, (_, size, error) in quality_rules.RULES.items())


def _cutoffs_sql(by: str) -> str:
    keys = by.split(", ")
    same = " AND ".join(f"q.{k} = z.{k}" for k in keys)
    return f"""WITH q AS (SELECT {by}, rule, max(total) AS n, min(bucket) FILTER (upto * 100 >= total * 25) AS q25, min(bucket) FILTER (upto * 100 >= total * 50) AS q50
        FROM (SELECT {by}, rule, bucket, sum(n) OVER (PARTITION BY {by}, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}, rule) AS total
              FROM (SELECT {by}, rule, bucket, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL)) GROUP BY {by}, rule)
        SELECT {", ".join(f"q.{k}" for k in keys)}, q.rule, q.n::BIGINT AS n, (q.q50 + {quality_rules.SPREADS} * greatest(q.q50 - q.q25, floor(err / sqrt(greatest(z.q50, 1)::DOUBLE))))::BIGINT AS lim
        FROM q JOIN (VALUES {_SIZE_OF}) r(name, size, err) ON q.rule = r.name JOIN q z ON {same} AND z.rule = r.size"""


_QUALITY_SQL = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '?null') AS lang, coalesce(source, '?null') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
grams AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM grams SEMI JOIN (SELECT rid, g FROM grams GROUP BY rid, g HAVING count(*) > 1) USING (rid, g)),
cover AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
s AS (SELECT doc_id, lang, source, rid, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM t JOIN w USING (rid) LEFT JOIN cover USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
v AS ({_RULE_ROWS}), sizes AS ({_SIZE_ROWS}),
sketch AS (SELECT lang, source, 0 AS every, rule, value - value % (1::BIGINT << greatest(length(bin(value)) - 6, 0)) AS bucket, count(*) AS n FROM (FROM v UNION ALL FROM sizes) WHERE NOT base_failed GROUP BY ALL),
own AS ({_cutoffs_sql("lang, source")}), bylang AS ({_cutoffs_sql("lang")}), byall AS ({_cutoffs_sql("every")}),
above AS (SELECT bylang.lang, bylang.rule, (bylang.n * bylang.lim + {quality_rules.PRIOR} * byall.lim) // (bylang.n + {quality_rules.PRIOR}) AS lim FROM bylang JOIN byall USING (rule)),
lims AS (SELECT own.lang, own.source, own.rule, (own.n * own.lim + {quality_rules.PRIOR} * above.lim) // (own.n + {quality_rules.PRIOR}) AS lim FROM own JOIN above USING (lang, rule)),
bad AS (SELECT DISTINCT rid FROM v JOIN lims USING (lang, source, rule) WHERE value > lim)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM b LEFT JOIN bad USING (rid)"""

QUERIES = {"op7_secret_scan": op7_secret_scan, "op10_quality_rules": op10_quality_rules}
ORACLE = {"op7_secret_scan": _SECRETS_SQL, "op10_quality_rules": _QUALITY_SQL}
