"""Queries of the operators that label documents: licences and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import licenses, weak_quality
from threadloom.llm.common import read


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or its directory's.

    A document's path is thousands/hundreds/id; the first five of a hundred are licence files of their folder, the last five of a thousand those of
    the folder above."""
    docs = read(spark, sf_dir, "documents")
    upto, last = lambda n: F.floor(F.col("doc_id") / n).cast("string"), F.pmod("doc_id", F.lit(1000))
    folder = F.when(last >= 995, upto(1000)).otherwise(F.concat(upto(1000), F.lit("/"), upto(100)))
    path = F.concat(folder, F.when((last % 100 < 5) | (last >= 995), "/LICENSE-").otherwise("/"), F.col("doc_id").cast("string"))
    found = licenses.license_scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return found.select(F.col("file_id").alias("doc_id"), "path", "license", "similarity", "how", "from_path")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document and whether it is kept."""
    found = weak_quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.round("score", 6).alias("score"), "keep")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TERM = r"[\p{L}\p{N}]+(?:\.[\p{N}]+){0,8}"
_TEMPLATES = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.TEMPLATES)
_MARK = licenses.MARK.replace(r"\n", "\n").replace(r"\t", "\t")
_FLAT = "trim(regexp_replace({}, '[ \t\n]+', ' ', 'g'), ' ')"
_LICENSES_SQL = rf"""WITH n AS (SELECT row_number() OVER () AS rid, doc_id, (doc_id // 1000)::VARCHAR AS high, (doc_id // 100)::VARCHAR AS low, doc_id % 1000 >= 995 AS at_high, doc_id % 100 < 5 OR doc_id % 1000 >= 995 AS named, coalesce(text, '') AS text FROM documents),
d AS (SELECT *, CASE WHEN at_high THEN high ELSE high || '/' || low END AS folder, CASE WHEN at_high THEN [high, ''] ELSE [high || '/' || low, high, ''] END AS above, CASE WHEN at_high THEN high ELSE high || '/' || low END || CASE WHEN named THEN '/LICENSE-' ELSE '/' END || doc_id AS path FROM n),
t(license, unit) AS (SELECT DISTINCT * FROM (VALUES {_TEMPLATES})),
tt AS (SELECT license, unit, term, 1 + ln(count(*)) AS tf FROM (SELECT license, unit, unnest(regexp_extract_all(lower(unit), '{_TERM}')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT license, unit AS template, term, tf * idf AS w FROM tt JOIN idf USING (term)), tl AS (SELECT license, template, sqrt(sum(w * w)) AS length FROM tw GROUP BY ALL),
p AS (SELECT rid, path, folder, named, regexp_replace(chr(10) || replace(text, chr(13), ''), '{_MARK}', chr(10), 'g') AS plain FROM d WHERE regexp_matches(text, '{licenses.CUE}')),
u AS (SELECT rid, path, folder, named, {_FLAT.format('plain')} AS whole, list_append(string_split(plain, chr(10)) || string_split_regex(plain, '\n\n+'), plain) AS parts FROM p),
l AS (SELECT *, unit = whole AS is_whole FROM (SELECT rid, path, folder, named, whole, k, {_FLAT.format('parts[k]')} AS unit FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM u)) WHERE regexp_matches(unit, '{licenses.CUE}')),
ut AS (SELECT unit, term, 1 + ln(count(*)) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '{_TERM}')) AS term FROM (SELECT DISTINCT unit FROM l)) GROUP BY ALL),
uw AS (SELECT unit, term, tf * coalesce(idf, ln(1.0::DOUBLE + (SELECT count(*) FROM t)) + 1) AS w FROM ut LEFT JOIN idf USING (term)), ul AS (SELECT unit, sqrt(sum(w * w)) AS size FROM uw GROUP BY unit),
s AS (SELECT unit, license, template, sum(uw.w * tw.w) AS dot FROM uw JOIN tw USING (term) GROUP BY ALL),
b AS (SELECT unit, min({{'s': -similarity, 'l': license}}) AS b FROM (SELECT unit, license, round(dot / (size * length), 6) AS similarity FROM s JOIN ul USING (unit) JOIN tl USING (license, template)) WHERE similarity >= {licenses.SIMILARITY} GROUP BY unit),
m AS (SELECT rid, path, folder, min({{'x': b.l = '{licenses.WEAK}', 's': b.s, 'k': k, 'l': b.l}}) AS m, min({{'x': b.l = '{licenses.WEAK}', 's': b.s, 'k': k, 'l': b.l}}) FILTER (named OR (is_whole AND -b.s >= {licenses.WHOLE})) AS w FROM l JOIN b USING (unit) GROUP BY ALL),
f AS (SELECT folder, array_to_string(list_sort(list(DISTINCT w.l)), ' AND ') AS license, min(-w.s) AS similarity, min(path) AS path FROM m WHERE w IS NOT NULL GROUP BY folder),
a AS (SELECT rid, unnest(above) AS folder, unnest(range(len(above))) AS up FROM d), i AS (SELECT rid, arg_min({{'l': license, 's': similarity, 'p': path}}, up) AS i FROM a JOIN f USING (folder) GROUP BY rid)
SELECT doc_id, d.path, coalesce(m.m.l, i.i.l) AS license, coalesce(-m.m.s, i.i.s) AS similarity, CASE WHEN m.m IS NOT NULL THEN 'own' WHEN i.i IS NOT NULL THEN 'inherited' END AS how, CASE WHEN m.m IS NOT NULL THEN d.path ELSE i.i.p END AS from_path
FROM d LEFT JOIN m USING (rid) LEFT JOIN i USING (rid)"""

QUERIES = {"op4_license_scan": op4_license_scan, "op8_quality_classifier": op8_quality_classifier}
ORACLE: dict[str, str] = {"op4_license_scan": _LICENSES_SQL}
