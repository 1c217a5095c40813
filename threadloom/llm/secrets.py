r"""Secret scans over a blob ledger (native: DataFrame functions only).

Every historical version of every path is addressed by the SHA-256 of its content. A ledger table in the shared
folder holds a row for each (blob, rule version) that was ever scanned; a run scans only the pairs that it lacks,
once per content however many paths hold it, appends them, and joins the findings back to all paths.

Copies meet map-side first (one row per content leaves a task), so a content that fills a third of all rows is a
row per map task, not a hot partition, and findings go back to the paths of such a content without a shuffle. Positions come
from splitting a text by the same pattern that extracts the matches: a window adds the lengths of gaps and matches up, in
code points, so time grows with a text's length and matches, not with their product.

Defined results: null text is empty (no finding); null ids, repeated rows and equal texts under one id each keep
their row; very long texts and any number of matches are scanned whole; spans that start together go by kind in the order
listed; an empty table gives an empty result; other columns are ignored by ``find_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import checked_broadcast, let, materialise, shared_dir, text_of, with_facts
from threadloom.session import forget_at_exit

# Kinds in their sort order, with the literals (lower case) of which one must occur, the pattern,
# the group that is measured and its least length.
BASE_RULES = (
    ("assign", ("passw", "secret", "token", "api"), r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", ("akia",), r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", (), r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    ("private_key", ("private key",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("code_host", ("gh",), r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", ("xox",), r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", ("eyj",), r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36),
)
RULES = BASE_RULES + MORE_RULES
# What is scanned for a kind instead of its rule's pattern, which the SQL holds. A private key is its BEGIN line and what
# follows up to the END line; if that is missing, headers and the run of base64, with a last short line that has nothing else.
_KEY_GAP, _BASE64 = r"""(?:[\s>#*"',]|\\[nr])*+""", "[A-Za-z0-9+/=]"
_KEY_HEADERS = rf"(?:{_KEY_GAP}(?:Proc-Type|DEK-Info|Content-Domain|Key-Info):[^\n\\]*+)*+"
_KEY_RUN = rf"(?:{_KEY_GAP}{_BASE64}{{20,}}+)*+(?:\x20*+(?:\r?\n|\\n){_KEY_GAP}{_BASE64}++(?=[\x20\t]*(?:[\r\n\\\"']|\z)))?+"
WIDER = {"private_key": rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|{_KEY_HEADERS}{_KEY_RUN})"}
#: Changes whenever a rule does: pairs of another version are scanned again.
RULE_VERSION = hashlib.sha256(repr((RULES, sorted(WIDER.items()))).encode()).hexdigest()[:16]
#: Code points in a block of a text that is redacted.
BLOCK = 1024
LEDGER = "blob_id string, rule_version string, spans array<struct<start:int,rank:int,end:int,kind:string>>"


def _matches(text: Column, lower: Column, rank: int, rule) -> Column:
    """Array of a rule's matches, leftmost and non-overlapping: their number, the length of the gap before and their own, and whether they pass."""
    kind, literals, pattern, group, least = rule
    pattern = WIDER.get(kind, pattern)
    row = "array<struct<rank:int,i:int,gap:int,size:int,passes:boolean>>"
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def match(z: Column, i: Column) -> Column:
        measured = z["m"] if not group else F.regexp_extract(z["m"], pattern, group)
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("size"), (F.length(measured) >= least).alias("passes"))

    # there is one gap more than matches
    matches = F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), match).cast(row)
    gate = F.lit(False)
    for x in literals:
        gate = gate | lower.contains(x)
    gate = gate & text.rlike(pattern) if literals else text.rlike(pattern)
    return F.when(gate, matches).otherwise(F.array().cast(row))


def scan(blobs: DataFrame) -> DataFrame:
    """(blob_id, text), a row per blob -> (blob_id, spans sorted by start, then kind)."""
    lowered = blobs.withColumn("_lower", F.lower("text"))
    found = lowered.select("blob_id", F.concat(*[_matches(F.col("text"), F.col("_lower"), k, rule) for k, rule in enumerate(RULES)]).alias("found"))
    rows = found.select("blob_id", F.explode_outer("found").alias("f")).select("blob_id", "f.*")
    upto = Window.partitionBy("blob_id", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int"))
    kind = F.element_at(F.array(*[F.lit(rule[0]) for rule in RULES]), F.col("rank") + 1)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "end", kind.alias("kind"))
    return rows.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.when(F.col("passes"), span))).alias("spans"))


def versions(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """(path, blob_id, text): the content address of each version of each path."""
    return docs.select(F.col(path), F.sha2(text_of(), 256).alias("blob_id"), text_of().alias("text"))


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger's rows, or None before its first run."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans the blobs that the ledger lacks for this rule version, appends them, and returns the ledger of that version.

    A run that was cut off leaves no rows (Spark's commit), and the next one scans the same pairs.
    """
    spark = docs.sparkSession
    blobs, ledger = versions(docs).select("blob_id", "text"), open_ledger(spark, path)
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob_id").distinct()
        unseen = blobs.select("blob_id").distinct().join(known, "blob_id", "left_anti")
        blobs = blobs.join(unseen, "blob_id", "left_semi")
    one_each = blobs.groupBy("blob_id").agg(F.first("text").alias("text"))
    scan(one_each).select("blob_id", F.lit(rule_version).alias("rule_version"), "spans").write.mode("append").parquet(path)
    return open_ledger(spark, path).where(F.col("rule_version") == rule_version)


def findings(docs: DataFrame, ledger_path: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """(blob_id, n, spans) of the blobs of docs, n rows of which hold each; without a path, from a fresh ledger in the shared folder."""
    path = ledger_path or f"{shared_dir(docs.sparkSession)}/secret-ledger-{uuid.uuid4().hex}"
    ledger = update_ledger(docs, path, rule_version)
    if not ledger_path:
        forget_at_exit(docs.sparkSession, path)
    held = versions(docs).groupBy("blob_id").agg(F.count("*").alias("n"))
    # two runs that overlapped may both have appended a blob
    return materialise(held.join(ledger, "blob_id").groupBy("blob_id").agg(F.first("n").alias("n"), F.first("spans").alias("spans")), "secret-findings")


def find_secrets(docs: DataFrame, ledger_path: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """(doc_id, blob_id, spans) for every row of docs."""
    rows = versions(docs).select("doc_id", "blob_id")
    return with_facts(rows, findings(docs, ledger_path, rule_version), "blob_id").select("doc_id", "blob_id", "spans")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def merged(found: DataFrame) -> DataFrame:
    """(blob_id, spans) -> (blob_id, cuts) of the blobs with spans; cuts are (start, after, end, kind) in order, overlapping spans as one, named
    after the first, ``after`` the end of the one before."""
    span = found.where(F.size("spans") > 0).select("blob_id", F.posexplode("spans").alias("k", "s"))
    order = Window.partitionBy("blob_id").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = span.select("blob_id", "k", "s.*").withColumn("after", F.coalesce(F.max("end").over(before), F.lit(0)))
    opened = opened.withColumn("cut", F.sum((F.col("start") >= F.col("after")).cast("int")).over(order))
    cuts = opened.groupBy("blob_id", "cut").agg(F.min("start").alias("start"), F.min_by("after", "k").alias("after"), F.max("end").alias("end"), F.min_by("kind", "k").alias("kind"))
    return cuts.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("start", "after", "end", "kind"))).alias("cuts"))


def _without(text: Column, cuts: Column) -> Column:
    """text with each cut replaced by ``[kind]``. The text is cut into blocks once, so that a piece doesn't walk it from its start."""

    def pieces(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            own = F.transform(F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")), lambda k: F.get(blocks, k))
            return F.when(b > a, F.substring(F.array_join(own, ""), a % BLOCK + 1, b - a)).otherwise("")

        kept = F.transform(cuts, lambda c: F.concat(piece(c["after"], c["start"]), F.lit("["), c["kind"], F.lit("]")))
        return F.concat(F.array_join(kept, ""), piece(F.element_at(cuts, -1)["end"], F.length(text)))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), pieces)


def redact(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """docs with every span of their text replaced by ``[kind]``; overlapping spans are replaced as one, named after the first.

    Columns stay; a null text stays null. Findings meet texts by content; texts are shuffled only if there are too many findings to broadcast.
    """
    found = findings(docs, ledger_path)
    cuts = materialise(merged(found), "secret-cuts")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    addressed = docs.select(row.alias("_row"), F.sha2(text_of(), 256).alias("blob_id"))
    few = checked_broadcast(cuts)
    if few is cuts:
        addressed = with_facts(addressed, found.select("blob_id", "n").join(cuts, "blob_id", "left"), "blob_id")
    else:
        addressed = addressed.join(few, "blob_id", "left")
    text = F.col("_row.text")
    redacted = F.when(F.col("cuts").isNotNull() & text.isNotNull(), _without(text, F.col("cuts"))).otherwise(text)
    return addressed.select(*[redacted.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
