"""A store of graph nodes as tables: constraints, labels, embeddings, what a similarity index holds, and deletion.

nodes: id, doc_id, name, type, labels (array) and, where they have one, embedding (array of doubles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTORIZED = "Vectorized"  # fixed value: the label of nodes with an embedding


def violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once, with their count; none where the constraint holds. Null parts are values like others."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows, if key is unique in them; raises ValueError with an example otherwise."""
    bad = violations(rows, key).head(1)
    if bad:
        raise ValueError(f"{key} is not unique: {bad[0].asDict()}")
    return rows


def cleared(nodes: DataFrame, documents: DataFrame, edges: DataFrame, also_documents: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The store without entities and without any edge of theirs, and without documents if asked. edges: (src, dst)."""
    gone = nodes.select("id")
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(gone.withColumnRenamed("id", end), end, "left_anti")
    if also_documents:
        for end in ("src", "dst"):
            kept = kept.join(documents.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.limit(0), documents.limit(0) if also_documents else documents, kept.select("src", "dst")


def node_text(name: Column, kind: Column, contexts: Column) -> Column:
    """What is embedded for a node: its name, type and sorted contexts, a line each."""
    lines = F.array_join(F.array_sort(F.coalesce(contexts, F.array().cast("array<string>"))), "\n")
    return F.trim(F.concat(F.lit("name: "), name, F.lit("\ntype: "), F.coalesce(kind, F.lit("")), F.lit("\ncontexts:\n"), lines))


def unit_vector(v: Column) -> Column:
    """v scaled to length one; a zero vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def with_embeddings(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """nodes with the unit vectors of vectors(id, embedding) and the label that says so; others keep what they have."""
    own = vectors.select("id", unit_vector(F.col("embedding").cast("array<double>")).alias("_v"))
    old = F.col("embedding") if "embedding" in nodes.columns else F.lit(None).cast("array<double>")
    rows = nodes.withColumn("embedding", old).join(own, "id", "left")
    labels = F.when(F.col("_v").isNotNull(), F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.array(F.lit(VECTORIZED)))).otherwise(F.col("labels"))
    return rows.withColumns({"labels": labels, "embedding": F.coalesce("_v", "embedding")}).drop("_v")


def vector_dimension(nodes: DataFrame) -> int:
    """Length of the embeddings; ValueError if there are none or they differ."""
    low, high = nodes.where("embedding is not null").agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low is None or low != high:
        raise ValueError("no embeddings to infer a dimension from" if low is None else f"embeddings of {low} and of {high} numbers")
    return low


def without_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.withColumn("labels", F.array_remove("labels", label))


def with_label(nodes: DataFrame, label: str, allowed: list[str]) -> DataFrame:
    """Marks the nodes that have an embedding and one of the allowed labels, once."""
    if not allowed:
        raise ValueError("allowed labels must not be empty")
    fit = F.col("embedding").isNotNull() & F.arrays_overlap("labels", F.array(*[F.lit(x) for x in allowed]))
    return nodes.withColumn("labels", F.when(F.coalesce(fit, F.lit(False)), F.array_union("labels", F.array(F.lit(label)))).otherwise(F.col("labels")))


def vector_index(nodes: DataFrame, label: str, path: str, parts: int = 64) -> DataFrame:
    """What a similarity search reads: id, name, labels and unit vectors of the labelled nodes, written in buckets by a hash of the id and read back,
    so a search scans two columns. Written over if it is there."""
    dimension = vector_dimension(nodes.where(F.array_contains("labels", label)))
    rows = nodes.where(F.array_contains("labels", label) & F.col("embedding").isNotNull()).select("id", "name", "labels", unit_vector(F.col("embedding")).alias("embedding"), F.lit(dimension).alias("dimension"))
    rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return nodes.sparkSession.read.parquet(path)


def sources(nodes: DataFrame, mentions: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Nodes with an embedding that mentions(doc_id, id) names, of one document or of all."""
    own = mentions if doc_id is None else mentions.where(F.col("doc_id") == doc_id)
    return nodes.drop("doc_id").where("embedding is not null").join(own.select("doc_id", "id").distinct(), "id")


def id_scores(found: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """found(by, id) against gold(by, id), trimmed and upper-cased, as sets: matched, missed and spurious ids, precision, recall and F1 per report."""
    own = lambda df, tag: df.select(by, F.upper(F.trim("id")).alias("id")).where("id <> ''").distinct().withColumn(tag, F.lit(1))
    j = own(found, "f").join(own(gold, "g"), [by, "id"], "full_outer")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    f, g = F.col("f").isNotNull(), F.col("g").isNotNull()
    rows = j.groupBy(by).agg(listed(f & g).alias("matched"), listed(~f & g).alias("missed"), listed(f & ~g).alias("spurious"))
    m, n_f, n_g = F.size("matched"), F.size("matched") + F.size("spurious"), F.size("matched") + F.size("missed")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select(by, "matched", "missed", "spurious", F.round(share(m, n_f), 4).alias("precision"), F.round(share(m, n_g), 4).alias("recall"), F.round(share(2 * m, n_f + n_g), 4).alias("f1"))
