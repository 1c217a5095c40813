"""Seed-and-force propagation over typed triples: what is confident by itself, and what hangs together with it over compatible edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import reach
from threadloom.session import written

# Confidences from which nodes and edges are forced by themselves, the least confidence of what is forced, guarded predicates.
NODE_SEED, EDGE_SEED, FORCED = 0.80, 0.75, 0.9
GUARDS = {
    "uses": ("malware tool threat-actor intrusion-set", "attack-pattern tool infrastructure malware"),
    "exploits": ("malware tool threat-actor", "vulnerability"),
    "indicates": ("indicator", "malware tool attack-pattern campaign intrusion-set"),
}
# End of fixed values.


def compatible(s_type: Column, predicate: Column, o_type: Column) -> Column:
    """Guarded predicates ask for types; the others fit anything."""
    out = F.lit(True)
    for p, (domain, ranges) in GUARDS.items():
        out = F.when(predicate == p, F.coalesce(s_type.isin(domain.split()) & o_type.isin(ranges.split()), F.lit(False))).otherwise(out)
    return out


def node_label(name: Column, kind: Column) -> Column:
    """Lower case, collapsed, a trailing s off words of four letters or more, with the type."""
    base = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    stem = F.when((F.length(base) > 3) & base.endswith("s"), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
    return F.concat_ws("::", stem, kind)


def run(triples: DataFrame, most_sweeps: int = 50, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """triples(seq, s_name, s_type, s_confidence, predicate, o_name, o_type, o_confidence, confidence) -> nodes and edges.

    A node has the name of its first record and the largest confidence of its records; the last record of an edge wins, and edges that aren't
    compatible drop out. Nodes of confidence NODE_SEED and compatible edges of confidence EDGE_SEED are forced by themselves; forced nodes force
    their compatible edges, and forced edges both their ends, until nothing changes or ``most_sweeps`` are done. What is forced has
    confidence FORCED at least. Null confidences count as one half.

    nodes: node, name, type, forced, confidence; edges: source, predicate, target, state ('seed', 'forced' or 'kept'), confidence.
    """
    half = lambda c: F.coalesce(F.col(c), F.lit(0.5))
    rows = triples.withColumns({"source": node_label(F.col("s_name"), F.col("s_type")), "target": node_label(F.col("o_name"), F.col("o_type")), "confidence": half("confidence")})
    last = F.struct("s_type", "o_type", "confidence")
    edges = rows.groupBy("source", "predicate", "target").agg(F.max_by(last, "seq").alias("e")).select("source", "predicate", "target", "e.*")
    edges = edges.where(compatible(F.col("s_type"), F.col("predicate"), F.col("o_type"))).withColumn("seed", F.col("confidence") >= EDGE_SEED)
    edges = written(edges, "propagate", folder)
    side = lambda node, tag, place: rows.select(F.col(node).alias("node"), F.struct((2 * F.col("seq") + place).alias("k"), F.col(f"{tag}_name").alias("name"), F.col(f"{tag}_type").alias("type")).alias("first"), half(f"{tag}_confidence").alias("c"))
    nodes = side("source", "s", 0).union(side("target", "o", 1)).groupBy("node").agg(F.min("first").alias("f"), F.max("c").alias("c"))
    nodes = written(nodes, "propagate", folder)
    sure = edges.where("seed")
    start = nodes.where(F.col("c") >= NODE_SEED).select("node").union(sure.select("source")).union(sure.select("target")).distinct()
    links = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    reached = reach(start, links.union(links.select("dst", "src")).distinct(), most_sweeps, folder).select("node", F.lit(True).alias("forced"))
    raised = lambda c, forced: F.when(forced, F.greatest(c, F.lit(FORCED))).otherwise(c)
    found = nodes.join(reached, "node", "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    # an edge with one reached end has both ends reached
    out = edges.join(reached.withColumnRenamed("node", "source"), "source", "left")
    state = F.when(F.col("seed"), "seed").when(F.col("forced"), "forced").otherwise("kept")
    return (
        found.select("node", F.col("f.name").alias("name"), F.col("f.type").alias("type"), "forced", raised(F.col("c"), F.col("forced")).alias("confidence")),
        out.select("source", "predicate", "target", state.alias("state"), raised(F.col("confidence"), state != "kept").alias("confidence")),
    )
