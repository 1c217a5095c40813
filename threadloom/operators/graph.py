"""Node, edge and mention tables under idempotent upserts, reachability and taxonomies, event neighbours, BIO spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.session import written


def nodes_of(triples: DataFrame) -> DataFrame:
    """Nodes of triples(seq, subject, subject_type, object, object_type, context): the first name and type win, contexts are a set."""
    side = lambda n, t: triples.select("seq", F.col(n).alias("name"), F.col(t).alias("type"), "context")
    rows = side("subject", "subject_type").union(side("object", "object_type")).where("trim(coalesce(name, '')) <> ''")
    rows = rows.withColumn("id", X.node_id(F.col("type"), F.col("name")))
    return rows.groupBy("id").agg(F.min_by("name", "seq").alias("name"), F.min_by("type", "seq").alias("type"), F.array_sort(F.collect_set("context")).alias("contexts"))


def edges_of(triples: DataFrame) -> DataFrame:
    """Distinct (source, relation, target)."""
    return triples.where("trim(coalesce(subject, '')) <> '' and trim(coalesce(object, '')) <> ''").select(
        X.node_id(F.col("subject_type"), F.col("subject")).alias("source"), X.relation_type(F.col("predicate")).alias("relation"), X.node_id(F.col("object_type"), F.col("object")).alias("target")
    ).distinct()


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old properties win, contexts are united; applying the same batch again changes nothing."""
    n = new.select("id", *[F.col(c).alias(f"_{c}") for c in ("name", "type", "contexts")])
    none = F.array().cast("array<string>")
    return old.join(n, "id", "full_outer").select(
        "id", F.coalesce("name", "_name").alias("name"), F.coalesce("type", "_type").alias("type"),
        F.array_sort(F.array_union(F.coalesce("contexts", none), F.coalesce("_contexts", none))).alias("contexts"),
    )


def reach(seeds: DataFrame, edges: DataFrame, most_sweeps: int = 50, folder: str | None = None) -> DataFrame:
    """Nodes reachable from seeds(node) over edges(src, dst), with their distance. Each sweep joins only the last frontier.

    Every sweep is written to a shared folder and read again, so lineage doesn't grow with the sweeps and a lost executor costs one.
    """
    cut = lambda df: written(df, "reach", folder)
    edges = cut(edges.select("src", "dst"))
    found = cut(seeds.select("node").distinct().withColumn("distance", F.lit(0)))
    front = found
    for sweep in range(1, most_sweeps + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(sweep)))
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def expand(predictions: DataFrame, parent: DataFrame) -> DataFrame:
    """predictions(query, id) and their parents(id, parent), one hop."""
    up = predictions.join(parent, "id").select("query", F.col("parent").alias("id"))
    return predictions.select("query", "id").union(up).where("id is not null").distinct()


def error_class(predicted: Column, gold: Column) -> Column:
    """The nearest explanation of a wrong id against an array of gold ids, in order: tactic or technique, granularity, sibling, nearby number, unrelated."""
    is_tactic = predicted.startswith("TA")
    any_tactic, any_technique = F.exists(gold, lambda g: g.startswith("TA")), F.exists(gold, lambda g: g.startswith("T1"))
    base = lambda x: F.substring_index(x, ".", 1)
    dotted = lambda x: x.contains(".")
    number = lambda x: F.expr("1") * F.regexp_extract(x, r"^T+(\d+)", 1).try_cast("int")
    t = lambda x: x.startswith("T")
    grain = F.exists(gold, lambda g: t(predicted) & t(g) & (dotted(predicted) != dotted(g)) & (base(predicted) == base(g)))
    sibling = F.exists(gold, lambda g: dotted(predicted) & dotted(g) & (base(predicted) == base(g)))
    nearby = F.exists(gold, lambda g: t(predicted) & t(g) & F.coalesce(F.abs(number(predicted) - number(g)) <= 5, F.lit(False)))
    return (
        F.when((is_tactic & ~any_tactic) | (~is_tactic & any_tactic & ~any_technique), "TACTIC_VS_TECHNIQUE").when(grain, "WRONG_GRANULARITY")
        .when(sibling, "SIBLING_TECHNIQUE").when(nearby, "NEARBY_TECHNIQUE").otherwise("UNRELATED")
    )


def neighbour_pairs(events: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Each value with the next and the one after it in its group."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = events.select(by, *order, F.col(value).alias("a"), F.lead(value, 1).over(w).alias("n1"), F.lead(value, 2).over(w).alias("n2"))
    return rows.select(by, *order, "a", F.explode(F.array("n1", "n2")).alias("b")).where("b is not null")


def bio_spans(tags: DataFrame, by: str, order: str) -> DataFrame:
    """Spans of tags(by, order, token, tag), tags B-x, I-x or O: an I of another type, or after O, starts a span."""
    w = Window.partitionBy(by).orderBy(order)
    kind = F.regexp_extract("tag", r"^[BI]-(.*)$", 1)
    rows = tags.withColumn("kind", kind).withColumn("before", F.lag("tag").over(w)).withColumn("was", F.lag(kind).over(w))
    starts = (F.col("tag") != "O") & (F.col("tag").startswith("B-") | F.col("before").isNull() | (F.col("before") == "O") | (F.col("was") != F.col("kind")))
    rows = rows.withColumn("span", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("tag <> 'O'")
    return rows.groupBy(by, "span").agg(F.first("kind").alias("kind"), F.min(order).alias("first"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "token"))), lambda x: x["token"]), " ").alias("text"))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a map-side aggregate rather than a window, so a hot key costs nothing."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def exact_quorum(rows: DataFrame, key: list[str], voter: str, m: int, distinct_voters: bool) -> DataFrame:
    """Keys with at least m votes; a voter's repeats count once if asked for."""
    n = F.count_distinct(voter) if distinct_voters else F.count("*")
    return rows.groupBy(*key).agg(n.alias("votes")).where(F.col("votes") >= m)


# Types of tag names, names of integer tags.
TAG_TYPES = {"ORG": "identity", "LOC": "location", "TOOL": "tool", "MALWARE": "malware", "TECHNIQUE": "attack-pattern", "TACTIC": "tactic", "SECTOR": "identity"}
TAG_NAMES = ("O", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-TOOL", "I-TOOL", "B-MALWARE", "I-MALWARE", "B-TECHNIQUE", "I-TECHNIQUE", "B-TACTIC", "I-TACTIC", "B-SECTOR", "I-SECTOR")
# End of fixed values.


def tag_type(tag: Column) -> Column:
    """Entity type of a B- or I- tag by its name; null for others."""
    return X.lookup(F.regexp_extract(F.upper(F.coalesce(tag, F.lit("O"))), "^[BI]-(.+)$", 1), TAG_TYPES, F.lit(None).cast("string"))


def named_tags(tags: Column, names: tuple[str, ...] = TAG_NAMES) -> Column:
    """Integer tags as names, unknown ones as O."""
    return F.transform(tags, lambda t: F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), F.when(t >= 0, t.cast("int"))), F.lit("O")))


def checked_tags(tags: Column) -> Column:
    """Tags if all are O or B-/I- and letters, else null; null for none."""
    return F.when((F.size(tags) > 0) & F.forall(tags, lambda t: F.coalesce((t == "O") | t.rlike("^[BI]-[A-Za-z]+$"), F.lit(False))), tags)


def plain_entities(tokens: Column, codes: Column) -> Column:
    """Spans of codes 1 (begins) and 2 (goes on): array of (text, start, end), end exclusive. A 2 without a span before it is none."""
    begins = F.filter(F.transform(codes, lambda c, i: F.when(c == 1, i)), lambda i: i.isNotNull())
    last = lambda i: F.aggregate(F.sequence(i + 1, F.greatest(F.size(codes) - 1, i + 1)), F.struct(i.alias("end"), F.lit(True).alias("on")), lambda a, k: F.struct(F.when(a["on"] & F.coalesce(F.get(codes, k) == 2, F.lit(False)), k).otherwise(a["end"]).alias("end"), (a["on"] & F.coalesce(F.get(codes, k) == 2, F.lit(False))).alias("on")))["end"]
    return F.transform(begins, lambda i: F.struct(F.array_join(F.slice(tokens, i + 1, last(i) - i + 1), " ").alias("text"), i.alias("start"), (last(i) + 1).alias("end")))
