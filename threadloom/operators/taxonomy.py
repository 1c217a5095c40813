"""Taxonomy tables from a bundle of STIX objects: cards, hierarchy, revocations, usage edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The source name and form of technique, tactic, software, group and mitigation ids.
SOURCE, ID_FORM = "mitre-attack", r"^(TA\d{4}|T\d{4}(\.\d{3})?|[SGM]\d{4})$"


def external_id(references: Column) -> Column:
    """The first external id of the source that has the form of one."""
    fits = F.filter(references, lambda r: (r["source_name"] == SOURCE) & r["external_id"].rlike(ID_FORM))
    return F.get(F.transform(fits, lambda r: r["external_id"]), 0)


def clean_description(text: Column, most: int = 1000) -> Column:
    """Citations out, white space collapsed, cut at a word."""
    from threadloom.functions.text import collapse, truncate_words

    return truncate_words(collapse(F.regexp_replace(text, r"\(Citation:[^)]*\)", "")), most)


def active(objects: DataFrame) -> DataFrame:
    """Objects neither revoked nor deprecated, with their external id."""
    gone = F.coalesce("revoked", F.lit(False)) | F.coalesce("x_mitre_deprecated", F.lit(False))
    return objects.where(~gone).withColumn("attack_id", external_id(F.col("external_references"))).where("attack_id is not null")


def cards(objects: DataFrame) -> DataFrame:
    """(attack_id, name, text) for retrieval, one per id."""
    a = active(objects).select("attack_id", "name", clean_description(F.col("description")).alias("description"))
    text = F.concat_ws(": ", F.concat("attack_id", F.lit(" - "), "name"), F.nullif(F.col("description"), F.lit("")))
    return a.groupBy("attack_id").agg(F.min(F.struct("name", text.alias("text"))).alias("c")).select("attack_id", "c.*")


def revoked_map(objects: DataFrame) -> DataFrame:
    """(old, new) external ids along revoked-by relations."""
    ids = objects.select("id", external_id(F.col("external_references")).alias("x")).where("x is not null")
    rel = objects.where("relationship_type = 'revoked-by'").select("source_ref", "target_ref")
    return rel.join(ids.select(F.col("id").alias("source_ref"), F.col("x").alias("old")), "source_ref").join(ids.select(F.col("id").alias("target_ref"), F.col("x").alias("new")), "target_ref").select("old", "new").distinct()


def hierarchy(objects: DataFrame) -> DataFrame:
    """(id, parent, relation): sub-techniques to techniques, techniques to tactics by kill-chain phase, sub-techniques also to their parent's tactics."""
    a = active(objects)
    tactics = a.where("type = 'x-mitre-tactic'").select(F.col("x_mitre_shortname").alias("phase"), F.col("attack_id").alias("tactic"))
    techniques = a.where("type = 'attack-pattern'").select("attack_id", "kill_chain_phases")
    parents = techniques.where(F.col("attack_id").contains(".")).select(F.col("attack_id").alias("id"), F.substring_index("attack_id", ".", 1).alias("parent"), F.lit("subtechnique_of").alias("relation"))
    own = techniques.select(F.col("attack_id").alias("id"), F.explode("kill_chain_phases").alias("p")).select("id", F.col("p.phase_name").alias("phase")).join(tactics, "phase").select("id", F.col("tactic").alias("parent"), F.lit("tactic").alias("relation"))
    inherited = parents.select("id", F.col("parent").alias("up")).join(own.select(F.col("id").alias("up"), "parent", "relation"), "up").select("id", "parent", "relation")
    return parents.union(own).union(inherited).distinct()


def uses(objects: DataFrame) -> DataFrame:
    """(source, target, text) of uses relations between active objects, citations and links cleaned from the text."""
    from threadloom.functions.text import clean_markdown

    ids = active(objects).select("id", "attack_id")
    rel = objects.where("relationship_type = 'uses'").select("source_ref", "target_ref", clean_markdown(F.col("description")).alias("text"))
    return rel.join(ids.select(F.col("id").alias("source_ref"), F.col("attack_id").alias("source")), "source_ref").join(ids.select(F.col("id").alias("target_ref"), F.col("attack_id").alias("target")), "target_ref").select("source", "target", "text")


def procedure_examples(objects: DataFrame, least: int = 20) -> DataFrame:
    """Texts of uses relations to techniques, of some length: (text, gold)."""
    return uses(objects).where(F.col("target").startswith("T") & (F.length("text") >= least)).select("text", F.col("target").alias("gold"))


def alias_tokens(objects: DataFrame, kind: str = "intrusion-set", least: int = 3) -> DataFrame:
    """Tokens of names and aliases that belong to one object only: (token, attack_id)."""
    a = active(objects).where(F.col("type") == kind)
    names = a.select("attack_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    tokens = names.select("attack_id", F.explode(F.regexp_extract_all(F.lower("alias"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token")).where(F.length("token") >= least)
    return tokens.groupBy("token").agg(F.min("attack_id").alias("attack_id"), F.count_distinct("attack_id").alias("n")).where("n = 1").drop("n")


def rolled_up_label(candidate: Column, gold: Column) -> Column:
    """1 if the candidate or what stands before its dot is in the gold array."""
    return (F.array_contains(gold, candidate) | F.array_contains(gold, F.substring_index(candidate, ".", 1))).cast("int")
