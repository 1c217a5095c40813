"""Counterfactual edits of queries: spans of actor names, pools of substitutes, choices among them, and the manifest of all edits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators.explain import insert_actor, recast, splice, surface_form

# ---- fixed values: phrases that stand for an actor, the mask, the least length of a token that is looked for ----
PHRASES = {"initial": ["The threat actor", "The group", "The adversary"], "medial": ["the threat actor", "the group", "the adversary"], "after_article": ["threat actor", "group", "adversary"]}
MASK, LEAST_TOKEN, NEUTRAL = "[MASK]", 3, 0.5
# ---- end of fixed values ----


def actor_pool(vocabulary: DataFrame, tests: list[str], collisions: list[str]) -> DataFrame:
    """vocabulary(token, category, primary_name, g_id) -> the primary actor tokens that may stand in, without test actors and words with another
    meaning: norm, primary, bucket, g_id. A missing name falls back to the token."""
    rows = vocabulary.where((F.col("category") == "actor_primary") & ~F.col("token").isin(tests + collisions))
    primary = F.coalesce("primary_name", "token")
    return rows.select(F.col("token").alias("norm"), primary.alias("primary"), surface_form(primary).alias("bucket"), F.coalesce("g_id", F.lit("")).alias("g_id"), F.lit("actor").alias("pool"))


def name_pool(names: DataFrame, pool: str, actors: DataFrame | None = None) -> DataFrame:
    """names(group, name) -> distinct placebos of a group by surface form; names whose first word is a token of actors(token) are left out."""
    rows = names.where("name <> ''").select("group", "name").distinct()
    if actors is not None:
        rows = rows.withColumn("_first", F.lower(F.get(F.split(F.trim("name"), r"\s+"), 0))).join(actors.select(F.col("token").alias("_first")).distinct(), "_first", "left_anti")
    return rows.select(F.lower("name").alias("norm"), F.col("name").alias("primary"), surface_form(F.col("name")).alias("bucket"), F.lit("").alias("g_id"), F.lit(pool).alias("pool"))


def stratified(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """queries(query, actor, text, ..) with ``matched``, the sorted aliases(actor, token) of their actor that stand among their words, and the
    stratum: A with some, B without. Commas, dots and round brackets part words."""
    words = F.split(F.translate(F.lower("text"), ",.()", "    "), r"\s+")
    own = aliases.groupBy("actor").agg(F.collect_set("token").alias("_aliases"))
    rows = queries.join(own, "actor", "left").withColumn("matched", F.array_sort(F.array_intersect(words, F.coalesce("_aliases", F.array().cast("array<string>")))))
    return rows.withColumn("stratum", F.when(F.size("matched") > 0, "A").otherwise("B")).drop("_aliases")


def spans(text: Column, tokens: Column) -> Column:
    """Where any of the tokens (an array) stands in the text as a word, in any case: array of (start, end, surface), end exclusive, in order. Of
    tokens that begin together the longest counts; those under three characters are not looked for."""
    safe = F.filter(tokens, lambda t: F.length(t) >= LEAST_TOKEN)
    longest_first = F.transform(F.array_sort(F.transform(safe, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), lambda x: F.regexp_replace(x["t"], r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?i)\b("), F.array_join(longest_first, "|"), F.lit(r")\b"))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["g"])
        return F.struct((start + F.length(z["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + F.length(z["m"])).alias("end"), z["m"].alias("surface")))).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,surface:string>>")
    zipped = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("g")), lambda z: z["m"].isNotNull())
    return F.when(F.size(safe) > 0, F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), placed)["out"]).otherwise(none)


def substitutes(originals: DataFrame, pool: DataFrame, techniques: DataFrame, n: int, seed: int) -> DataFrame:
    """originals(query, surface, excluded array, gold array) and pool(norm, primary, bucket, g_id) -> n substitutes each, drawn by weight.

    Candidates have the original's surface form (title case for mixed case); if those are fewer than n, the others join them. The weight is one
    less the Jaccard similarity of the candidate's techniques(g_id, id) and the query's gold techniques, one half where either has none. Draws
    without replacement are the n largest of log(u) / weight with u from a hash, so they repeat anywhere. fallback: 0 same form, 1 title case for
    mixed case, 2 any form. A pool has hundreds of names: its join with the queries is by no key and is broadcast after it was counted.
    """
    named = F.array_sort(F.filter("gold", lambda g: g.startswith("T") & ~g.startswith("TA")))
    form = surface_form(F.col("surface"))
    own = originals.withColumns({"_gold": named, "_mixed": form == "mixed_case_special", "_bucket": F.when(form == "mixed_case_special", "1word_title").otherwise(form)})
    known = techniques.groupBy("g_id").agg(F.collect_set("id").alias("_techniques"))
    listed = pool.join(known, "g_id", "left").select("norm", "primary", "bucket", F.coalesce("_techniques", F.array().cast("array<string>")).alias("_techniques"))
    if listed.count() > 100_000:
        raise ValueError("a pool of substitutes is a curated list")
    names = listed.agg(F.collect_list(F.struct(*listed.columns)).alias("_pool"))  # one row, bounded above
    fit = F.filter("_pool", lambda c: ~F.array_contains("excluded", c["norm"]))
    rows = own.join(F.broadcast(names)).withColumn("_fit", fit).withColumn("_same", F.filter("_fit", lambda c: c["bucket"] == F.col("_bucket")))
    rows = rows.withColumn("_few", F.size("_same") < n)
    each = rows.select("query", "surface", "_gold", "_mixed", "_few", F.explode(F.when(F.col("_few"), F.col("_fit")).otherwise(F.col("_same"))).alias("c"))
    similar = X.jaccard(F.col("c._techniques"), F.col("_gold"))
    both = (F.size("c._techniques") > 0) & (F.size("_gold") > 0)
    weight = F.when(both, 1.0 - similar).otherwise(NEUTRAL)
    u = F.greatest(X.hash_draw(F.lit(seed), F.col("query"), F.col("c.norm")), F.lit(1e-12))
    drawn = each.withColumns({"_w": weight, "_k": F.when(weight > 0, F.log(u) / weight).otherwise(F.lit(float("-inf")))})
    ranked = drawn.withColumn("draw", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("_k"), "c.norm")) - 1).where(F.col("draw") < n)
    return ranked.select(
        "query", "draw", F.col("c.norm").alias("norm"), F.col("c.primary").alias("primary"), recast(F.col("c.primary"), F.col("surface")).alias("recast"), F.col("c.bucket").alias("bucket"),
        F.when(F.col("_few"), 2).when(F.col("_mixed"), 1).otherwise(0).alias("fallback"), F.when(both, similar).alias("tech_jaccard"),
    )


def generic_phrases(text: Column, start: Column) -> Column:
    """Phrases that may stand for the actor at a place: capitalised at the start, without article after one."""
    before = F.lower(F.substring(text, F.greatest(start - 3, F.lit(1)), F.least(start, F.lit(4))))
    listed = lambda k: F.array(*[F.lit(x) for x in PHRASES[k]])
    return F.when(start == 0, listed("initial")).when((start >= 4) & (before == "the "), listed("after_article")).otherwise(listed("medial"))


def manifest(queries: DataFrame, pools: dict[str, DataFrame], techniques: DataFrame, own_names: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Every edit of every query, before anything is scored: (edit_id, query, stratum, actor, intervention, draw, substitute, original, edited).

    queries come from stratified(), with ``gold``; pools has the names 'swap', 'proper_noun_placebo' and 'malware_placebo'. Stratum A: the first
    span of a matched token is replaced by drawn actors (not its own), by placebos, by generic phrases and by a mask. Stratum B: its own actor
    (own_names: actor, name) and drawn ones are put before it. Every query also stands once as it is.
    """
    base = queries.select("query", "stratum", "actor", "text", "gold", "matched")
    row = lambda df, name, draw, put, original, edited: df.select(
        F.concat_ws("__", F.lit(name), "query", draw.cast("string")).alias("edit_id"), "query", "stratum", "actor", F.lit(name).alias("intervention"), draw.cast("int").alias("draw"), put.alias("substitute"), original.alias("original"), edited.alias("edited")
    )
    none = F.lit(None).cast("string")
    out = row(base, "baseline", F.lit(0), none, none, F.col("text"))
    a = base.where("stratum = 'A'").withColumn("span", F.get(spans(F.col("text"), F.col("matched")), 0)).where("span is not null").select("*", F.col("span.surface").alias("surface"))
    put = lambda x: splice(F.col("text"), F.col("span.start"), F.col("span.end"), x)
    for k, name in enumerate(("swap", "proper_noun_placebo", "malware_placebo")):
        excluded = F.array_append("matched", F.col("actor")) if name == "swap" else F.array().cast("array<string>")
        drawn = substitutes(a.select("query", "surface", excluded.alias("excluded"), "gold"), pools[name], techniques, n, seed + k)
        out = out.union(row(a.join(drawn, "query"), name, F.col("draw"), F.col("recast"), F.col("surface"), put(F.col("recast"))))
    phrases = a.select("*", F.posexplode(generic_phrases(F.col("text"), F.col("span.start"))).alias("draw", "phrase"))
    out = out.union(row(phrases, "generic_phrase_placebo", F.col("draw"), F.col("phrase"), F.col("surface"), put(F.col("phrase"))))
    out = out.union(row(a, "soft_deletion", F.lit(0), F.lit(MASK), F.col("surface"), put(F.lit(MASK))))
    b = base.where("stratum = 'B'").join(own_names, "actor")
    out = out.union(row(b, "insertion_own_actor", F.lit(0), F.col("name"), none, insert_actor(F.col("text"), F.col("name"))))
    others = own_names.agg(F.array_sort(F.collect_set("actor")).alias("all_actors"))
    wanted = b.join(F.broadcast(others)).select("query", F.col("name").alias("surface"), F.col("all_actors").alias("excluded"), "gold")  # one row
    drawn = substitutes(wanted, pools["swap"], techniques, n, seed + 3)
    return out.union(row(b.join(drawn, "query"), "insertion_different_actor", F.col("draw"), F.col("recast"), none, insert_actor(F.col("text"), F.col("recast"))))


def actor_techniques(objects: DataFrame) -> DataFrame:
    """Objects of a bundle (id, type, external_id, revoked, deprecated, relationship_type, source_ref, target_ref) -> (g_id, id): the techniques
    that a group uses, without what was revoked or deprecated."""
    live = objects.where("not coalesce(revoked, false) and not coalesce(deprecated, false)")
    of = lambda kind, letter, name, ref: live.where((F.col("type") == kind) & F.col("external_id").startswith(letter)).select(F.col("id").alias(ref), F.col("external_id").alias(name))
    uses = live.where("type = 'relationship' and relationship_type = 'uses'").select("source_ref", "target_ref")
    return uses.join(of("intrusion-set", "G", "g_id", "source_ref"), "source_ref").join(of("attack-pattern", "T", "technique", "target_ref"), "target_ref").select("g_id", F.col("technique").alias("id")).distinct()


def escaped(tokens: list[str]) -> str:
    """The pattern for a fixed list of tokens, longest first, for use in plain SQL."""
    return r"\b(" + "|".join(re.escape(t) for t in sorted((t for t in tokens if len(t) >= LEAST_TOKEN), key=lambda t: (-len(t), t))) + r")\b"
