"""Five-sentence explanations of predictions, built from explanation records by fixed wording.

A record has query, actor, predicted_id, predicted_score, correct, primary_gold_id, confidence, margin, alternatives (array of rank, id, score,
is_gold, text_preview), evidence (array of tokens), overlap (array of words), hierarchy_type and hierarchy_parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import entities as E
from threadloom.functions import text as X

# ---- fixed values: words for tiers and the wording of sentences, whose results must equal the reference's ----
TIER_WORDS = {"HIGH": "high", "MEDIUM": "moderate", "LOW": "low"}
NO_ACTOR = "an unspecified threat actor"
S1 = "In a report attributed to %s, the reranker assigned %s as its top-ranked candidate with %s certainty (confidence score %.2f, score gap of %.2f over the next candidate)."
S2_ONE, S2_MANY = "The strongest token-level evidence is the term ", "The strongest token-level evidence comes from the terms "
S2_EXTRA = ", with additional lexical overlap against the candidate description on "
S2_OVERLAP = "With a short query, individual token-impact attribution does not apply; the principal evidence is lexical overlap with the candidate description on "
S2_NONE = "With a single-token query and no lexical overlap against the candidate description, individual evidence attribution does not apply; the model matched the query token directly against the candidate entry."
S3_SINGLE = " is the single ATT&CK technique annotated for this query."
S3_ONE_OF = "%s is one of %d ATT&CK techniques annotated as a valid mapping for this query"
S3_ABSENT = " matches an annotated valid mapping for this query, though the dataset's primary annotation does not appear in the top-5 candidates."
S3_MISS = "However, the annotated technique %s ranked %s in the model's candidate list"
S4_KINDS = {"tactic": " is an ATT&CK tactic, a high-level adversary objective", "technique": " is a top-level ATT&CK technique", "software": " is an ATT&CK software entry"}
S4_SUB, S4_OTHER = " is an ATT&CK sub-technique", " sits in the ATT&CK framework"
S5_RIGHT = {
    "HIGH": "This is a high-certainty assignment suitable for downstream automation with light spot-checking.",
    "MEDIUM": "This is a moderate-certainty assignment; brief analyst review is recommended before downstream automation.",
    "LOW": "Analyst review is recommended before downstream use given the low certainty.",
}
S5_WRONG = {
    "HIGH": "Despite the model's high certainty, analyst review is required to reconcile the disagreement with the annotated mapping.",
    "MEDIUM": "Given the moderate certainty and the small score gap, analyst review is recommended to reconcile the disagreement with the annotated mapping.",
    "LOW": "Analyst review is required given the low certainty and the disagreement with the annotated mapping.",
}
OTHER_GOLDS, SHOWN_WORDS = 3, 3
# ---- end of fixed values ----


def _by_tier(words: dict[str, str]) -> Column:
    return F.when(F.col("confidence") == "HIGH", words["HIGH"]).when(F.col("confidence") == "MEDIUM", words["MEDIUM"]).otherwise(words["LOW"])


def _bold(item: Column, name: Column) -> Column:
    return F.when(F.coalesce(item, F.lit("")) == "", "").when(name.isNotNull(), F.concat(F.lit("**"), item, F.lit(" ("), name, F.lit(")**"))).otherwise(F.concat(F.lit("**"), item, F.lit("**")))


def _name(item: Column) -> Column:
    """The name of an id among the alternatives, null if none tells."""
    named = F.filter("alternatives", lambda a: (a["id"] == item) & E.preview_name(a["text_preview"]).isNotNull())
    return E.preview_name(F.get(named, 0)["text_preview"])


def state(records: DataFrame, display: dict[str, str] | None = None) -> DataFrame:
    """records with what the sentences need: names, gold ids, how the prediction matched, the best-ranked gold, the runner-up, words that the
    evidence lacks. ``display`` maps actors to the names they are shown by; others take title case."""
    golds = F.filter("alternatives", lambda a: a["is_gold"])
    best = F.get(F.array_sort(F.transform(golds, lambda a: F.struct(a["rank"].alias("rank"), a["id"].alias("id"), a["score"].alias("score")))), 0)
    second = F.get(F.filter("alternatives", lambda a: a["rank"] == 2), 0)
    shown = X.lookup(F.col("actor"), display or {"": ""}, F.initcap("actor"))
    rows = records.withColumns({
        "actor_display": F.when(F.coalesce("actor", F.lit("")) == "", NO_ACTOR).otherwise(shown), "all_gold_ids": F.transform(golds, lambda a: a["id"]), "best": best, "second": second,
        "overlap_words": F.filter("overlap", lambda w: F.length(w) >= 2), "correct": F.coalesce("correct", F.lit(False)),
    })
    rows = rows.withColumns({
        "n_gold_ids": F.size("all_gold_ids"),
        "matched_via": F.when(~F.col("correct"), "error").when(F.col("predicted_id").eqNullSafe(F.col("primary_gold_id")), "primary_gold").when(F.array_contains("all_gold_ids", F.col("predicted_id")), "alternative_gold").otherwise("primary_gold"),
        "predicted_name": _name(F.col("predicted_id")), "primary_gold_name": _name(F.col("primary_gold_id")), "best_gold_id": F.col("best.id"), "best_gold_rank": F.col("best.rank"), "best_gold_score": F.col("best.score"),
        "best_gold_name": _name(F.col("best.id")), "next_alt_id": F.col("second.id"), "next_alt_score": F.col("second.score"), "next_alt_is_gold": F.coalesce("second.is_gold", F.lit(False)), "next_alt_name": _name(F.col("second.id")),
        "hierarchy_parent_name": _name(F.col("hierarchy_parent")),
        "extra_words": F.filter("overlap_words", lambda w: ~F.exists("evidence", lambda t: F.lower(t) == F.lower(w))),
        "other_golds": F.slice(F.filter("all_gold_ids", lambda g: g != F.col("predicted_id")), 1, OTHER_GOLDS),
    })
    return rows.withColumn("is_multi_gold", F.col("n_gold_ids") >= 2).drop("best", "second")


def _first() -> Column:
    return F.format_string(S1, "actor_display", _bold(F.col("predicted_id"), F.col("predicted_name")), X.lookup(F.col("confidence"), TIER_WORDS, F.lower("confidence")), F.col("predicted_score").cast("double"), F.col("margin").cast("double"))


def _second() -> Column:
    few = lambda c: X.english_join(F.slice(F.col(c), 1, SHOWN_WORDS))
    base = F.concat(F.when(F.size("evidence") == 1, S2_ONE).otherwise(S2_MANY), X.english_join(F.col("evidence")))
    some = F.when(F.size("extra_words") > 0, F.concat(base, F.lit(S2_EXTRA), few("extra_words"), F.lit("."))).otherwise(F.concat(base, F.lit(".")))
    words = F.when(F.size("extra_words") > 0, few("extra_words")).otherwise(few("overlap_words"))
    return F.when(F.size("evidence") > 0, some).when(F.size("overlap_words") > 0, F.concat(F.lit(S2_OVERLAP), words, F.lit("."))).otherwise(S2_NONE)


def _third() -> Column:
    own = F.concat(F.lit("**"), F.col("predicted_id"), F.lit("**"))
    one_of = F.format_string(S3_ONE_OF, own, F.col("n_gold_ids"))
    primary = F.when(F.col("is_multi_gold"), F.concat(one_of, F.lit("."))).otherwise(F.concat(own, F.lit(S3_SINGLE)))
    other = F.when(F.col("n_gold_ids") == 1, F.concat(own, F.lit(S3_ABSENT))).when(
        F.col("primary_gold_name").isNotNull(), F.concat(one_of, F.lit("; the primary annotation is "), _bold(F.col("primary_gold_id"), F.col("primary_gold_name")), F.lit("."))
    ).otherwise(F.concat(one_of, F.lit(".")))
    rank = F.coalesce(X.ordinal(F.col("best_gold_rank")), F.lit("lower"))
    scored = F.coalesce(F.format_string(" with confidence score %.2f", F.col("best_gold_score").cast("double")), F.lit(""))
    miss = F.concat(F.format_string(S3_MISS, _bold(F.col("best_gold_id"), F.col("best_gold_name")), rank), F.when(F.col("best_gold_score").isNotNull(), scored).otherwise(""), F.lit("."))
    return F.when(F.col("matched_via") == "primary_gold", primary).when(F.col("matched_via") == "alternative_gold", other).otherwise(miss)


def _fourth() -> Column:
    parent = F.concat(F.lit(" is a sub-technique of "), _bold(F.col("hierarchy_parent"), F.col("hierarchy_parent_name")))
    kind = F.col("hierarchy_type")
    clause = F.when(kind == "sub-technique", F.when(F.coalesce("hierarchy_parent", F.lit("")) != "", parent).otherwise(S4_SUB))
    for name, words in S4_KINDS.items():
        clause = clause.when(kind == name, words)
    clause = F.concat(F.col("predicted_id"), clause.otherwise(S4_OTHER))
    plain = F.concat(F.lit("In structural terms, "), clause, F.lit("."))
    at = F.when(F.col("next_alt_score").isNotNull(), F.format_string(" at confidence score %.2f", F.col("next_alt_score").cast("double"))).otherwise("")
    runner = F.concat(F.lit("The next-ranked candidate was "), _bold(F.col("next_alt_id"), F.col("next_alt_name")), at, F.lit("; in structural terms, "), clause, F.lit("."))
    told = (F.col("matched_via") == "alternative_gold") & F.col("next_alt_id").eqNullSafe(F.col("primary_gold_id"))
    return F.when((F.col("matched_via") == "error") | told | (F.coalesce("next_alt_id", F.lit("")) == ""), plain).otherwise(runner)


def _fifth() -> Column:
    return F.when(F.col("matched_via") == "error", _by_tier(S5_WRONG)).otherwise(_by_tier(S5_RIGHT))


def explained(records: DataFrame, display: dict[str, str] | None = None) -> DataFrame:
    """state() with the five sentences as ``explanation``, and its numbers of sentences and words."""
    rows = state(records, display).withColumn("explanation", F.concat_ws(" ", _first(), _second(), _third(), _fourth(), _fifth()))
    return rows.withColumns({"n_sentences": F.size(F.filter(F.split(F.trim("explanation"), r"(?<=[.!?])\s+"), lambda s: s != "")), "n_words": X.token_count(F.col("explanation"))})


def examples(rows: DataFrame) -> DataFrame:
    """One explained record for each of five telling cases that occurs: (label, query, explanation). Ties go by query."""
    gap, wrong = F.col("score_gap"), F.col("matched_via") == "error"
    right, multi = F.col("matched_via"), F.col("is_multi_gold")
    cases = (
        ("single gold, sure", (F.col("confidence") == "HIGH") & (right == "primary_gold") & ~multi, F.struct(F.lit(0), -gap, "query")),
        ("another of several golds, sure", (F.col("confidence") == "HIGH") & (right == "alternative_gold") & multi, F.struct(F.lit(0), -gap, "query")),
        ("right, moderately sure", (F.col("confidence") == "MEDIUM") & F.col("correct"), F.struct(F.lit(0), F.abs(gap - 1.0), "query")),
        ("wrong, gold second", wrong & (F.col("best_gold_rank") == 2), F.struct((F.col("confidence") != "MEDIUM").cast("int"), gap, "query")),
        ("software by overlap alone", (F.col("hierarchy_type") == "software") & (F.size("evidence") == 0) & (F.size("overlap_words") > 0), F.struct(F.lit(0), F.lit(0.0), "query")),
    )
    own = rows.withColumn("score_gap", F.col("margin").cast("double"))
    out = None
    for label, held, order in cases:
        one = own.where(held).agg(F.min_by(F.struct("query", "explanation"), order).alias("r")).where("r is not null").select(F.lit(label).alias("label"), "r.*")
        out = one if out is None else out.union(one)
    return out
