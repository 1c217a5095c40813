"""Explanations and counterfactuals: surface forms, edits of a query, agreement of rankings, evidence, templated prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import english_join

# Words that stay lower case inside a title; margins of the confidence tiers; shares of the impact classes.
MINOR_WORDS = ["of", "and", "the", "in", "on", "for", "to", "a", "an", "or", "via", "by", "with", "from"]
TIERS = (("HIGH", 0.30), ("MEDIUM", 0.10))
IMPACTS = (("HIGH", 0.5), ("MEDIUM", 0.2), ("LOW", 0.05))
# End of fixed values.


def _upper(x: Column) -> Column:
    return x.rlike(r"\p{L}") & (x == F.upper(x))


def _lower(x: Column) -> Column:
    return x.rlike(r"\p{L}") & (x == F.lower(x))


def title(x: Column) -> Column:
    """Every run of letters with a capital first, the rest lower: also after digits and hyphens."""
    parts = F.regexp_extract_all(x, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")


def _titled(x: Column) -> Column:
    return x.rlike(r"\p{L}") & (x == title(x))


def surface_form(name: Column) -> Column:
    """Bucket of a proper noun by words, case and digits; null and empty are other."""
    words = F.size(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))
    digit = name.rlike(r"\d")
    inner = (words == 1) & ~_upper(name) & ~_lower(name) & ~_titled(name) & F.substring(name, 2, 1_000_000).rlike(r"\p{Lu}")
    return (
        F.when(name.isNull() | (words == 0), "other").when(inner, "mixed_case_special").when((words == 1) & _upper(name) & digit, "1word_upper_digit")
        .when((words == 1) & _upper(name), "1word_upper_nodigit").when((words == 1) & _titled(name), "1word_title").when(words == 1, "other")
        .when((words == 2) & _titled(name), "2word_title").when(words == 2, "2word_other").otherwise("3plus_words")
    )


def recast(substitute: Column, original: Column) -> Column:
    """The substitute in the original's case; mixed case takes title case."""
    form = surface_form(original)
    return (
        F.when((substitute == "") | (original == ""), substitute).when(form == "mixed_case_special", title(substitute)).when(_upper(original), F.upper(substitute))
        .when(_titled(original), title(substitute)).when(_lower(original), F.lower(substitute)).otherwise(substitute)
    )


def splice(text: Column, start: Column, end: Column, put: Column) -> Column:
    """text with [start, end) replaced, zero-based."""
    return F.concat(F.substring(text, F.lit(1), start), put, F.substring(text, end + 1, F.length(text)))


def insert_actor(query: Column, actor: Column, template: str = "[ACTOR_NAME] was observed ") -> Column:
    """The template before a query whose plain capitalised first word is lower-cased; names with inner capitals or digits stay."""
    head, tail = template.split("[ACTOR_NAME]")
    plain = query.rlike(r"^\p{Lu}\p{Ll}") & ~query.rlike(r"^\p{L}[\p{L}\p{N}]*\p{Lu}")
    body = F.when(plain, F.concat(F.lower(F.substring(query, 1, 1)), F.substring(query, 2, 1_000_000))).otherwise(query)
    return F.concat(F.lit(head), actor, F.lit(tail), body)


def smart_title(x: Column) -> Column:
    words = F.split(F.trim(F.lower(x)), r"\s+")
    last = F.size(words) - 1
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))
    return F.array_join(F.transform(words, lambda w, i: F.when((i == 0) | (i == last) | ~w.isin(MINOR_WORDS), cap(w)).otherwise(w)), " ")


def rbo(a: Column, b: Column, k: int, p: float) -> Column:
    """Rank-biased overlap of two ranked arrays to depth k, normalised to the weight of the depths it has; 0 if either is empty."""
    n = F.least(F.lit(k), F.size(a), F.size(b))
    agree = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d - 1) * F.size(F.array_intersect(F.slice(a, 1, d), F.slice(b, 1, d))) / d)
    return F.when(n > 0, agree * (1 - p) / (1 - F.pow(F.lit(p), n))).otherwise(0.0)


def tau_b(a: Column, b: Column, k: int) -> Column:
    """Kendall's tau-b over the union of two top-k arrays; an item that a side lacks ranks k + 1 there. Null for under two items or no spread."""
    x, y = F.slice(a, 1, k), F.slice(b, 1, k)
    place = lambda side, i: F.when(F.array_position(side, i) > 0, F.array_position(side, i)).otherwise(k + 1).cast("int")
    items = F.transform(F.array_union(x, y), lambda i: F.struct(place(x, i).alias("p"), place(y, i).alias("q")))
    zero = F.struct(*[F.lit(0).alias(c) for c in ("s", "m", "n")])

    def pairs(state: Column, u: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            dp, dq = F.sign(u["p"] - v["p"]).cast("int"), F.sign(u["q"] - v["q"]).cast("int")
            return F.struct((acc["s"] + dp * dq).alias("s"), (acc["m"] + F.abs(dp)).alias("m"), (acc["n"] + F.abs(dq)).alias("n"))

        return F.aggregate(items, state, step)

    total = F.aggregate(items, zero, pairs)  # every pair twice, which the ratio cancels
    return F.when((total["m"] > 0) & (total["n"] > 0), total["s"] / F.sqrt(total["m"].cast("double") * total["n"]))


def tier(margin: Column) -> Column:
    return F.when(margin >= TIERS[0][1], TIERS[0][0]).when(margin >= TIERS[1][1], TIERS[1][0]).otherwise("LOW")


def impact(share: Column) -> Column:
    out = F.when(share.isNull(), None)
    for name, least in IMPACTS:
        out = out.when(F.abs(share) >= least, name)
    return out.otherwise("NONE")


def evidence(tokens: DataFrame, by: str, most: int = 3) -> DataFrame:
    """tokens(by, place, token, share) -> up to ``most`` distinct words by importance: those of high impact, and of medium impact only where
    fewer than two are high."""
    word = F.regexp_replace("token", r"""^[,.?!;:"'()\[\]{}]+|[,.?!;:"'()\[\]{}]+$""", "")
    rows = tokens.withColumns({"word": word, "impact": impact(F.col("share"))}).where("word <> '' and impact in ('HIGH', 'MEDIUM')")
    weight = F.when(F.col("impact") == "HIGH", F.col("share")).otherwise(F.abs("share"))
    best = rows.groupBy(by, F.lower("word").alias("key")).agg(F.min(F.struct((F.col("impact") != "HIGH").alias("medium"), (-weight).alias("w"), "place", "word")).alias("b"))
    order = Window.partitionBy(by).orderBy("b.medium", "b.w", "b.place")
    high = F.sum(F.when(~F.col("b.medium"), 1).otherwise(0)).over(Window.partitionBy(by))
    kept = best.withColumns({"rank": F.row_number().over(order), "high": high}).where((F.col("rank") <= most) & (~F.col("b.medium") | (F.col("high") < 2)))
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "b.word"))), lambda x: x["word"])
    return kept.groupBy(by).agg(words.alias("words"), english_join(words).alias("text"))


def shift(before: DataFrame, after: DataFrame, k: int = 5) -> DataFrame:
    """Rankings (query, item, score, label, rank) before and after an edit -> flip of the best item, moves of the best gold's rank and
    score and of the margin, and agreement of the top k."""

    def per(df: DataFrame, tag: str) -> DataFrame:
        at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
        gold = F.min(F.when(F.col("label") == 1, F.struct("rank", "score")))
        top = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "item")))), lambda x: x["item"])
        return df.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("item"))).alias(f"best_{tag}"), gold.alias(f"gold_{tag}"), (at(1) - at(2)).alias(f"margin_{tag}"), top.alias(f"top_{tag}"))

    j = per(before, "a").join(per(after, "b"), "query")
    return j.select(
        "query", (F.col("best_a") != F.col("best_b")).alias("flip"), (F.col("gold_b.rank") - F.col("gold_a.rank")).alias("gold_rank_delta"), (F.col("gold_b.score") - F.col("gold_a.score")).alias("gold_score_delta"),
        (F.col("margin_b") - F.col("margin_a")).alias("margin_delta"), F.size(F.array_intersect("top_a", "top_b")).alias("top_overlap"), rbo(F.col("top_a"), F.col("top_b"), k, 0.8).alias("rbo"), tau_b(F.col("top_a"), F.col("top_b"), k).alias("tau"),
    )


def prose_errors(prose: Column, names: list[Column], sentences: int = 5, least: int = 70, most: int = 180) -> Column:
    """What a generated explanation lacks: its number of sentences, of words, and each of some names."""
    n = F.size(F.filter(F.split(F.trim(prose), r"(?<=[.!?])\s+"), lambda s: s != ""))
    words = F.size(F.filter(F.split(F.trim(prose), r"\s+"), lambda w: w != ""))
    codes = [F.when(n != sentences, F.lit("sentence_count")), F.when(words < least, F.lit("too_short")), F.when(words > most, F.lit("too_long"))]
    codes += [F.when(~F.coalesce(prose.contains(x), F.lit(False)), F.lit(f"missing_{k}")) for k, x in enumerate(names)]
    return F.filter(F.array(*codes), lambda c: c.isNotNull())
