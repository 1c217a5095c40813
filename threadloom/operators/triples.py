"""Triples against an ontology: cleanup, validation, consensus, smoothing and propagation.

A triple row has s_name, s_type, predicate, o_name, o_type, quote and seq (its place).
"""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import lookup, sentences
from threadloom.operators.grouped import per_group

# ---- fixed values: the ontology ----
TYPES = (
    "threat-actor", "intrusion-set", "campaign", "malware", "tool", "infrastructure", "attack-pattern", "course-of-action", "indicator",
    "vulnerability", "software", "product", "organization", "identity", "sector", "country", "location", "city", "ipv4-addr", "ipv6-addr",
    "domain-name", "url", "file", "email-addr", "observed-data", "report", "sighting", "x-mitre-data-source", "x-mitre-data-component", "observable",
    "user-account", "directory", "autonomous-system", "date", "malware-analysis",
)
PREDICATES = (
    "uses", "targets", "attributed_to", "exploits", "affects", "mitigates", "indicates", "detects", "based_on", "derived_from", "observed_in",
    "communicates_with", "hosts", "delivers", "drops", "located_at", "uses_technique", "subtechnique_of", "revoked_by", "duplicate_of",
    "originates_from", "impacts", "resolves_to", "downloads_from", "writes_to", "reads_from", "emails_to", "observed_on", "analysis_of",
    "characterizes", "sighting_of", "sighted_at", "sighted_by", "variant_of",
)
DOMAIN_RANGE = {
    "uses": (("threat-actor", "intrusion-set", "campaign"), ("malware", "tool", "infrastructure", "attack-pattern")),
    "targets": (("threat-actor", "intrusion-set", "campaign", "malware", "attack-pattern"), ("identity", "organization", "sector", "location", "country")),
    "attributed_to": (("campaign", "intrusion-set"), ("threat-actor",)),
    "exploits": (("threat-actor", "malware", "tool"), ("vulnerability",)),
    "uses_technique": (("threat-actor", "malware", "tool", "campaign"), ("attack-pattern",)),
    "originates_from": (("threat-actor", "intrusion-set"), ("location", "country")),
    "based_on": (("indicator",), ("file", "url", "domain-name", "ipv4-addr", "ipv6-addr", "email-addr", "observable", "artifact")),
    "derived_from": (("indicator",), ("report", "observed-data", "artifact", "log")),
    "detects": (("indicator", "tool", "x-mitre-data-source"), ("malware", "campaign", "intrusion-set", "infrastructure", "tool", "vulnerability")),
    "indicates": (("indicator",), ("malware", "campaign", "intrusion-set", "attack-pattern", "vulnerability", "organization", "sector", "location")),
    "resolves_to": (("domain-name",), ("ipv4-addr", "ipv6-addr")),
    "hosts": (("infrastructure",), ("domain-name", "ipv4-addr", "ipv6-addr", "url", "file")),
    "delivers": (("infrastructure", "malware", "tool"), ("malware", "tool", "file", "url")),
    "drops": (("malware", "tool"), ("malware", "tool", "file")),
    "located_at": (("infrastructure", "organization", "identity"), ("location", "country", "city")),
    "observed_on": (("threat-actor", "malware", "tool", "infrastructure", "indicator", "attack-pattern"), ("date",)),
    "impacts": (("threat-actor", "malware", "attack-pattern"), ("identity", "organization", "sector")),
}
TYPE_ALIASES = {
    "threatactor": "threat-actor", "intrusionset": "intrusion-set", "attackpattern": "attack-pattern", "courseofaction": "course-of-action", "domain": "domain-name",
    "domainname": "domain-name", "ipv4": "ipv4-addr", "ipv4addr": "ipv4-addr", "ipv4-address": "ipv4-addr", "ipv6": "ipv6-addr", "ipv6addr": "ipv6-addr",
    "ipv6-address": "ipv6-addr", "email": "email-addr", "emailaddress": "email-addr", "useraccount": "user-account", "autonomoussystem": "autonomous-system",
    "observeddata": "observed-data", "malwareanalysis": "malware-analysis",
}
PREDICATE_ALIASES = {
    "communicateswith": "communicates_with", "usestechnique": "uses_technique", "subtechniqueof": "subtechnique_of", "revokedby": "revoked_by", "duplicateof": "duplicate_of",
    "originatesfrom": "originates_from", "resolvesto": "resolves_to", "downloadsfrom": "downloads_from", "observedon": "observed_on", "analysisof": "analysis_of",
    "sightingof": "sighting_of", "sightedat": "sighted_at", "sightedby": "sighted_by", "variantof": "variant_of",
}
STATES = ("malware", "tool", "attack-pattern", "threat-actor", "intrusion-set", "vulnerability", "indicator", "org", "tactic", "other")
# ---- end of fixed values ----


def canonical_type(x: Column) -> Column:
    """Lower case without spaces, underscores as hyphens, aliases resolved."""
    return lookup(F.translate(F.regexp_replace(F.lower(F.trim(x)), " ", ""), "_", "-"), TYPE_ALIASES)


def canonical_predicate(x: Column) -> Column:
    """Lower case, spaces as underscores, aliases resolved; hyphens stay, so hyphenated predicates stay outside the vocabulary."""
    return lookup(F.translate(F.lower(F.trim(x)), " ", "_"), PREDICATE_ALIASES)


def fixed(triples: DataFrame) -> DataFrame:
    """Canonical types and predicate, trimmed names."""
    return triples.withColumns({"s_type": canonical_type(F.col("s_type")), "o_type": canonical_type(F.col("o_type")), "predicate": canonical_predicate(F.col("predicate")), "s_name": F.trim("s_name"), "o_name": F.trim("o_name")})


def errors(s_name: Column, s_type: Column, predicate: Column, o_name: Column, o_type: Column) -> Column:
    """Codes of what is wrong with a triple, in a fixed order; empty if it is valid. Null parts are errors, not unknowns."""
    p, st, ot = canonical_predicate(predicate), canonical_type(s_type), canonical_type(o_type)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    named = lambda x: (F.length(F.trim(x)) > 0) & (F.length(F.trim(x)) <= 500)
    domain = F.create_map(*[x for k, (d, _) in DOMAIN_RANGE.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in d]))])
    ranges = F.create_map(*[x for k, (_, r) in DOMAIN_RANGE.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in r]))])
    bound = F.coalesce(p.isin(list(DOMAIN_RANGE)), F.lit(False))
    inside = lambda table, kind: F.array_contains(F.element_at(table, p), F.coalesce(kind, F.lit("")))
    codes = [
        (no(p.isin(*PREDICATES)), "predicate_invalid"), (no(st.isin(*TYPES)), "subject.type_not_allowed"), (no(ot.isin(*TYPES)), "object.type_not_allowed"),
        (bound & no(inside(domain, st)), "subject.type_domain"), (bound & no(inside(ranges, ot)), "object.type_range"),
        (no(named(s_name)), "subject.name_bad"), (no(named(o_name)), "object.name_bad"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in codes]), lambda x: x.isNotNull())


def validated(triples: DataFrame) -> DataFrame:
    return triples.withColumn("errors", errors(*[F.col(c) for c in ("s_name", "s_type", "predicate", "o_name", "o_type")]))


def worth_repair(codes: Column, fatal: list[str], fixable: list[str]) -> Column:
    """Some code is fixable and none fatal."""
    of = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.arrays_overlap(codes, of(fixable)) & ~F.arrays_overlap(codes, of(fatal))


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp ratio of names, case kept, white space collapsed; 0 where a bound shows that it is under ``least``."""
    m = SequenceMatcher(None, " ".join((a or "").split()), " ".join((b or "").split()))
    return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0


def consensus(rows: list[dict], m: int = 2, tau: float = 0.9) -> list[tuple[dict, int]]:
    """Distinct triples of one unit, types and predicate, each with its votes, in order -> (row, votes) of the groups of m votes or more.

    A row takes up the later ones with names alike to its own and first quotes that overlap; the longest quote speaks for a group, the first of
    equally long ones. Only rows whose quotes share three words can overlap, so the others aren't compared.
    """
    out, gone = [], set()
    bag = [set((r["first_quote"] or "").lower().split()) for r in rows]
    holders: dict[str, list[int]] = {}
    for i, words in enumerate(bag):
        for w in words:
            holders.setdefault(w, []).append(i)
    for i, r in enumerate(rows):
        if i in gone:
            continue
        shared: dict[int, int] = {}
        for w in bag[i]:
            for j in holders[w]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        group = [r]
        for j in sorted(shared):
            o = rows[j]
            if j in gone or shared[j] < max(3, min(len(bag[i]), len(bag[j])) // 2):
                continue
            if similarity(r["s_key"], o["s_key"], tau) >= tau and similarity(r["o_key"], o["o_key"], tau) >= tau:
                group.append(o)
                gone.add(j)
        n = sum(g["votes"] for g in group)
        if n >= max(2, m):
            out.append((max(group, key=lambda g: len(g["quote"] or "")), n))
    return out


def fuzzy_consensus(votes: DataFrame, unit: str, m: int = 2, tau: float = 0.9, types=TYPES, predicates=PREDICATES) -> DataFrame:
    """votes(unit, triple columns, seq) of allowed types and predicates: exact groups, case kept, are aggregated first, so what one task sees is
    distinct triples of a unit, types and predicate; ``consensus`` merges them in the order of their first seq."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    row = F.struct("s_name", "o_name", "quote")
    key = [unit, "s_type", "predicate", "o_type"]
    allowed = votes.withColumns({c: flat(F.col(c)) for c in key[1:]})
    allowed = allowed.where(F.col("s_type").isin(*types) & F.col("o_type").isin(*types) & F.col("predicate").isin(*predicates))
    longest = F.struct(F.length(F.coalesce("quote", F.lit(""))).alias("l"), (-F.col("seq")).alias("n"))
    exact = allowed.groupBy(*key, flat(F.coalesce("s_name", F.lit(""))).alias("s_key"), flat(F.coalesce("o_name", F.lit(""))).alias("o_key")).agg(
        F.count("*").alias("votes"), F.min("seq").alias("seq"), F.min_by("quote", "seq").alias("first_quote"), F.max_by(row, longest).alias("best")
    )
    exact = exact.select(*key, "s_key", "o_key", "votes", "seq", "first_quote", F.col("best.s_name").alias("s_name"), F.col("best.o_name").alias("o_name"), F.col("best.quote").alias("quote"))
    kinds = dict(exact.dtypes)

    def merge(rows: list[dict]) -> list[tuple]:
        return [(*[r[k] for k in key], r["s_name"], r["o_name"], r["quote"], n) for r, n in consensus(rows, m, tau)]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", s_name string, o_name string, quote string, votes long"
    return per_group(exact, key, ["seq"], merge, schema)


def viterbi(kinds: list[str], confidence: list[float], alpha: float = 0.1) -> list[str]:
    """Likeliest states under a sticky transition; an observation has its confidence, the other states share the rest."""
    import numpy as np

    if not kinds:
        return []
    n = len(STATES)
    step = np.full((n, n), alpha)
    np.fill_diagonal(step, 1.0)
    tiny = 1e-9  # added to every probability
    step = np.log(step / step.sum(axis=1, keepdims=True) + tiny)
    seen = [STATES.index(k) if k in STATES else n - 1 for k in kinds]
    emit = np.array([[np.log((c if s == o else (1 - c) / (n - 1)) + tiny) for s in range(n)] for o, c in zip(seen, confidence, strict=True)])
    best, back = np.full(n, np.log(1.0 / n + tiny)) + emit[0], []
    for e in emit[1:]:
        total = best[:, None] + step
        back.append(total.argmax(axis=0))
        best = total.max(axis=0) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [STATES[s] for s in reversed(path)]


def smoothed(labels: DataFrame, by: str, order: str) -> DataFrame:
    """labels(by, order, kind, confidence) with the smoothed kind of each place, one context at a time."""
    types = dict(labels.dtypes)

    def run(rows: list[dict]) -> list[tuple]:
        smooth = viterbi([r["kind"] for r in rows], [r["confidence"] for r in rows])
        return [(r[by], r[order], r["kind"], x) for r, x in zip(rows, smooth, strict=True)]

    return per_group(labels.select(by, order, "kind", "confidence"), [by], [order], run, f"`{by}` {types[by]}, `{order}` {types[order]}, kind string, smooth string")


def majority_labels(mentions: DataFrame, contexts: DataFrame) -> DataFrame:
    """mentions(context_id, name, kind, seq) in contexts(context_id, text): per sentence the most frequent canonical kind of the names that
    stand in it, in their case, and its share; of equally frequent ones the first by seq. None gives other, 0.5."""
    s = contexts.select("context_id", F.posexplode(sentences(F.col("text"))).alias("k", "sentence"))
    named = mentions.withColumn("kind", canonical_type(F.col("kind"))).where("name <> '' and kind <> ''")
    hits = s.join(named, "context_id").where(F.col("sentence").contains(F.col("name"))).groupBy("context_id", "k", "kind").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    top = hits.groupBy("context_id", "k").agg(F.max_by("kind", F.struct("n", (-F.col("seq")).alias("s"))).alias("kind"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return s.join(top, ["context_id", "k"], "left").select("context_id", "k", F.coalesce("kind", F.lit("other")).alias("kind"), F.coalesce(F.col("n") / F.col("total"), F.lit(0.5)).alias("confidence"))
