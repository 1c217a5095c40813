"""String expressions: normalisers, identifiers, cleaners, tokenisers. Column to Column, JVM-side.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: alias maps and patterns whose results must equal the reference's ----
ENTITY_ALIASES = {
    "apt": "threat-actor", "group": "threat-actor", "actor": "threat-actor", "malware-family": "malware", "rat": "tool", "trojan": "malware",
    "ransomware": "malware", "exploit": "attack-pattern", "technique": "attack-pattern", "org": "organization", "company": "organization",
}
PREDICATE_ALIASES = {
    "use": "uses", "using": "uses", "utilized": "uses", "utilize": "uses", "target": "targets", "targeting": "targets", "exploit": "exploits",
    "exploiting": "exploits", "deliver": "delivers", "delivering": "delivers", "drop": "drops", "dropping": "drops",
}
USE_VERBS = {"executes": "uses", "leverages": "uses", "employs": "uses"}
BOILERPLATE = (
    r"\b(cookie|cookies|privacy|manage cookies|accept|reject)\b",
    r"\b(all microsoft|sign in|search the blog|more|solutions|products|services)\b",
    r"\bsubscribe\b|\bshare\b|\bread more\b|\bheader\b|\bfooter\b",
    r"^\s*[A-Z]{2,}(?:\s+[A-Z]{2,})*\s*$",
    r"^\s*©\s*\d{4}\s",
    r"^\s*[-].*$",
)
ONLY_WORDS = BOILERPLATE[3]
# ---- end of fixed values ----


def lookup(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """table[value], else the default (value itself)."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, value), value if default is None else default)


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_name(x: Column) -> Column:
    return F.lower(collapse(x))


def normalize_entity(x: Column) -> Column:
    """Lower case, straight quotes, runs of space, hyphen and underscore as one space."""
    straight = F.translate(x, "‘’“”", "''\"\"")
    return F.trim(F.lower(F.regexp_replace(straight, r"[\s\-_]+", " ")))


def canonical_entity(x: Column) -> Column:
    """Entity type by alias; null or empty is 'unknown'."""
    norm = F.translate(F.trim(F.lower(x)), " _", "--")
    return F.when(x.isNull() | (x == ""), F.lit("unknown")).otherwise(lookup(norm, ENTITY_ALIASES))


def canonical_predicate(x: Column) -> Column:
    """Predicate by alias; null or empty is 'related-to'."""
    norm = F.translate(F.trim(F.lower(x)), " _", "--")
    return F.when(x.isNull() | (x == ""), F.lit("related-to")).otherwise(lookup(norm, PREDICATE_ALIASES))


def use_predicate(x: Column) -> Column:
    norm = F.lower(F.trim(x))
    return lookup(norm, USE_VERBS)


def squashed_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\w]+", "")


def document_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def node_id(kind: Column, name: Column) -> Column:
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.sha2(F.concat_ws("|", part(kind), part(name)), 256)


def query_id(report: Column, query: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.coalesce(report, F.lit("")), F.coalesce(query, F.lit("")))), 1, 12)


def first_nonempty(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: F.trim(x) != ""), 0)


def sentences(x: Column) -> Column:
    """Split after . ! ? and white space; blanks dropped."""
    return F.filter(F.split(F.trim(x), r"(?<=[.!?])\s+"), lambda s: s != "")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9]+"), F.lit(0))


def content_tokens(x: Column, stopwords: list[str]) -> Column:
    """Tokens of two or more characters that are no stop words, repeats kept."""
    return F.filter(tokens(x), lambda t: (F.length(t) > 1) & ~t.isin(stopwords))


def token_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda t: t != ""))


def is_boilerplate(x: Column) -> Column:
    s = F.trim(x)
    # the pattern for lines of nothing but words is asked in three linear parts: repeated groups recurse in the JVM's engine
    only_words = s.rlike("[A-Za-z]{2}") & ~s.rlike(r"[^A-Za-z\s]") & ~s.rlike(r"(^|\s)[A-Za-z](\s|$)")
    found = (F.length(s) < 8) | only_words
    for pattern in BOILERPLATE:
        if pattern != ONLY_WORDS:
            found = found | s.rlike(f"(?i){pattern}")
    return found


def clean_markdown(x: Column) -> Column:
    for pattern, put in (
        (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"https?://\S+", ""), (r"\(Citation:\s*[^)]*\)", ""), (r"\(\s*\)", ""), ("  +", " "), (r"\s+([.,;:])", "$1"),
    ):
        x = F.regexp_replace(x, pattern, put)
    return F.trim(x)


def truncate_words(x: Column, most: int, from_share: float = 0.8) -> Column:
    """At most so many characters, back to the last space if that lies beyond a share of them, with '...' where cut."""
    head = F.left(x, F.lit(most))
    space = most - F.length(F.substring_index(head, " ", -1))
    cut = F.when(space > most * from_share, F.substring(head, F.lit(1), space - 1)).otherwise(head)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(cut, F.lit("...")))


def technique_class(x: Column) -> Column:
    """TA, T_sub, T, S, G, M or unknown, by prefix; null and empty are unknown."""
    s = F.upper(F.trim(x))
    return (
        F.when(s.isNull() | (s == ""), "unknown").when(s.startswith("TA"), "TA").when(s.startswith("T") & s.contains("."), "T_sub")
        .when(s.startswith("T"), "T").when(s.startswith("S"), "S").when(s.startswith("G"), "G").when(s.startswith("M"), "M").otherwise("unknown")
    )


def parent_technique(x: Column) -> Column:
    """What stands before the dot, null without one."""
    return F.when(x.contains("."), F.substring_index(x, ".", 1))


def attack_id(x: Column) -> Column:
    """The first technique, tactic, software, group or mitigation id in a text, null if none."""
    return F.nullif(F.regexp_extract(x, r"\b(TA\d{4}|T\d{4}(?:\.\d{3})?|[SGM]\d{4})\b", 1), F.lit(""))


def is_parent_child(a: Column, b: Column) -> Column:
    return (a != b) & ((F.substring_index(a, ".", 1) == b) | (F.substring_index(b, ".", 1) == a))


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def english_join(items: Column) -> Column:
    """a; a and b; a, b, and c; an empty list gives an empty string."""
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(items, -1))
    return F.when(n == 0, "").when(n == 1, F.get(items, 0)).when(n == 2, F.array_join(items, " and ")).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    """Of sets; 0 if both are empty."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def quote_overlap(a: Column, b: Column) -> Column:
    """Distinct words in common: at least three, and half of the smaller set."""
    words = lambda x: F.array_distinct(F.filter(F.split(normalize_name(x), " "), lambda t: t != ""))
    x, y = words(a), words(b)
    enough = F.greatest(F.lit(3), F.floor(F.least(F.size(x), F.size(y)) / 2))
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= enough), F.lit(False))


def hash_score(query: Column, candidate: Column) -> Column:
    """Deterministic stand-in for a scoring model: 64 bits of SHA-256 over query, NUL, candidate, as a share of 2^64."""
    head = F.substring(F.sha2(F.concat(query, F.lit("\x00"), candidate), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def hash_draw(*parts: Column) -> Column:
    """A share in [0, 1) from 48 bits of MD5 of the parts: draws that any engine can repeat."""
    head = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)
    return F.conv(head, 16, 10).cast("double") / F.lit(281474976710656.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def repair_json(x: Column) -> Column:
    """Fences off, the outermost array or object, straight double quotes, quoted keys, no trailing commas."""
    s = F.regexp_replace(x, r"```[a-zA-Z]*", "")
    body = F.regexp_extract(s, r"(?s)([\[{].*[\]}])", 1)
    s = F.when(body != "", body).otherwise(s)
    s = F.translate(s, "'", '"')
    s = F.regexp_replace(s, r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":')
    return F.trim(F.regexp_replace(s, r",\s*([\]}])", "$1"))


def relation_type(x: Column) -> Column:
    """Upper case, runs of other characters as one underscore; empty or null is RELATED_TO."""
    s = F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), r"[^A-Z0-9]+", "_")
    return F.when(s == "", "RELATED_TO").otherwise(s)
