"""Loose normalisers of names, types, predicates and links, for text that no ontology has seen yet. Column to Column, JVM-side.

Null reads as empty unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import text as X

# ---- fixed values: patterns, aliases and word lists whose results must equal the reference's ----
TECHNIQUE = r"(?i)\bT\d{4}(?:\.\d{3})?\b"
CVE = r"(?i)\bCVE-\d{4}-\d{4,7}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
DOMAIN = r"(?i)\b(?=.{4,253}\b)(?!-)(?:[a-z0-9-]{1,63}\.)+[a-z]{2,63}\b"
LINK = r"(?i)attack\.mitre\.org/(techniques|software|tactics|groups)/(T\d{4}|TA\d{4}|S\d{4}|G\d{4})(?:/(\d{3}))?"
TYPE_ALIASES = {
    "attack pattern": "attack-pattern", "attack-pattern": "attack-pattern", "technique": "attack-pattern", "sub-technique": "attack-pattern", "tactic": "tactic",
    "c2": "infrastructure", "server": "infrastructure", "actor": "threat-actor", "group": "intrusion-set", "vuln": "vulnerability", "cve": "vulnerability",
    "program": "tool", "utility": "tool", "org": "identity", "organization": "identity", "company": "identity", "sector": "identity", "industry": "identity",
}
NAME_ALIASES = {
    "powershell.exe": "powershell", "pwsh": "powershell", "mimikatz.exe": "mimikatz", "cobalt strike": "cobalt_strike", "x-agent": "xagent", "x-tunnel": "xtunnel",
    "apt28": "fancy bear", "sednit": "fancy bear", "cozy bear": "apt29", "cozybear": "apt29", "cozyduke": "apt29", "the dukes": "apt29", "trick bot": "trickbot",
    "trickbot.exe": "trickbot", "cobaltstrike": "cobalt_strike", "fancybear": "fancy bear", "ta505": "ta505",
}
EXTENSIONS = (".exe", ".dll", ".sys", ".bin", ".dat", ".tmp", ".ps1", ".bat", ".cmd", ".js", ".jar", ".zip", ".rar")
PREDICATES = {
    "use": "uses", "uses": "uses", "used": "uses", "using": "uses", "execute": "uses", "executes": "uses", "executed": "uses", "run": "uses", "runs": "uses",
    "leverages": "uses", "utilizes": "uses", "invokes": "uses", "calls": "uses", "implements": "uses", "deliver": "delivers", "delivers": "delivers", "drops": "drops",
    "drop": "drops", "download": "downloads", "downloads": "downloads", "install": "installs", "installs": "installs", "beacon": "beacons-to", "beacons": "beacons-to",
    "beacons-to": "beacons-to", "communicates": "communicates-with", "communicates-with": "communicates-with", "contacts": "communicates-with",
    "connects to": "communicates-with", "hosts on": "hosts-on", "hosts-on": "hosts-on", "hosted on": "hosts-on", "target": "targets", "targets": "targets",
    "attack": "targets", "attacks": "targets", "compromises": "targets", "exploit": "exploits", "exploits": "exploits", "abuses": "exploits",
    "attributed to": "attributed-to", "linked to": "related-to", "associated with": "related-to", "part of": "part-of", "part-of": "part-of",
    "indicates": "indicates", "mitigates": "mitigates", "controls": "controls", "located in": "located-in", "located-in": "located-in",
}
RELATIONS = ("uses", "delivers", "drops", "downloads", "installs", "exploits", "targets", "communicates-with", "beacons-to", "hosts-on", "controls", "indicates", "attributed-to", "mitigates", "part-of", "related-to", "located-in")
HINTS = (
    ("intrusion-set", r"\b(apt|group|crew|bear|team|lazarus|ta\d+)\b"),
    ("attack-pattern", r"\b(phish|spear.?phish|credential|brute|exfiltrat|payload|lateral|persistence|t\d{4})\b"),
    ("malware", r"\b(malware|trojan|ransom|worm|bot|backdoor|loader|infostealer)\b"),
    ("tool", r"\b(tool|framework|beacon|ps1|powershell|mimikatz|cobalt ?strike|metasploit)\b"),
    ("infrastructure", r"\b(c2|command[- ]and[- ]control|server|ip|domain|dns|infrastructure)\b"),
    ("identity", r"\b(inc|corp|llc|ltd|company|organization|sector|bank|government|ministry)\b"),
)
TERMS = r"(?i)\b(APT|MITRE|CVE-\d{4}-\d{4,7}|phishing|lateral|Cobalt ?Strike|beacon|payload|ransom|exfiltrat|persistence|C2|command[- ]and[- ]control|TTPs?)\b"
LEAST_DENSITY, LEAST_WORDS = 0.005, 1
KEYWORDS = (
    "apt", "malware", "c2", "command and control", "phishing", "ransomware", "exploit", "cve-", "lateral movement", "persistence", "beacon", "cobalt strike",
    "exfiltration", "loader", "backdoor", "webshell", "ioc", "infrastructure",
)
LABEL_PREFIX = "Ucoex"
# ---- end of fixed values ----


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def loose_type(x: Column) -> Column:
    """Lower case and trimmed, aliases resolved; unknown types stay as they are."""
    return X.lookup(F.trim(F.lower(_text(x))), TYPE_ALIASES)


def implicit_type(x: Column) -> Column:
    """What an identifier in the text gives away: attack-pattern, vulnerability, infrastructure, else null."""
    s = F.trim(_text(x))
    return F.when(s.rlike(TECHNIQUE), "attack-pattern").when(s.rlike(CVE), "vulnerability").when(s.rlike(IPV4) | s.rlike(DOMAIN), "infrastructure")


def entity_label(x: Column, kind: Column) -> Column:
    """Name under which mentions of an entity meet: an identifier in capitals, the host of an address, else the lower-cased name without
    quotes and file extensions, aliases resolved. Empty for empty."""
    s = F.trim(_text(x))
    given = loose_type(kind)
    found = F.when(given != "", given).otherwise(F.coalesce(implicit_type(s), F.lit("")))
    host = F.substring_index(F.regexp_replace(F.lower(s), "^https?://", ""), "/", 1)
    base = F.lower(F.regexp_replace(F.trim(F.regexp_replace(s, "[\"'`]", "")), r"\s+", " "))
    ending = "(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$"
    base = F.regexp_replace(base, ending, "")
    return (
        F.when(_text(x) == "", "").when(s.rlike(TECHNIQUE), F.upper(F.regexp_extract(s, TECHNIQUE, 0))).when(s.rlike(CVE), F.upper(F.regexp_extract(s, CVE, 0)))
        .when(found == "infrastructure", host).otherwise(X.lookup(base, NAME_ALIASES))
    )


def loose_predicate(x: Column) -> Column:
    """Predicate by alias; unknown ones are related-to, empty ones uses."""
    q = F.regexp_replace(F.lower(F.trim(_text(x))), r"\s+", " ")
    return F.when(_text(x) == "", "uses").otherwise(X.lookup(q, PREDICATES, F.when(q.isin(*RELATIONS), q).otherwise("related-to")))


def inferred_type(name: Column) -> Column:
    """Type from a name: identifiers first, then telling words; identity if nothing tells."""
    n = F.trim(_text(name))
    out = F.when(n.rlike(TECHNIQUE), "attack-pattern").when(n.rlike(CVE), "vulnerability").when(n.rlike(IPV4) | n.rlike(DOMAIN), "infrastructure")
    for kind, words in HINTS:
        out = out.when(F.lower(n).rlike(words), kind)
    return out.otherwise("identity")


def word_count(x: Column) -> Column:
    return F.regexp_count(_text(x), F.lit(r"\w+"))


def trimmed_sentences(sentences: Column, least: int = 3) -> Column:
    """Sentences of three characters or more, trimmed."""
    return F.filter(F.transform(sentences, F.trim), lambda s: F.length(s) >= least)


def is_dense(sentences: Column, least_density: float = LEAST_DENSITY, least_words: int = LEAST_WORDS) -> Column:
    """Enough telling terms a word, or enough words; never for blank text."""
    block = F.array_join(sentences, " ")
    words = word_count(block)
    return (F.trim(block) != "") & ((F.regexp_count(block, F.lit(TERMS)) / F.greatest(F.lit(1), words) >= least_density) | (words >= least_words))


def has_keyword(sentences: Column, *hits: Column) -> Column:
    """Some keyword in the lower-cased text, or one of the other signs (a recogniser's or a matcher's verdict per chunk)."""
    block, out = F.lower(F.array_join(sentences, " ")), F.lit(False)
    for word in KEYWORDS:
        out = out | block.contains(word)
    for sign in hits:
        out = out | F.coalesce(sign, F.lit(False))
    return out


def technique_key(x: Column) -> Column:
    """Trimmed and lower-cased; t and four or five digits stay as they are, so do all others."""
    return F.lower(F.trim(_text(x)))


def plain_entity(x: Column) -> Column:
    """Lower case, runs of space, hyphen and underscore as one space, straight quotes."""
    return F.translate(F.regexp_replace(F.trim(F.lower(_text(x))), r"[\s\-_]+", " "), "’“”", "'\"\"")


def triple_key(subject: Column, predicate: Column, obj: Column) -> Column:
    """The triple under which predictions and gold ones are compared."""
    return F.struct(plain_entity(subject).alias("subject"), X.use_predicate(_text(predicate)).alias("predicate"), technique_key(obj).alias("object"))


def triple_tuple(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.struct(X.normalize_name(_text(subject)).alias("subject"), X.canonical_predicate(predicate).alias("predicate"), X.normalize_name(_text(obj)).alias("object"))


def unified(subject: Column, subject_type: Column, predicate: Column, obj: Column, object_type: Column) -> Column:
    """Names normalised, types and predicate canonical, nested as stored triples are."""
    side = lambda name, kind: F.struct(X.normalize_name(_text(name)).alias("name"), X.canonical_entity(kind).alias("type"))
    return F.struct(side(subject, subject_type).alias("subject"), X.canonical_predicate(predicate).alias("predicate"), side(obj, object_type).alias("object"))


def document_key(file_name: Column, content_hash: Column) -> Column:
    """The stored hash of a document's content, else the hash of its trimmed, lower-cased file name."""
    named = F.when(_text(file_name) == "", "unknown").otherwise(file_name)
    return F.when(_text(content_hash) != "", content_hash).otherwise(F.sha2(F.lower(F.trim(named)), 256))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def safe_filename(x: Column) -> Column:
    return F.regexp_replace(x, r'[<>:"/\\|?*]', "_")


def clean_relation_text(x: Column) -> Column:
    """Citations out, markdown links as their text, one line."""
    s = F.regexp_replace(F.regexp_replace(_text(x), r"\(Citation:\s*[^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clean_mention_text(x: Column) -> Column:
    """Markdown links as their text, hard spaces as spaces, one line."""
    s = F.translate(F.regexp_replace(_text(x), r"\[([^\]]*)\]\([^)]*\)", "$1"), " ", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clean_bundle_text(x: Column) -> Column:
    """Links as their text, citations and bare addresses out, one line."""
    s = F.regexp_replace(_text(x), r"\[([^\]]+)\]\([^)]+\)", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"\(Citation:\s*[^)]*\)", ""), r"https?://\S+", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def link_target(url: Column) -> Column:
    """(kind, id) of a link into the knowledge base, null for other links; a technique's sub-number joins its id."""
    kind = F.lower(F.regexp_extract(_text(url), LINK, 1))
    base, sub = F.upper(F.regexp_extract(_text(url), LINK, 2)), F.regexp_extract(_text(url), LINK, 3)
    named = X.lookup(kind, {"techniques": "technique", "software": "software", "tactics": "tactic", "groups": "group"})
    full = F.when((kind == "techniques") & (sub != ""), F.concat_ws(".", base, sub)).otherwise(base)
    return F.when(kind != "", F.struct(named.alias("kind"), full.alias("id")))


def leading_id(x: Column) -> Column:
    """The id a text begins with, else the text."""
    found = F.regexp_extract(x, r"^(TA\d{4}|T\d{4}(?:\.\d{3})?|S\d{4})", 1)
    return F.when(found != "", found).otherwise(x)


def target_type(clean_id: Column, labels: Column, kind: Column) -> Column:
    """Type of a target by its id, else by a telling label, else by its type field; UNKNOWN if nothing tells."""
    cid = F.upper(clean_id)
    told = F.get(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.startswith(LABEL_PREFIX)), 0)
    return (
        F.when(cid.startswith("TA"), "TACTIC").when(cid.startswith("T") & cid.contains("."), "SUB_TECHNIQUE").when(cid.startswith("T"), "TECHNIQUE").when(cid.startswith("S"), "SOFTWARE")
        .when(told.isNotNull(), F.upper(F.replace(told, F.lit(LABEL_PREFIX), F.lit("")))).when(F.trim(_text(kind)) != "", F.upper(F.trim(kind))).otherwise("UNKNOWN")
    )


def token_key(x: Column) -> Column:
    """A token's lower-case letters and digits."""
    return F.regexp_replace(F.lower(_text(x)), "[^a-z0-9]", "")


def preview_name(preview: Column) -> Column:
    """The name in 'id — name: description', null if there is none; names in capitals take title case."""
    from threadloom.operators.explain import smart_title

    name = F.trim(F.regexp_extract(_text(preview), "^[\\w.]+\\s*—\\s*([^:]+?)(?::|$)", 1))
    shouts = (F.length(F.regexp_replace(name, r"[^\p{L}]", "")) > 2) & (name == F.upper(name))
    return F.when(name != "", F.when(shouts, smart_title(name)).otherwise(name))


def shared_words(a: Column, b: Column, stopwords: list[str]) -> Column:
    """Sorted distinct words of letters and digits that both texts hold, without stop words."""
    own = lambda x: F.filter(F.array_distinct(X.tokens(_text(x))), lambda t: ~t.isin(stopwords))
    return F.array_sort(F.array_intersect(own(a), own(b)))
