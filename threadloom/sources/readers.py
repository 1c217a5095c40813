"""Readers for the formats around the engine. Each is a Spark source plus expressions, so any path Spark can open will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.sources.config import LOADERS


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(text: Column, item: str) -> Column:
    """Items of a text that is, in this order of attempts: a JSON array, an array cut off before its closing brackets, objects one a
    line (up to the first bad line), objects one after the other. Null if none of them reads."""
    array = f"array<{item}>"
    body = F.trim(F.regexp_replace(text, "^﻿", ""))
    parse = lambda x: F.filter(F.from_json(x, array, {"mode": "PERMISSIVE"}), lambda o: o.isNotNull())
    whole = F.when(body.startswith("[") & body.endswith("]"), parse(body))
    closed = F.when(body.startswith("["), parse(F.concat(F.regexp_replace(body, r"(?s),?\s*\{[^{}]*$", ""), F.lit("]"))))
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != "")
    good = F.transform(lines, lambda x: x.rlike(r"^\s*\{.*\}\s*$"))
    first_bad = F.array_position(good, False)
    upto = F.when(first_bad == 0, F.size(lines)).otherwise(first_bad - 1).cast("int")
    by_line = F.when(F.get(good, 0), parse(F.concat(F.lit("["), F.array_join(F.slice(lines, 1, upto), ","), F.lit("]"))))
    joined = F.when(body.startswith("{"), parse(F.concat(F.lit("["), F.regexp_replace(body, r"\}\s*\{", "},{"), F.lit("]"))))
    some = lambda x: F.when(F.size(x) > 0, x)
    return F.coalesce(some(whole), some(closed), some(by_line), some(joined))


def json_ladder(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(path, items) of whole files by ``json_array``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", json_array(F.col("value"), item).alias("items"))


def text_ladder(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files in UTF-8, else Latin-1, without a byte-order mark."""
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.expr("try_validate_utf8(cast(content as string))")
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    return files.select("path", F.regexp_replace(text, "^﻿", "").alias("text"))


def typed_csv(spark: SparkSession, path: str, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """CSV with a header; each named column is cast, or has its default where it is missing or doesn't parse."""
    raw = spark.read.option("header", True).csv(path)
    out = []
    for name, (kind, default) in columns.items():
        value = F.col(f"`{name}`").try_cast(kind) if name in raw.columns else F.lit(None).cast(kind)
        out.append(F.coalesce(value, F.lit(default).cast(kind)).alias(name))
    return raw.select(*out)


def first_column(df: DataFrame, names: list[str]) -> Column:
    """The first of some alternative columns that a table has, null-filled from the later ones."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def bio(spark: SparkSession, path: str) -> DataFrame:
    """(path, sentence, place, token, tag) of token files: a token and a tag a line, a blank line ends a sentence."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("place", "line"))
    blank = (F.trim("line") == "").cast("int")
    order = Window.partitionBy("path").orderBy("place")
    rows = files.withColumn("blanks", F.sum(blank).over(order)).where(F.trim("line") != "")
    parts = F.split(F.trim("line"), r"[\t ]+")
    rows = rows.select("path", "blanks", "place", F.get(parts, 0).alias("token"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("O").alias("tag"))
    return rows.select("path", F.dense_rank().over(Window.partitionBy("path").orderBy("blanks")).alias("sentence"), F.row_number().over(Window.partitionBy("path", "blanks").orderBy("place")).alias("place"), "token", "tag")


def tagged_items(items: DataFrame, labels: dict[int, str] | None = None) -> DataFrame:
    """items(id, tokens, tags array<string>) -> token rows, cut at the shorter array; integer tags go through ``labels``."""
    names = F.create_map(*[F.lit(x) for k, v in (labels or {}).items() for x in (str(k), v)]) if labels else None
    n = F.least(F.size("tokens"), F.size("tags"))
    rows = items.where(n > 0).select("id", F.posexplode(F.slice(F.arrays_zip("tokens", "tags"), 1, n)).alias("place", "x"))
    tag = F.coalesce(F.element_at(names, F.col("x.tags")), F.col("x.tags")) if names is not None else F.col("x.tags")
    return rows.select("id", "place", F.col("x.tokens").alias("token"), tag.alias("tag"))


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, group, name, stem, id, content) of files under a folder; the group is the folder right above a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("group"), name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.substring(F.sha2("content", 256), 1, 16).alias("id"), "content")


def document_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(key, identifier) of a mapping with columns Document and Identifier, under full names and stems."""
    m = spark.read.option("header", True).csv(path).select(F.trim("Document").alias("name"), F.trim("Identifier").alias("identifier"))
    stem = m.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("key"), "identifier")
    return m.select(F.col("name").alias("key"), "identifier").union(stem).where("key <> ''").dropDuplicates(["key"])


STIX = (
    "objects array<struct<id string, type string, name string, description string, revoked boolean, x_mitre_deprecated boolean, x_mitre_shortname string, "
    "aliases array<string>, external_references array<struct<source_name string, external_id string>>, kill_chain_phases array<struct<kill_chain_name string, phase_name string>>, "
    "relationship_type string, source_ref string, target_ref string>>"
)


def stix_objects(spark: SparkSession, path: str) -> DataFrame:
    """A row per object of a bundle, under one wide schema."""
    return spark.read.schema(STIX).option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def cached_scores(units: DataFrame, cache: DataFrame, score) -> tuple[DataFrame, DataFrame]:
    """units(text) with the value of a text-keyed cache(key, value); ``score`` (DataFrame of key, text -> key, value) sees only the misses,
    once each. Returns the scored units and the new cache rows."""
    keyed = units.withColumn("key", F.sha1("text"))
    missing = keyed.select("key", "text").distinct().join(cache.select("key"), "key", "left_anti")
    new = score(missing)
    return keyed.join(cache.select("key", "value").union(new.select("key", "value")), "key", "left").drop("key"), new


LOADERS.update({"token-tags": bio, "json-ladder": json_ladder, "json-lines": json_lines, "typed-csv": typed_csv, "documents": documents, "bundle": stix_objects})
