"""Settings, options of a run, loaders by name, and the files of a split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settings(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON file of settings, by any path Spark can read; YAML where a parser for it is installed."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text) or {}


@dataclass(frozen=True)
class Options:
    """Passes over a unit, votes that a triple needs, rows a call of the model takes, and which stages run."""

    passes: int = 3
    votes: int = 2
    batch: int = 32
    sentences: bool = True
    chunks: bool = False

    def checked(self) -> Options:
        """Itself, if its numbers fit together; ValueError otherwise."""
        for name in ("passes", "votes", "batch"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.votes > self.passes:
            raise ValueError("votes cannot be more than passes")
        return self


LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str) -> Callable:
    """Registers a function (spark, path, ..) -> DataFrame under a name."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        LOADERS[name.strip().lower()] = f
        return f

    return register


def load(name: str) -> Callable[..., DataFrame]:
    """The loader of a name, in any case; ValueError for an unknown one."""
    from threadloom.sources import readers  # noqa: F401  registers its own

    found = LOADERS.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown dataset: {name}")
    return found


def split_files(spark: SparkSession, base: str, split: str) -> list[str]:
    """Files of a split below a folder: the first of the known places that has one, else all files of a ner_json folder, else all JSON files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(base)
    paths = sorted(r.path for r in listed.select("path").collect())  # a dataset's files, few by nature
    for place in (f"/ner_json/{split}.json", f"/data/ner_json/{split}.json", f"/{split}.json", f"/AnnoCTR/ner_json/{split}.json"):
        if found := [p for p in paths if p.endswith(place)]:
            return found[:1]
    return [p for p in paths if "/ner_json/" in p] or paths


def rejected_triples(spark: SparkSession, path: str) -> DataFrame:
    """Rejected triples of JSON files, a list by itself or under invalid_triples, items, invalid or results, in that order; (file, k, row as JSON)."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = F.coalesce(
        F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")),
        *[F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>") for name in ("invalid_triples", "items", "invalid", "results")],
    )
    return text.select("file", F.posexplode(rows).alias("k", "row"))
