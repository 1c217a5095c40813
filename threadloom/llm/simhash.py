r"""SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 bits, bit set where more than half of the XXH64 hashes (seed 42) of a text's 3-word shingles have it.

Linking within ``RADIUS`` = 3 bits, over distinct fingerprints only (copies of a text collapse before any join):

* A fingerprint is cut into two halves of 32 bits. Two fingerprints within 3 bits agree in one half up to 1 bit, so
  each half enumerates its Hamming ball of radius 1 and fetches table matches by (half, value). A pair that differs
  by one bit is found from the side that has a 0 there, so only upward flips are sent: 17 probes a half on average.
* Matches are verified on all 64 bits inside the join.
* A bucket of over ``HOT`` fingerprints is not joined in pairs: its members go one level deeper, with their other
  half cut into two quarters of 16 bits and the same argument (one quarter agrees up to 1 bit). A deeper bucket fixes
  48 bits, so it has at most 65,536 distinct members whatever the input. Again small ones are joined and verified;
  a large one goes to a kernel that looks balls of the last 16 bits up in a table and returns a spanning forest
  (fewer links than members), never its pairs.

Components are joined up by ``components``. Defined results: null text is empty; texts without words have
fingerprint zero and link like any other; null ids are kept and never become a component's id unless nothing else is
reachable; repeated rows share a component; empty table, empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import similar
from threadloom.llm.common import materialise, with_facts
from threadloom.llm.components import components
from threadloom.session import ship

RADIUS, SHINGLE, HOT = 3, 3, 64
FINGERPRINT = "_fingerprint"


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text; shingles are hashed in blocks, so memory doesn't follow a text's words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(words) < shingle:
        starts, ends = [0], [len(line)]
    else:
        starts, ends = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    of, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 1 << 15):
        block = [of(line[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)]
        bits = np.unpackbits(np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def signed_fingerprint(text: str | None) -> int:
    x = fingerprint(text)
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the signed fingerprint of each text, in ``_fingerprint``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            signed = pa.array([signed_fingerprint(t.as_py()) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, signed], names=[*batch.schema.names, FINGERPRINT])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(FINGERPRINT, T.LongType())]))


def _half(fp: Column, seg: Column) -> Column:
    return F.when(seg == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def _flips(key: Column, bits: int, both: Column) -> Column:
    """Array of (key, spent): the value itself and those one bit away, upward only unless ``both``."""
    near = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.struct(key.bitwiseXOR(F.pow(F.lit(2.0), b).cast("long")).alias("key"), F.lit(1).alias("spent")))
    return F.concat(F.array(F.struct(key.alias("key"), F.lit(0).alias("spent"))), F.filter(near, lambda x: both | (x["key"] > key)))


def _level(table: DataFrame, probes: DataFrame, by: list[str], within: Column) -> tuple[DataFrame, DataFrame]:
    """Links of small buckets as (a, b), and the keys of large ones. table: by + fp, free; probes: by + fp, free, spent.

    ``within`` is the verification, over fp, spent, free and the table's t_fp, t_free.
    """
    keys = table.groupBy(*by).agg(F.count("*").alias("n"))
    small = table.join(keys.where(F.col("n") <= HOT).drop("n"), by, "left_semi").withColumnsRenamed({"fp": "t_fp", "free": "t_free"})
    links = probes.join(small, by).where(within).select(F.col("fp").alias("a"), F.col("t_fp").alias("b"))
    return links, keys.where(F.col("n") > HOT).drop("n")


def _forest(rows):
    """Spanning forest of one deep bucket. rows: fp, free (16 bits), spent, is_table."""
    import numpy as np
    import pandas as pd

    fps, node = np.unique(rows["fp"].to_numpy(), return_inverse=True)
    held = rows["is_table"].to_numpy()
    at = np.full(1 << 16, -1, dtype=np.int64)
    at[rows["free"].to_numpy()[held]] = node[held]
    spent, free = rows["spent"].to_numpy(), rows["free"].to_numpy()
    count = np.array([bin(x).count("1") for x in range(1 << 16)], dtype=np.int8)
    label = np.arange(len(fps))
    moved = True
    while moved:
        old = label.copy()
        for s in range(RADIUS + 1):
            masks = np.flatnonzero(count <= RADIUS - s)
            own = np.flatnonzero(spent == s)
            for part in np.array_split(own, max(1, len(own) * len(masks) // 2_000_000)):
                met = at[free[part][:, None] ^ masks[None, :]]
                i, j = np.nonzero(met >= 0)
                a, b = node[part][i], met[i, j]
                least = np.minimum(label[a], label[b])
                np.minimum.at(label, a, least)
                np.minimum.at(label, b, least)
        label = label[label]
        moved = not np.array_equal(old, label)
    far = np.flatnonzero(label != np.arange(len(fps)))
    return pd.DataFrame({"a": fps[far], "b": fps[label[far]]})


def links(fingerprints: DataFrame) -> DataFrame:
    """``fingerprints``: distinct fp. Returns (a, b) that join exactly the pairs within RADIUS, directly or by others of a hot bucket."""
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("t_fp"))) <= RADIUS
    seg = fingerprints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).withColumn("own", _half(F.col("fp"), F.col("seg")))
    table = seg.select("seg", F.col("own").alias("key"), "fp", F.lit(0).alias("free"))
    probes = seg.select("seg", "fp", F.lit(0).alias("free"), F.explode(_flips(F.col("own"), 32, F.lit(False))).alias("p")).select("seg", F.col("p.key").alias("key"), "fp", "free", F.col("p.spent").alias("spent"))
    order = (F.col("spent") > 0) | (F.col("fp") < F.col("t_fp"))
    found, hot = _level(table, probes, ["seg", "key"], near & order)
    hot = materialise(hot, "hot-keys")
    if hot.isEmpty():
        return found

    deep = probes.join(hot, ["seg", "key"], "left_semi")
    rest = _half(F.col("fp"), 1 - F.col("seg"))
    quarters = deep.select("seg", "key", "fp", "spent", rest.alias("rest"), F.explode(F.array(F.lit(0), F.lit(1))).alias("q")).select(
        "seg", "key", "fp", "spent", "q",
        F.when(F.col("q") == 0, F.shiftrightunsigned("rest", 16)).otherwise(F.col("rest").bitwiseAND(F.lit(0xFFFF))).alias("own"),
        F.when(F.col("q") == 0, F.col("rest").bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned("rest", 16)).cast("int").alias("free"),
    )
    quarters = materialise(quarters, "hot-quarters")
    by = ["seg", "key", "q", "sub"]
    table = quarters.where("spent = 0").select("seg", "key", "q", F.col("own").alias("sub"), "fp", "free")
    probes = quarters.select("seg", "key", "q", "fp", "free", "spent", F.explode(_flips(F.col("own"), 16, F.col("spent") > 0)).alias("p")).select(
        "seg", "key", "q", F.col("p.key").alias("sub"), "fp", "free", (F.col("spent") + F.col("p.spent")).alias("spent")
    )
    within = (F.col("spent") + F.bit_count(F.col("free").bitwiseXOR(F.col("t_free"))) <= RADIUS) & (F.col("fp") != F.col("t_fp"))
    more, hottest = _level(table, probes, by, within)
    hottest = materialise(hottest, "hottest-keys")
    found = found.union(more)
    if hottest.isEmpty():
        return found
    members = probes.select(*by, "fp", "free", "spent", F.lit(False).alias("is_table")).union(table.select(*by, "fp", "free", F.lit(0), F.lit(True)))
    grouped = members.join(hottest, by, "left_semi").select(*by, "fp", "free", "spent", "is_table").groupBy(*by)
    return found.union(grouped.applyInPandas(_forest, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id reachable over links."""
    rows = materialise(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", F.col(FINGERPRINT).alias("fp")), "fingerprints")
    return with_facts(rows, materialise(fp_components(rows), "fp-components"), "fp").select("doc_id", "fp", "component_id")


def fp_components(rows: DataFrame) -> DataFrame:
    """(doc_id, fp) rows -> (fp, n, component_id), a row per fingerprint, n documents of which have it."""
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(named, "root").select("fp", "n", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, that of its least doc_id, with all columns.

    Links are those of ``near_duplicates`` and those of texts whose 5-word shingles are similar (``similar``). Keys of texts are
    computed again rather than stored with texts.
    """
    rows = materialise(similar.with_keys(docs.select("doc_id", "text"), signed=True, more=("fp", signed_fingerprint)), "fingerprints")
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    leads = materialise(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    same = nodes.join(leads, "fp").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    of = lambda c: leads.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}"))
    near = links(leads.select("fp")).join(of("a"), "a").join(of("b"), "b").select("lead_a", "lead_b")
    joined = components(similar.with_similar(nodes.select("node", "bands", "sketch"), materialise(same.union(near), "near-links"), docs))
    placed = nodes.select("node", "least").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    winners = placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("node"))).alias("w"))
    winners = winners.select(F.col("w.node").alias("_node"), F.col("w.least").alias("_id"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    marked = similar.with_keys(whole, signed=False).select("_row", F.col("_row.doc_id").alias("doc_id"), "node")
    kept = marked.join(winners, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return kept.dropDuplicates(["_node", "_id"]).select("_row.*")
