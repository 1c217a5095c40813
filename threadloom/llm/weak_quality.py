r"""Quality classifier from weak labels.

1. Heuristic labellers (``votes``) each call a document bad (0), good (1) or abstain (-1), over statistics of its whole text.
   They overlap (most faults show in several of them) and err in different ways; none sees a label.
2. All documents' vote patterns are counted (at most 3 to the number of labellers rows, whatever the corpus). On these counts
   expectation-maximisation fits a two-class model: the share of good documents and, per labeller, how often it is right on either
   class when it votes; abstentions say nothing. It starts from the share of good votes of each pattern, treats both classes and all
   labellers alike, and adds ``SMOOTH`` to every count.
3. Posterior labels train a hashed linear scorer: logistic loss over hashed counts of word shapes and pairs of them, on at most
   ``TRAIN_ROWS`` documents, drawn by a hash of id and text. Only their sparse features travel to the driver.
4. Every document is scored; ``keep`` at one half.

Defined results: null text is empty: all labellers abstain, and it scores like other texts without words; null and
repeated ids keep their rows, and rows of one text have one score; very long texts are counted whole; a score of exactly one half is kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialise, text_of
from threadloom.llm.quality_rules import rule_stats
from threadloom.session import ship

LABELLERS = ("symbols", "capitals", "dup_lines", "repeats", "word_length", "sentences", "letters", "variety", "plain_words")
TRAIN_ROWS, BITS, EPOCHS, SMOOTH, BATCH = 6000, 14, 12, 1.0, 16


def more_stats(text: Column) -> dict[str, Column]:
    """What the labellers count beside rule_stats: words that end a sentence, letters, words of nothing but letters."""
    return {
        "n_ends": F.regexp_count(text, F.lit(r"[.!?](?![^\x20\x09-\x0D])")).cast("long"),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long"),
        "n_plain": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])\p{L}++[.,!?;:]?+(?![^\x20\x09-\x0D])")).cast("long"),
    }


def votes() -> list[Column]:
    """A vote per labeller, from the columns of rule_stats and more_stats; fixed values are shares in hundredths."""
    n, chars, lines, c = F.col("n_words"), F.col("word_chars"), F.col("n_lines"), F.col
    vote = lambda enough, bad, good: F.when(enough & bad, 0).when(enough & good, 1).otherwise(-1).alias
    over = lambda part, whole, limit: 100 * c(part) > limit * whole
    ends, variety = 100 * c("n_ends"), c("n_distinct") * c("n_distinct")
    return [
        vote(n >= 1, over("n_symbols", n, 20), ~over("n_symbols", n, 2))("symbols"),
        vote(n >= 8, over("n_capitals", chars, 30), ~over("n_capitals", chars, 8))("capitals"),
        vote(lines >= 4, over("n_dup_lines", lines, 40), ~over("n_dup_lines", lines, 10))("dup_lines"),
        vote(n >= 8, over("n_repeat_words", n, 50), ~over("n_repeat_words", n, 15))("repeats"),
        vote(n >= 20, (10 * chars > 72 * n) | (chars < 3 * n), (10 * chars <= 60 * n) & (chars >= 4 * n))("word_length"),
        F.when((n >= 30) & ((ends < 2 * n) | (ends > 60 * n)), 0).when((n >= 8) & (ends >= 4 * n) & (ends <= 25 * n), 1).otherwise(-1).alias("sentences"),
        vote(chars >= 20, 100 * c("n_letters") < 90 * chars, 100 * c("n_letters") >= 94 * chars)("letters"),
        vote(n >= 20, variety < 12 * n, variety >= 20 * n)("variety"),
        vote(n >= 8, 100 * c("n_plain") < 70 * n, 100 * c("n_plain") >= 90 * n)("plain_words"),
    ]


def posterior(good: float, table: list[list[list[float]]], pattern: tuple[int, ...]) -> float:
    """P(good | votes) under the model: P(vote | class) is table[labeller][class][vote]."""
    odds = math.log(good / (1 - good)) + sum(math.log(table[k][1][v] / table[k][0][v]) for k, v in enumerate(pattern) if v >= 0)
    return 1 / (1 + math.exp(-max(min(odds, 50), -50)))


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> tuple[float, list[list[list[float]]], dict[tuple[int, ...], float]]:
    """EM over vote patterns and their counts: share of good, P(vote | class) by labeller [class][vote], posterior of good by pattern."""
    if not patterns:
        return 0.5, [], {}
    post = {p: (1 + sum(v == 1 for v in p)) / (2 + sum(v >= 0 for v in p)) for p, _ in patterns}
    total, good, table = sum(n for _, n in patterns), 0.5, []
    for _ in range(rounds):
        good = (SMOOTH + sum(n * post[p] for p, n in patterns)) / (2 * SMOOTH + total)
        count = [[[SMOOTH] * 2, [SMOOTH] * 2] for _ in patterns[0][0]]
        for p, n in patterns:
            for k, v in enumerate(p):
                if v >= 0:
                    count[k][1][v] += n * post[p]
                    count[k][0][v] += n * (1 - post[p])
        table = [[[c / sum(row) for c in row] for row in rows] for rows in count]
        new = {p: posterior(good, table, p) for p, _ in patterns}
        moved, post = max(abs(new[p] - post[p]) for p in new), new
        if moved < 1e-9:
            break
    return good, table, post


_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Hashed counts of the shapes of words and of neighbouring pairs, and of how words and lines repeat, scaled to length one."""
    import xxhash

    text = text or ""
    words = text.split()
    shapes = _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("\x00", text)).replace("\x00", "X")).split()
    count: Counter = Counter(shapes)
    count.update(f"{a} {b}" for a, b in zip(shapes, shapes[1:]))
    lines = [x for x in text.split("\n") if x]
    n = len(words)
    value = {f: c / n for f, c in count.items()} if n else {}
    value[f"types {int(8 * len(set(words)) / n) if n else 'none'}"] = 0.7
    value[f"lines {int(8 * len(set(lines)) / len(lines)) if lines else 'none'}"] = 0.7
    value[f"size {int(2 * len(text) / (n + 1))}"] = 0.7
    scale = math.sqrt(sum(v * v for v in value.values()))
    index: dict[int, float] = {}
    for f, v in value.items():
        k = xxhash.xxh32_intdigest(f.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        index[k] = index.get(k, 0.0) + v / scale
    return list(index), list(index.values())


def scores(w, rows):
    """w @ x plus the bias, the last weight, for each (indices, values)."""
    import numpy as np

    size = np.array([len(i) for i, _ in rows])
    index, value = np.concatenate([i for i, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows])
    return np.add.reduceat(w[index] * value, np.cumsum(size) - size) + w[-1]  # no row is empty


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(rows: list[tuple[list[int], list[float], float]], epochs: int = EPOCHS, step: float = 0.5, decay: float = 1e-5):
    """Weights (the last one the bias) by adaptive steps on the logistic loss against soft labels, ``BATCH`` documents at a time."""
    import numpy as np

    w, s = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    data = [(np.array(i, dtype=np.int64), np.array(v), y) for i, v, y in rows]
    order = np.random.default_rng(1)
    for _ in range(epochs):
        drawn = order.permutation(len(data))
        for at in range(0, len(drawn), BATCH):
            own = [data[k] for k in drawn[at : at + BATCH]]
            wrong = sigmoid(scores(w, [r[:2] for r in own])) - np.array([r[2] for r in own])
            index = np.concatenate([i for i, _, _ in own])
            some, place = np.unique(index, return_inverse=True)
            g = np.bincount(place, np.concatenate([e * v for e, (_, v, _) in zip(wrong, own, strict=True)])) + decay * w[some]
            some, g = np.append(some, 1 << BITS), np.append(g, wrong.sum())
            s[some] += g * g
            w[some] -= step * g / np.sqrt(s[some])
    return w


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score, keep) of every row."""
    spark = ship(docs.sparkSession)
    own = docs.select("doc_id", "text")
    key = F.xxhash64("doc_id", "text")
    more = more_stats(text_of())
    voted = materialise(rule_stats(own.withColumns({"key": key, **more}), ["key", *more]).select("key", F.array(*votes()).alias("votes")), "votes")
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).sort("votes").collect()  # at most 3 ** len(LABELLERS) rows
    found = fit_votes([(tuple(r["votes"]), r["n"]) for r in counted])[2]
    table = spark.createDataFrame([(list(p), float(v)) for p, v in found.items()], "votes array<int>, posterior double")
    labelled = voted.join(F.broadcast(table), "votes")  # one row per pattern

    total = sum(r["n"] for r in counted)
    part = max(1, total // train_rows)
    sample = labelled.where(F.pmod("key", F.lit(part)) == 0).groupBy("key").agg(F.first("posterior").alias("posterior")).sort("key").limit(train_rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["key", "i", "v"])

    texts = own.select(key.alias("key"), "text").where(F.pmod("key", F.lit(part)) == 0).mapInArrow(featurise, "key long, i array<int>, v array<double>")
    rows = texts.join(sample, "key").select("key", "i", "v", "posterior").sort("key").limit(train_rows).collect()
    weights = train([(r["i"], r["v"], r["posterior"]) for r in rows])
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = scores(shared.value, [features(t.as_py()) for t in batch.column(1)]) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(z), pa.float64())], names=["doc_id", "score"])

    scored = own.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("keep", F.col("score") >= 0.5)
