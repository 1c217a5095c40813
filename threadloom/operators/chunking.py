"""Sentence chunkers by page or document; sequential, so one document at a time in Arrow batches."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.grouped import per_group


def page_text(items: DataFrame) -> DataFrame:
    """items(page, place, text) -> the text of each page, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return items.groupBy("page").agg(F.array_join(ordered, " ").alias("text"))


#: Vectors a block of a group holds on average.
BLOCK_ROWS = 20_000


def min_pairwise_cosine(vectors: DataFrame, by: str) -> DataFrame:
    """vectors(by, vec): least cosine of two different vectors of a group, 1 for fewer than two.

    Groups are compared block by block, in as many blocks as a group's counted rows ask for, so no task holds a whole group twice over.
    """
    rows = vectors.where("vec is not null")
    blocks = rows.groupBy(by).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.select(by, "vec", F.monotonically_increasing_id().alias("i")).join(blocks, by).withColumn("b", F.pmod(F.hash("vec"), F.col("blocks")))
    left = rows.select(by, F.col("b").alias("x"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("y"), "vec", "i")
    right = rows.select(F.col(by).alias(by), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("x"), F.col("b").alias("y"), F.col("vec").alias("vec"), F.col("i").alias("i"))
    kind = dict(vectors.dtypes)[by]

    def least(a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({by: [], "least": []})
        x, y = np.stack(a["vec"].to_numpy()).astype(float), np.stack(b["vec"].to_numpy()).astype(float)
        scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        c = np.divide(x @ y.T, scale, out=np.zeros(scale.shape), where=scale > 0)
        c[a["i"].to_numpy()[:, None] == b["i"].to_numpy()[None, :]] = 1.0
        return pd.DataFrame({by: [a[by].iloc[0]], "least": [c.min()]})

    found = left.groupBy(by, "x", "y").cogroup(right.groupBy(by, "x", "y")).applyInPandas(least, f"{by} {kind}, least double")
    return found.groupBy(by).agg(F.least(F.min("least"), F.lit(1.0)).alias("min_cosine"))


def chunk_spans(vectors, words: list[int], least: float, most_words: int, ahead: int, overlap_words: int) -> list[tuple[int, int]]:
    """Greedy chunks of consecutive sentences: grow while the next sentence, or one within ``ahead``, is at least ``least`` alike to the chunk's
    centroid and the words fit; the next chunk starts back by the overlap, always beyond the start of the last."""
    import numpy as np

    v = np.asarray(vectors, dtype=float)
    length, upto = np.linalg.norm(v, axis=1), [0, *itertools.accumulate(words)]
    spans, start, n = [], 0, len(words)
    while start < n:
        end, total, centre = start + 1, words[start], v[start].copy()
        while end < n:
            scale = length[end : end + ahead] * math.sqrt(centre @ centre)
            fits = (scale > 0) & (v[end : end + ahead] @ centre >= least * scale)
            step = int(fits.argmax()) + 1
            more = upto[end + step] - upto[end]
            if not fits[step - 1] or total + more > most_words:
                break
            centre += v[end] if step == 1 else v[end : end + step].sum(axis=0)
            total += more
            end += step
        spans.append((start, end))
        if end >= n:
            break
        back, held = end, 0
        while back > start + 1 and held + words[back - 1] <= overlap_words:
            back -= 1
            held += words[back]
        start = back
    return spans


def max_min_spans(vectors, window: int = 5, legacy: bool = True) -> list[tuple[int, int]]:
    """Segments whose least pairwise cosine is best among look-ahead ends. The legacy reading scores a lone sentence 1 and needs a strictly
    better end, so every segment is one sentence; otherwise ends start at two sentences."""
    import numpy as np

    v = np.asarray(vectors, dtype=float)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    spans, k, n = [], 0, len(v)
    while k < n:
        if legacy or k + 1 == n:
            end = k + 1
        else:
            scores = [(float((unit[k:e] @ unit[k:e].T)[~np.eye(e - k, dtype=bool)].min()), -e) for e in range(k + 2, min(k + window, n) + 1)]
            end = -max(scores)[1]
        spans.append((k, end))
        k = end
    return spans


def coalesce_short(spans: list[tuple[int, int]], words: list[int], least: int, most: int) -> list[tuple[int, int]]:
    """Chunks under ``least`` words join the one before them; chunks over ``most`` are cut at sentences."""
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and (sum(words[a:b]) < least or sum(words[merged[-1][0] : merged[-1][1]]) < least):
            merged[-1][1] = b
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        start, held = a, 0
        for k in range(a, b):
            if held and held + words[k] > most:
                out.append((start, k))
                start, held = k, 0
            held += words[k]
        out.append((start, b))
    return out


def chunked(sentences: DataFrame, by: str, least: float = 0.25, most_words: int = 380, ahead: int = 6, overlap_words: int = 120) -> DataFrame:
    """sentences(by, k, sentence, vec) -> (by, chunk, first, last, text)."""
    kind = dict(sentences.dtypes)[by]

    def run(rows: list[dict]) -> list[tuple]:
        text = [r["sentence"] for r in rows]
        spans = chunk_spans([r["vec"] for r in rows], [len(s.split()) for s in text], least, most_words, ahead, overlap_words)
        return [(rows[0][by], c, a, b - 1, " ".join(text[a:b])) for c, (a, b) in enumerate(spans)]

    return per_group(sentences.select(by, "k", "sentence", "vec"), [by], ["k"], run, f"`{by}` {kind}, chunk int, first int, last int, text string")


def chunked_texts(docs: DataFrame, by: str, embed: Callable | None = None, least: float = 0.25, most_words: int = 380, ahead: int = 6, overlap_words: int = 120) -> DataFrame:
    """docs(by, sentences array) -> (by, chunk, first, last, text) as chunked() gives. A document is a row, so nothing is shuffled; ``embed`` gives a
    matrix of vectors for a list of sentences (hashed_vectors without one)."""
    kind, embed = dict(docs.dtypes)[by], embed or hashed_vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text := text.as_py():
                    spans = chunk_spans(embed(text), [len(s.split()) for s in text], least, most_words, ahead, overlap_words)
                    rows += [(key, c, a, b - 1, " ".join(text[a:b])) for c, (a, b) in enumerate(spans)]
            if rows:
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[by, "chunk", "first", "last", "text"])

    return docs.select(by, "sentences").mapInArrow(run, f"{by} {kind}, chunk int, first int, last int, text string")


def hashed_vectors(sentences: list[str], size: int = 16):
    """hashed_vector of each sentence, in a task's own process."""
    import numpy as np
    import xxhash

    out, of = np.zeros((len(sentences), size)), xxhash.xxh64_intdigest
    for k, s in enumerate(sentences):
        for w in s.lower().split():
            x = of(w.encode("utf-8", "surrogatepass"), 42)
            out[k, (x - (1 << 64) if x >> 63 else x) % size] += 1.0
    return out


def hashed_vector(text: Column, size: int = 16) -> Column:
    """Stand-in for an embedding model: counts of words by hash bucket."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")
    # a letter per word for its bucket, and a count per letter; up to 36 buckets
    ordered = F.array_join(F.transform(words, lambda w: F.conv(F.pmod(F.xxhash64(w), F.lit(size)).cast("string"), 10, 36)), "")
    return F.array(*[F.regexp_count(ordered, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[k])).cast("double") for k in range(size)])


def overlapping_spans(vectors, words: list[int], least: float, most_words: int, overlap_words: int, ahead: int) -> list[tuple[int, int]]:
    """Chunks that grow while the last sentence is at least ``least`` alike (dot product) to each of the ``ahead`` before the next one and the words
    are under ``most_words``; the next chunk starts back by sentences of ``overlap_words`` words, beyond the start of this one."""
    import numpy as np

    v = np.asarray(vectors, dtype=float)
    spans, i, n = [], 0, len(words)
    while i < n:
        total, last, j = words[i], i, i + 1
        while j < n and total < most_words and (v[max(i, j - ahead) : j] @ v[last] >= least).all():
            total, last, j = total + words[j], j, j + 1
        spans.append((i, j))
        if j >= n:
            break
        start, back, seen = i, j - 1, 0
        while back > start and seen < overlap_words:
            seen += words[back]
            back -= 1
        i = max(back + 1, start + 1) if overlap_words > 0 else j
    return spans


def coalesce_halving(spans: list[tuple[int, int]], words: list[int], least: int, most: int) -> list[tuple[int, int]]:
    """A chunk under ``least`` words takes up the next one; one over ``most`` is cut once, in the middle of its sentences."""
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and sum(words[merged[-1][0] : merged[-1][1]]) < least:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    out = []
    for a, b in merged:
        middle = (a + b) // 2
        out += [(a, b)] if sum(words[a:b]) <= most else [(a, middle), (middle, b)]
    return out


def coalesce_buffered(spans: list[tuple[int, int]], words: list[int], likeness: list[float | None], least: int = 160, most: int = 420) -> list[tuple[int, int, float | None]]:
    """Chunks under ``least`` words, and short ones that still fit, join the one before; those over ``most`` are cut between sentences. ``likeness`` is the
    least similarity within a chunk; a joined chunk has the least of its parts'."""
    merged: list[list] = []
    sizes: list[int] = []
    for (a, b), alike in zip(spans, likeness, strict=True):
        size = sum(words[a:b])
        if merged and (sizes[-1] < least or (size < least and sizes[-1] + size <= most)):
            held = merged[-1]
            held[1], sizes[-1] = b, sizes[-1] + size
            if held[2] is None or (alike is not None and alike < held[2]):
                held[2] = alike
        else:
            merged.append([a, b, alike])
            sizes.append(size)
    out = []
    for (a, b, alike), size in zip(merged, sizes, strict=True):
        start, held = a, 0
        for k in range(a, b) if size > most else ():
            if k > start and held + words[k] > most:
                out.append((start, k, alike))
                start, held = k, 0
            held += words[k]
        out.append((start, b, alike))
    return out
