r"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. An item of L words counts as leaked into a document if a local
alignment of the two matches at least ``SIMILARITY`` of its words (all of them if it has under eight).

* Seeds. An item is cut into blocks of four words (three for items under 16), more blocks than words that may be
  replaced, so a copy within that limit leaves some block whole. A block's seed is the one of its 3-grams that the corpus
  holds in the fewest documents. Words put in can break every 3-gram, so an item of L words also has its L - needed + 1
  rarest words as seeds: an alignment leaves at most L - needed words unmatched, so it matches one of them wherever words
  were replaced, left out or put in. A first pass counts in how many documents each 3-gram and word of the items occurs.
* Join. A second pass looks the documents' 3-grams and words up in the seed tables. An item of which a document holds too few
  words goes no further by its words. A seed opens a window as wide as an alignment through it can be: scores never fall
  below 0, so it has at most two words put in for each one matched. Windows that overlap are joined; those with too few of
  the item's words are left (an upper bound of any alignment), the others are aligned.
* Alignment. Match 2, mismatch -1, gap -1, row by row in vectors; each cell carries score, matches and start. Of the
  alignments that match enough words the one of the best score counts.

Nothing of the documents is shuffled. The seed table goes to the tasks in chunks of at most ``CHUNK_WORDS`` words, checked
by counting. If there are several, each chunk's result is written before the next is read and its table dropped: a larger benchmark
takes more passes, not more memory.

Defined results: null or wordless texts and items match nothing; repeated items count once, an item id with several
texts is leaked by any of them; very long texts are looked through whole, windows at a time; items that match the same words each
have their row, and of alignments of one score the one of most matches counts, then the first; repeated documents and null ids keep a row each; empty tables give an empty result; other
columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialise
from threadloom.session import ship

WORD = re.compile(r"[^\W_]+")
GRAM, SIMILARITY, CHUNK_WORDS = 3, 0.8, 500_000
SCORE = 1 << 40
LEAKS = "doc_id long, item_id long, item_words int, matched int, score int, start int, end int"


def words(text: str | None) -> list[str]:
    text = text or ""
    # lower-casing some letters beyond ASCII changes how a text splits, so words are found first
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


def needed(length: int) -> int:
    """Words of an item that an alignment must match."""
    return length if length < 8 else -int(-SIMILARITY * length // 1)


def align(item, text, least: int = 0):
    """Best local alignment of two id arrays among those that match ``least`` words: (score, matches, start and end in text).

    Ties: most matches, latest start, first end.
    """
    import numpy as np

    n = len(text)
    zero = np.arange(n + 1, dtype=np.int64)
    ramp = zero * SCORE
    row, best, end = zero.copy(), 0, 0
    for done, x in enumerate(item, 1):
        step = np.where(text == x, 2 * SCORE + (1 << 20), -SCORE)
        cell = np.maximum(zero, row - SCORE)
        cell[1:] = np.maximum(cell[1:], row[:-1] + step)
        row = np.maximum.accumulate(cell + ramp) - ramp
        row = np.maximum(row, zero)
        if done < least:
            continue
        at = int((np.where((row >> 20 & 0xFFFFF) >= least, row, 0) if least else row).argmax())
        if ((row[at] >> 20) & 0xFFFFF) >= least and (row[at] >> 20, -at) > (best >> 20, -end):
            best, end = int(row[at]), at
    return best >> 40, (best >> 20) & 0xFFFFF, best & 0xFFFFF, end


class Seeds:
    """Items of a chunk with their 3-grams, and, once counts are known, the seed of each block and the rare words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if ids:
                self.items.append((item_id, ids))
        self.keys, self.places = None, None

    @staticmethod
    def key(a: int, b: int, c: int) -> int:
        return a << 42 | b << 21 | c

    def grams(self, ids: list[int]) -> list[int]:
        """The key at each place; none for items of under three words, which are looked for by their words."""
        return [self.key(*ids[k : k + GRAM]) for k in range(len(ids) - GRAM + 1)]

    def all_keys(self):
        import numpy as np

        return np.unique(np.array([g for _, ids in self.items for g in self.grams(ids)], dtype=np.int64))

    @staticmethod
    def word_key(word: int) -> int:
        """The key of a word among the counts; those of 3-grams aren't negative."""
        return -1 - word

    def choose(self, count: dict[int, int]) -> None:
        import numpy as np

        found: list[tuple[int, int, int]] = []
        rare_words: list[tuple[int, int, int]] = []
        for k, (_, ids) in enumerate(self.items):
            grams = self.grams(ids)
            block = 4 if len(ids) >= 16 else 3
            for at in range(0, len(ids) - block + 1, block):
                own = range(at, at + block - GRAM + 1)
                rare = min(own, key=lambda p: (count.get(grams[p], 0), p))
                found.append((grams[rare], k, rare))
            if len(ids) >= GRAM:
                order = sorted(range(len(ids)), key=lambda p: (count.get(self.word_key(ids[p]), 0), p))
                rare_words += [(ids[p], k, p) for p in order[: len(ids) - needed(len(ids)) + 1]]
        found.sort()
        rare_words.sort()
        self.rare = np.array(rare_words, dtype=np.int64).reshape(-1, 3)
        self.keys = np.array([f[0] for f in found], dtype=np.int64)
        self.places = np.array([f[1:] for f in found], dtype=np.int64).reshape(-1, 2)
        self.arrays = [np.array(ids, dtype=np.int64) for _, ids in self.items]
        self.short = [k for k, (_, ids) in enumerate(self.items) if len(ids) < GRAM]

    def ids(self, tokens: list[str]):
        import numpy as np

        get = self.vocabulary.get
        return np.array([get(w, -1) for w in tokens], dtype=np.int64)

    @staticmethod
    def text_keys(ids):
        """Keys of the places where three known words stand, and the places."""
        import numpy as np

        if len(ids) < GRAM:
            return ids[:0], ids[:0]
        at = np.flatnonzero((ids[:-2] | ids[1:-1] | ids[2:]) >= 0)
        return (ids[at] << 42) | (ids[at + 1] << 21) | ids[at + 2], at

    def leaks(self, ids) -> list[tuple[int, int, int, int, int, int]]:
        """(item number, item words, matched, score, first and past-last word) of the items that a text leaks, best alignment each."""
        import numpy as np

        out = []
        for k in self.short:
            own = self.arrays[k]
            hit = np.flatnonzero((ids[: len(ids) - len(own) + 1] == own[0]) & (ids[len(own) - 1 :] == own[-1]))
            if len(hit):
                out.append((k, len(own), len(own), 2 * len(own), int(hit[0]), int(hit[0]) + len(own)))
        keys, at = self.text_keys(ids)
        lo = np.searchsorted(self.keys, keys, "left")
        hi = np.searchsorted(self.keys, keys, "right")
        windows: dict[int, list[tuple[int, int]]] = {}

        def open_windows(k: int, place: int, at: list[int]) -> None:
            size = len(self.arrays[k])
            windows.setdefault(k, []).extend((x - 3 * place, x - place + 3 * size) for x in at)

        for h in np.flatnonzero(hi > lo):
            for s in range(lo[h], hi[h]):
                k, place = self.places[s]
                open_windows(int(k), int(place), [int(at[h])])
        held = np.unique(ids[ids >= 0])
        by_item: dict[int, list[tuple[int, int]]] = {}
        first, last = np.searchsorted(self.rare[:, 0], held, "left"), np.searchsorted(self.rare[:, 0], held, "right")
        for h in np.flatnonzero(last > first):
            for word, k, place in self.rare[first[h] : last[h]].tolist():
                by_item.setdefault(k, []).append((word, place))
        for k, seeds in by_item.items():
            own = self.arrays[k]
            near = np.minimum(np.searchsorted(held, own), len(held) - 1)
            if int((held[near] == own).sum()) >= needed(len(own)):
                for word, place in seeds:
                    open_windows(k, place, np.flatnonzero(ids == word).tolist())
        for k, spans in windows.items():
            own, best = self.arrays[k], None
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                a, b = max(a, 0), min(b, len(ids))
                part = ids[a:b]
                if int(np.isin(part, own).sum()) < needed(len(own)):
                    continue
                score, matched, start, end = align(own, part, needed(len(own)))
                if matched >= needed(len(own)) and (best is None or (score, matched) > best[:2]):
                    best = (score, matched, a + start, a + end)
            if best:
                out.append((k, len(own), best[1], best[0], best[2], best[3]))
        return out


def chunk_filters(items: DataFrame, most_words: int | None = None) -> Iterator[DataFrame]:
    """The benchmark's distinct rows in chunks of bounded size, each to be collected by itself."""
    most_words = most_words or CHUNK_WORDS
    rows = items.where("text is not null").select("item_id", "text").distinct()
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    parts = -(-2 * total // most_words) if total > most_words else 1
    for k in range(parts):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else rows


def _document_counts(docs: DataFrame, seeds: Seeds) -> dict[int, int]:
    """In how many documents each 3-gram and word of the chunk occurs; at most a number for each comes back."""
    own = docs.sparkSession.sparkContext.broadcast((seeds, seeds.all_keys()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table, keys = own.value
        count = np.zeros(len(keys) + 1, dtype=np.int64)
        word_count = np.zeros(len(table.vocabulary), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                ids = table.ids(words(text.as_py()))
                found, _ = table.text_keys(ids)
                word_count[np.unique(ids[ids >= 0])] += 1
                at = np.searchsorted(keys, found)
                at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == found)] if len(keys) else at[:0]
                count[np.unique(at)] += 1
        some, known = np.flatnonzero(count), np.flatnonzero(word_count)
        gram = np.concatenate([keys[some], table.word_key(known)])
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.concatenate([count[some], word_count[known]]))], names=["gram", "n"])

    per_task = docs.select("text").mapInArrow(run, "gram long, n long")
    counts = {r["gram"]: r["n"] for r in per_task.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    own.destroy()
    return counts


def _by_chunk(docs: DataFrame, items: DataFrame, step, fold) -> DataFrame:
    """fold of step(docs, chunk) over the chunks; all but an only chunk's results are written, and its tables dropped, before the next."""
    ship(docs.sparkSession)
    parts, result = list(chunk_filters(items)), None
    for rows in parts:
        seeds = Seeds([tuple(r) for r in rows.sort("item_id", "text").collect()])
        seeds.choose(_document_counts(docs, seeds))
        own = docs.sparkSession.sparkContext.broadcast(seeds)
        found = step(docs, own)
        if len(parts) > 1:
            found = materialise(found, "leaks")
            own.destroy()
        docs, result = fold(docs, result, found)
    return result


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document and leaked item: matched words, score and the span of characters in the text."""

    def step(docs: DataFrame, own) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in LEAKS.split(", ")]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    text = text.as_py() or ""
                    ids = own.value.ids(words(text))
                    if hits := own.value.leaks(ids):
                        spans = [m.span() for m in WORD.finditer(text)]
                        rows += [(doc_id.as_py(), own.value.items[k][0], n, matched, score, spans[a][0], spans[b - 1][1]) for k, n, matched, score, a, b in hits]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        return docs.select("doc_id", "text").mapInArrow(run, LEAKS)

    return _by_chunk(docs, items, step, lambda docs, result, found: (docs, found if result is None else result.union(found)))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns; no shuffle."""

    def step(docs: DataFrame, own) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                clean = [not own.value.leaks(own.value.ids(words(t.as_py()))) for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    return _by_chunk(docs, items, step, lambda docs, result, found: (found, found))
