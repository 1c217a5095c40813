r"""Packing documents into sequences by order-preserving dynamic programming.

Documents keep the order in which a partition reads them, as one stream of ids with an end id after each. Any place may
be cut: document ends are free, sentence ends have a small penalty, other places a larger one. With cut penalties c, the
cheapest cut chain over places j obeys

    cost(j) = c(j) + min over j - window <= i < j of cost(i) + window - (j - i)

and since padding is linear the minimum is of f(i) = cost(i) + i over a sliding window. Its monotone queue (the suffix minima of
the window) is held for a window's worth of places at a time: an accumulated minimum from the right gives the queue's front for every place,
and one from the left takes the new values in; these can't lower each other's minima, as each is a window above one before it. So
the optimum over all places takes constant amortised time a place.

The stream is cut in blocks; what follows a block's last good cut is carried on, so memory is a block and the longest document. The
rest of a partition is cut by a dynamic program that also knows where it ends: there a sequence of a power of two needs no padding.

No shuffle: partitions are those of the input. Ids are reproducible from it, so a lost task gives the same sequences
again. Defined results: null text is empty (only its end id); null and repeated ids are packed like others; very long texts are
cut like others; of equally cheap chains the one with the later previous cut is taken; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from threadloom.llm.tokens import encoder
from threadloom.session import ship

WINDOW, END_ID, BLOCK = 2048, 1, 1 << 18
SENTENCE_COST, PLAIN_COST = 2.0, 10.0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long"


def penalties(ids, doc_ends, closes):
    """What a cut costs at each place from 0 to the end."""
    import numpy as np

    cost = np.full(len(ids) + 1, PLAIN_COST)
    cost[1:][closes[np.minimum(ids, len(closes) - 1)]] = SENTENCE_COST
    cost[doc_ends] = 0.0
    cost[0] = 0.0
    return cost


def cut_costs(penalty, window: int = WINDOW):
    """cost(i) + i of every place i: the least cost of a chain of sequences that ends there, and the place."""
    import numpy as np

    total = len(penalty) - 1
    f = np.empty(total + 1)
    f[0] = 0.0
    for begin in range(1, total + 1, window):
        stop = min(begin + window, total + 1)
        n = stop - begin
        old = f[max(0, begin - window) : begin]
        front = np.minimum.accumulate(old[::-1])[::-1]
        # place j sees old places from j - window on: all of them first, then one fewer at a time
        first = np.maximum(np.arange(begin, stop) - window, 0) - max(0, begin - window)
        queue = front[first]
        own = penalty[begin:stop] + window + queue
        if n > 1:
            newer = np.minimum.accumulate(own)[:-1]
            own[1:] = penalty[begin + 1 : stop] + window + np.minimum(queue[1:], newer)
        f[begin:stop] = own
    return f


def cut_chain(f, end: int, window: int = WINDOW) -> list[int]:
    """The cuts of a cheapest chain to ``end``, itself the last."""
    out = []
    while end:
        out.append(end)
        low = max(0, end - window)
        end -= 1 + int(f[low:end][::-1].argmin())
    return out[::-1]


def padding(length: int, window: int = WINDOW) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def closing(penalty, window: int = WINDOW) -> tuple[list[float], list[int]]:
    """For each place of the stream's last places (at most a window of them): the least cost of the sequences from there to the end, and the next cut."""
    import numpy as np

    n = len(penalty) - 1
    pads = np.array([padding(k, window) for k in range(n + 1)], dtype=float)
    rest, after = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    for x in range(n - 1, -1, -1):
        value = pads[1 : n - x + 1] + penalty[x + 1 :] + rest[x + 1 :]
        k = int(value.argmin())
        rest[x], after[x] = value[k], x + 1 + k
    return rest.tolist(), after.tolist()


def cuts(ids, doc_ends, closes, last: bool, window: int = WINDOW) -> list[int]:
    """End positions of the sequences of a block; if it is the last one they reach its end, else the rest is carried on."""
    import numpy as np

    total = len(ids)
    penalty = penalties(ids, doc_ends, closes)
    f = cut_costs(penalty, window)
    low = max(0, total - window)
    if last:
        tail = penalty[low:].copy()
        tail[-1] = 0.0
        rest, after = closing(tail, window)
        at = int((f[low:] - np.arange(low, total + 1) + np.array(rest)).argmin())
        ends = cut_chain(f, low + at, window)
        while at < total - low:
            at = after[at]
            ends.append(low + at)
        return ends
    # the final cut lies within a window of the end: the cheapest one for what it leaves behind
    return cut_chain(f, low + int(f[low:].argmin()), window)


class Packer:
    """One partition's stream."""

    def __init__(self, vocabulary: str | None, window: int, first_sequence: int):
        self.encoder, self.window, self.sequence = encoder(vocabulary), window, first_sequence
        self.closes = self.encoder.sentence_ends()
        self.docs: list[tuple] = []  # (doc_id, ids not yet packed, ids already packed, all its ids)
        self.size = 0

    def add(self, doc_id, text) -> None:
        import numpy as np

        ids = np.array([*self.encoder.encode(text, special=True), END_ID], dtype="<u4")
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.size += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        import numpy as np

        if not self.docs:
            return []
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        sequences, rows = cuts(ids, ends, self.closes, last, self.window), []
        doc, at, begin = 0, 0, 0
        for end in sequences:
            length = end - begin
            padded = length if length & (length - 1) == 0 else self.window
            while at < end:
                first = int(ends[doc - 1]) if doc else 0
                stop = min(end, int(ends[doc]))
                doc_id, _, packed, tokens = self.docs[doc]
                rows.append((doc_id, packed + at - first, stop - at, ids[at:stop].tobytes(), tokens, self.sequence, at - begin, padded))
                at = stop
                doc += at == int(ends[doc])
            self.sequence += 1
            begin = end
        if doc < len(self.docs):
            first = int(ends[doc - 1]) if doc else 0
            doc_id, own, packed, tokens = self.docs[doc]
            self.docs = [(doc_id, own[at - first :].copy(), packed + at - first, tokens), *self.docs[doc + 1 :]]
        else:
            self.docs = []
        self.size = sum(len(d[1]) for d in self.docs)
        return rows


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """A row per piece: its document, place and ids (little-endian unsigned 32-bit), the sequence, the place there, and the
    length to which the sequence is padded."""
    fields = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(vocabulary, window, TaskContext.get().partitionId() << 40)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.binary() if f == "ids" else pa.int64() for f in fields]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc_id.as_py(), text.as_py())
                if packer.size >= BLOCK and (rows := packer.flush(last=False)):
                    yield out(rows)
        if rows := packer.flush(last=True):
            yield out(rows)

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
