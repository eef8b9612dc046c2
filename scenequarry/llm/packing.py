"""Pack token pieces into sequences by fitting length patterns to the histogram.

A pattern is a few lengths that fill a sequence exactly. Non-negative least
squares finds how often to repeat each pattern so that together they use up
the histogram of lengths; the repeat counts are rounded within what is left,
and the residual goes by best fit decreasing. All of this sees counts of at
most ``capacity`` lengths, never documents, so its size does not follow the
input. Documents then look up their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage, salted_rank, slices
from .word_cache import cached_encoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Steps of the fit.
STEPS = 300


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, special_as_text: bool = False) -> DataFrame:
    """Cut each document's ids into pieces; only the first may be shorter than ``capacity``.

    A null or empty text has the end id alone; a text of any length is cut
    whole. Repeated rows stay repeated, a null doc_id stays null, and columns
    other than doc_id and text are ignored, whatever their names.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached_encoder(tokenizer, special_as_text)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            out = defaultdict(list)
            ids_of = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of):
                ids += tail
                n, at = len(ids) // 4, 0
                end = n % capacity or capacity
                k = 0
                while at < n:
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(at)
                    out["length"].append(end - at)
                    out["ids_crc32"].append(zlib.crc32(ids[4 * at : 4 * end]))
                    at, end, k = end, end + capacity, k + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def patterns(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Few-length patterns that fill a sequence: rows of three indexes into ``lengths`` (-1: none), and how often each is used.

    All of one, two and three pieces, and all of one length repeated thrice or
    more with at most one other piece. They grow with the square of
    ``capacity``, never with the input.
    """
    place = np.full(capacity + 1, -1)
    place[lengths] = np.arange(len(lengths))
    rows, uses = [], []

    def add(*columns: tuple[np.ndarray, int | np.ndarray]) -> None:
        """One column is (indexes, times); a row counts if none of its indexes is missing."""
        whole = np.logical_and.reduce([i >= 0 for i, _ in columns])
        n, spare = int(whole.sum()), 3 - len(columns)
        rows.append(np.column_stack([*(i[whole] for i, _ in columns), *[np.full(n, -1)] * spare]))
        uses.append(np.column_stack([*(np.broadcast_to(t, whole.shape)[whole] for _, t in columns), *[np.zeros(n, int)] * spare]))

    add((place[[capacity]], 1))
    small = lengths[lengths * 2 <= capacity]
    add((place[small], 1), (place[capacity - small], 1))
    for a in lengths[lengths * 3 <= capacity]:
        mid = lengths[(lengths >= a) & (lengths * 2 <= capacity - a)]
        add((np.full(len(mid), place[a]), 1), (place[mid], 1), (place[capacity - a - mid], 1))
        times = np.arange(3, capacity // a + 1)
        left = capacity - a * times
        same = np.full(len(times), place[a])
        add((same[left > 0], times[left > 0]), (np.where(left[left > 0] == a, -1, place[left[left > 0]]), 1))
        add((same[(left == 0) & (times > 3)], times[(left == 0) & (times > 3)]))
    rows, uses = np.concatenate(rows), np.concatenate(uses)
    return rows, uses


def fit(rows: np.ndarray, uses: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x of least squares between the patterns' uses and ``counts``.

    Accelerated projected gradient; each step costs one gather and one bincount.
    """
    n = len(counts)
    if not len(rows):
        return np.zeros(0)
    index = np.where(rows < 0, n, rows).ravel()
    times = uses.astype(float)
    target = np.append(counts, 0.0)
    used = lambda x: np.bincount(index, (x[:, None] * times).ravel(), n + 1)
    back = lambda r: (r[index].reshape(times.shape) * times).sum(axis=1)
    v = np.ones(len(rows))
    for _ in range(20):
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(used(y) - target) / (1.05 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """Slots in order of the global position axis (by length, then rank): the
    ``mult`` copies of a length at ``offset`` in each sequence from ``base`` on."""

    first: np.ndarray
    base: np.ndarray
    mult: np.ndarray
    offset: np.ndarray
    n_sequences: int
    length_start: dict[int, int]
    residual: int  # tokens that patterns left to best fit


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences for all pieces of a histogram of lengths (1 to ``capacity``)."""
    lengths = np.array(sorted(k for k, c in histogram.items() if c), dtype=int)
    left = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    n_seq = 0
    rows, uses = patterns(lengths, capacity)
    x = fit(rows, uses, left.astype(float))
    for p in np.argsort(-x, kind="stable"):
        want = int(round(x[p]))
        if want < 1:
            break
        need: dict[int, int] = defaultdict(int)
        for i, times in zip(rows[p], uses[p]):
            if i >= 0:
                need[int(i)] += int(times)
        n = min(want, *(int(left[i]) // k for i, k in need.items()))
        if n < 1:
            continue
        at = 0
        for i, k in need.items():
            slots[int(lengths[i])].append((n * k, n_seq, k, at))
            left[i] -= n * k
            at += k * int(lengths[i])
        n_seq += n
    residual = int((lengths * left).sum())
    n_seq = _best_fit(lengths, left, capacity, slots, n_seq)
    first, base, mult, offset, start, at = [], [], [], [], {}, 0
    for length in map(int, lengths):
        start[length] = at
        for n, b, k, o in slots[length]:
            first.append(at)
            base.append(b)
            mult.append(k)
            offset.append(o)
            at += n
    a = lambda v: np.asarray(v, dtype=np.int64)
    return Plan(a(first), a(base), a(mult), a(offset), n_seq, start, residual)


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int, slots: dict, n_seq: int) -> int:
    """Best fit decreasing over counts: runs of equal sequences are filled together."""
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first sequence, how many)
    rooms: set[int] = set()

    def close(first: int, n: int, room: int) -> None:
        if n and room:
            open_[room].append((first, n))
            rooms.add(room)

    for length, c in sorted(zip(map(int, lengths), map(int, left)), reverse=True):
        while c:
            fits = [r for r in rooms if r >= length]
            if fits:
                room = min(fits)
                first, n = open_[room].pop()
                if not open_[room]:
                    rooms.discard(room)
            else:
                room = capacity
                first, n = n_seq, -(-c // (capacity // length))
                n_seq += n
            k = min(room // length, c)
            full = min(n, c // k)
            at = capacity - room
            slots[length].append((full * k, first, k, at))
            c -= full * k
            close(first, full, room - k * length)
            if full < n and c and c < k:
                slots[length].append((c, first + full, c, at))
                close(first + full, 1, room - c * length)
                full, c = full + 1, 0
            close(first + full, n - full, room)
    return n_seq


def pack(cut: DataFrame, capacity: int = CAPACITY, seed: int = 7) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset``; an empty table gives no rows.

    Rows with null or repeated doc_ids are packed like any other; rows alike in
    all columns are interchangeable. The histogram (at most ``capacity`` rows) is all that comes to the driver
    and the plan all that is sent out.
    """
    spark = cut.sparkSession
    cut = cut_lineage(cut)
    counts = cut.groupBy("length").agg(F.count(F.lit(1)).alias("_of_length"))
    histogram = {int(r[0]): int(r[1]) for r in counts.collect()}
    made = plan(histogram, capacity)
    sent = spark.sparkContext.broadcast(made)
    known = spark.createDataFrame(list(histogram.items()) or [(0, 0)], "length long, _of_length long")
    ranked = salted_rank(cut.join(F.broadcast(known), "length"), ["length"], "_of_length", ["doc_id", "piece"], seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            position = rank + np.array([p.length_start[k] for k in length.tolist()], dtype=np.int64)
            slot = np.searchsorted(p.first, position, side="right") - 1
            within = position - p.first[slot]
            sequence = p.base[slot] + within // p.mult[slot]
            offset = p.offset[slot] + within % p.mult[slot] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    chosen = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return chosen.mapInArrow(place, PIECES + ", sequence_id long, offset long")
