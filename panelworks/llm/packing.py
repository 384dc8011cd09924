"""Packing of documents into sequences: Martello-Toth dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the instance is a histogram of one count per length,
however many documents there are. The reduction (Martello and Toth, 1990) goes through the lengths from
the largest down and fixes sequences that dominate every alternative: no optimum is lost by them. What
is left is packed best fit, longest first. Both work on whole counts, so the plan is a bounded list of
patterns with multiplicities. Documents get their place by their number among those of equal length,
counted within the tasks that encoded them plus the counts of the tasks before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.bpe import word_encoder
from panelworks.session import materialize

CAPACITY = 2048
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"


@dataclass
class Bins:
    """``count`` equal sequences: ``held`` lists (length, how many) in order, ``room`` is what is free."""

    count: int
    room: int
    held: list[tuple[int, int]] = field(default_factory=list)


class _Lengths:
    """Counts by length."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 2, np.int64)
        for length, count in counts.items():
            self.n[length] += count

    def largest(self, most: int) -> int:
        """The largest length up to ``most`` that is left; 0 without one."""
        there = np.flatnonzero(self.n[1 : most + 1]) if most > 0 else ()
        return int(there[-1]) + 1 if len(there) else 0

    def smallest(self, above: int, how_many: int) -> list[int]:
        """The smallest lengths above a bound, repeated as often as they are left."""
        out: list[int] = []
        for length in (np.flatnonzero(self.n[above + 1 :]) + above + 1).tolist():
            out += [length] * min(int(self.n[length]), how_many - len(out))
            if len(out) == how_many:
                break
        return out

    def take(self, group: list[int]) -> int:
        """Remove as many of a group of lengths as there are; how many that was."""
        need = {w: group.count(w) for w in group}
        times = min(int(self.n[w]) // k for w, k in need.items())
        for w, k in need.items():
            self.n[w] -= times * k
        return times


def _dominating(left: _Lengths, w: int, capacity: int) -> list[int] | None:
    """A sequence with one document of length ``w`` that dominates all others with it, if the rules find one.

    ``w`` itself is out of ``left``. With no document beside it, it stays alone; with at most one, the
    longest that fits joins it; so does one that fills the sequence. With at most two beside it, the
    longest that fits is enough where it is as long as any two, and the two longest together are, where
    no two that are both longer than the second would fit.
    """
    room = capacity - w
    small = left.smallest(0, 3)
    beside = 0
    while beside < len(small) and sum(small[: beside + 1]) <= room:
        beside += 1
    if beside == 0:
        return [w]
    first = left.largest(room)
    if beside == 1 or first == room:
        return [w, first]
    if beside > 2:
        return None
    pair = _longest_pair(left, room)
    if first >= sum(pair):
        return [w, first]
    if first == pair[0]:
        longer = left.smallest(pair[1], 2)
        if len(longer) < 2 or sum(longer) > room:
            return [w, *pair]
    return None


def _longest_pair(left: _Lengths, room: int) -> tuple[int, int]:
    """Two lengths (the longer first) of the largest sum that fits; of equal sums the longest first one."""
    n = left.n[: room + 1]
    upto = np.maximum.accumulate(np.where(n > 0, np.arange(room + 1), 0))  # the largest one there up to each length
    a = np.flatnonzero(n)[::-1]
    most = np.minimum(a, room - a)
    b = upto[np.where((most == a) & (n[a] == 1), a - 1, most)]
    best = int(np.argmax(np.where(b > 0, a + b, 0)))
    return int(a[best]), int(b[best])


def reduce_by_dominance(left: _Lengths, capacity: int) -> list[Bins]:
    """Fix dominating sequences until a pass over all lengths finds none; ``left`` shrinks to the rest.

    A rule that holds for a group holds for it again after it is taken: fewer documents fit beside,
    and the same ones remain the longest as long as any is left. So groups are taken all at once.
    """
    fixed, found = [], True
    while found:
        found = False
        for w in (np.flatnonzero(left.n)[::-1]).tolist():
            while left.n[w]:
                left.n[w] -= 1
                group = _dominating(left, w, capacity)
                left.n[w] += 1
                if group is None:
                    break
                times = left.take(group)
                fixed.append(Bins(times, capacity - sum(group), [(x, 1) for x in group]))
                found = True
    return fixed


def best_fit(left: _Lengths, capacity: int) -> list[Bins]:
    """Best fit of what is left, longest first: each document into the fullest sequence that has room."""
    by_room: dict[int, list[Bins]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(bins: Bins) -> None:
        if bins.count:
            by_room.setdefault(bins.room, []).append(bins)
            rooms[bins.room] = True

    for w in (np.flatnonzero(left.n)[::-1]).tolist():
        n = int(left.n[w])
        while n:
            fits = np.flatnonzero(rooms[w:capacity])
            if len(fits):
                room = int(fits[0]) + w
                bins = by_room[room].pop()
                rooms[room] = bool(by_room[room])
            else:
                bins, room = Bins(n, capacity), capacity
            each = room // w  # the sequence just used is the fullest one with room
            full = min(bins.count, n // each)
            put(Bins(full, room - each * w, [*bins.held, (w, each)]))
            n -= full * each
            bins = Bins(bins.count - full, bins.room, bins.held)
            if bins.count and n:
                put(Bins(1, room - n * w, [*bins.held, (w, n)]))
                bins.count -= 1
                n = 0
            if bins.held:
                put(bins)
        left.n[w] = 0
    return [b for bins in by_room.values() for b in bins]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Bins], int]:
    """Sequences for ``counts`` documents per length (1 to ``capacity``), and how many the reduction fixed."""
    left = _Lengths(counts, capacity)
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity), sum(b.count for b in fixed)


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences (bound L2 of Martello and Toth, over all thresholds)."""
    n = _Lengths(counts, capacity).n[: capacity + 1]
    size = n * np.arange(capacity + 1)
    best = -(-int(size.sum()) // capacity)
    for k in range(capacity // 2 + 1):
        big = int(n[capacity - k + 1 :].sum())  # longer than capacity - k: alone among those of k or more
        half = n[capacity // 2 + 1 : capacity - k + 1]
        room = int(half.sum()) * capacity - int(size[capacity // 2 + 1 : capacity - k + 1].sum())
        small = int(size[k : capacity // 2 + 1].sum())
        best = max(best, big + int(half.sum()) + max(0, -(-(small - room) // capacity)))
    return best


def _slots(bins: list[Bins]) -> dict[str, np.ndarray]:
    """Where the documents of each length go: ranges of their numbers, in order of (length, lo)."""
    rows, used, sequence = [], {}, 0
    for b in bins:
        at = 0
        for w, each in b.held:
            lo = used.get(w, 0)
            used[w] = lo + b.count * each
            rows.append((w, lo, sequence, each, at))
            at += each * w
        sequence += b.count
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "sequence", "each", "at"), cols))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces of documents, numbered among those of their length in this task."""
    encoder, part = word_encoder(path), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        doc_ids, rows = batch.column("doc_id").to_pylist(), []
        for k, ids in encoder.documents(batch.column("text").to_pylist()):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                cut = ids[start : start + capacity]
                rows.append((doc_ids[k], piece, start, len(cut), zlib.crc32(cut.tobytes()), part, int(seen[len(cut)])))
                seen[len(cut)] += 1
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in _PIECES.split(", ")])


def encode_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of documents (doc_id, text), written once.

    part and nth number the pieces of one length: nth within the task ``part`` that made them.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return materialize(rows.mapInArrow(partial(_encoded, path=path, capacity=capacity, end_id=end_id), _PIECES), "pieces")


def _place(batches: Iterator[pa.RecordBatch], slots: dict[str, np.ndarray], stride: int) -> Iterator[pa.RecordBatch]:
    first = slots["length"] * stride + slots["lo"]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
        at = np.searchsorted(first, length * stride + rank, side="right") - 1
        nth = rank - slots["lo"][at]
        sequence, within = slots["sequence"][at] + nth // slots["each"][at], nth % slots["each"][at]
        made = [pa.array(sequence), pa.array(slots["at"][at] + within * length)]
        kept = [c for c, f in zip(batch.columns, batch.schema.names) if f != "_rank"]
        yield pa.RecordBatch.from_arrays(
            [*kept, *made], [*[f for f in batch.schema.names if f != "_rank"], "sequence_id", "offset"])


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with length, part, nth as ``encode_pieces`` has them) with sequence_id and offset.

    One count per length reaches the driver (``capacity`` of them at most). The plan goes to the
    tasks: a range per pattern and length, some thousands whatever the number of pieces.
    """
    counts = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity)[0])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(counts, ["length", "part"]).select(
        *[c for c in pieces.columns if c not in ("part", "nth")], (F.col("_before") + F.col("nth")).alias("_rank"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    stride = max(histogram.values(), default=0) + 1
    return ranked.mapInArrow(partial(_place, slots=slots, stride=stride), f"{kept}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place.

    A document is its ids and ``end_id``; only those longer than ``capacity`` are cut, into pieces of
    ``capacity`` ids and a rest. A null or empty text is the end id alone. Rows that repeat an id, or
    have none, are documents of their own, named by the id they have. Sequences are numbered from 0,
    offsets in them are without gaps. An empty table gives no rows. Only doc_id and text are read.
    """
    return pack_pieces(encode_pieces(docs, path, capacity, end_id), capacity)
