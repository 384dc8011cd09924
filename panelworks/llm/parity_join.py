"""Jaccard join of word shingles by parity sketches (odd sketches) and pigeonhole keys.

Each shingle flips one bit of a document's parity sketch, so the Hamming distance of two sketches
never exceeds the symmetric difference of the sets. Jaccard >= t allows a symmetric difference of
d = (1 - t) / (1 + t) * (|A| + |B|) at most. Pairs are banded by d: a band of limit D cuts a sparse
sketch into more than D parts; at most D parts of a linked pair differ, so some part is equal. The
part's contents (XOR of the 64-bit hashes of its shingles) is the join key.

Keys with few sets give all their pairs. Keys with many (a passage that documents share, or a large
group of near copies) give only the star around their smallest set. A set with N filled parts and
limit D needs its first D + 1 keys only, in any common order (prefix filter): with the crowded keys
last, most sets need none of those. Possible pairs are verified on exact sets, the best of each set
first, and only while their ends are in different components. What is then left, pairs of different
components in a common crowded key, is compared in cells of bounded size by sketches and exact sets;
a cell keeps track of its components, so it returns links of a spanning forest only. No link between
different sets is lost: a skipped pair has both ends in one component.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.components import components
from panelworks.llm.textarrays import documents_words, gather_spans, gives_back, mix, slices
from panelworks.session import materialize

WORDS, PERCENT = 5, 75
CROWDED = 8  # distinct sets from which a key gives a star instead of all pairs
SKETCH_WORDS = 8  # 64-bit words of the smallest sketch; larger sets have 4 to 8 bits per shingle
CELL_ROWS = 4096  # on one side of a cell that compares sketches
CELL_BYTES, LEAST_BYTES = 32 << 20, 4096  # of exact sets on one side of a cell; what a set counts at least
SLACK_STEP = 4
FLUSH = 1 << 20
BUCKETS_PER_PARTITION, BUCKET_SHINGLES = 4, 1 << 20
HELD = 1 << 21  # entries of a bucket at which members of crowded keys go on
ENTRY = np.dtype([("k", "<u8"), ("s", "<u8")])
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: Sequence[str | None], words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, sorted distinct shingle hashes of all documents, bounds) by pieces."""
    for first, h, at in documents_words([t or "" for t in texts]):
        n = np.diff(at)
        many = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        doc = np.repeat(np.arange(len(n)), many)
        place = at[:-1][doc] + np.arange(len(doc)) - (np.cumsum(many) - many)[doc]
        total = np.minimum(n, words)[doc].astype(np.uint64)  # a short text is one sequence
        for i in range(words):
            there = i < n[doc]
            total = mix(total + np.where(there, h[np.minimum(place + i, max(len(h) - 1, 0))], np.uint64(0)))
        order = np.lexsort((total, doc))
        total, doc = total[order], doc[order]
        new = np.ones(len(total), bool)
        new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
        total, doc = total[new], doc[new]
        yield first, total, np.searchsorted(doc, np.arange(len(n) + 1))


def _class_ids(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An 80-bit id of each set: 16 bits and 64 bits."""
    def total(x: np.ndarray) -> np.ndarray:
        run = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=run[1:])
        return run[bounds[1:]] - run[bounds[:-1]]

    n = np.diff(bounds).astype(np.uint64)
    return mix(total(mix(h + _GOLD)) + n) >> np.uint64(48), mix(total(mix(h ^ _GOLD)) ^ n)


def _sketches(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Dense parity sketches of 64 * SKETCH_WORDS * 2^k bits, at least 4 bits per shingle."""
    n = np.diff(bounds)
    least = 64 * SKETCH_WORDS
    bits = least << np.ceil(np.log2(np.maximum(4 * n / least, 1))).astype(np.int64)
    at = np.cumsum(bits) - bits
    place = np.repeat(at, n) + (h % np.repeat(bits, n).astype(np.uint64)).astype(np.int64)
    flips = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
    packed = np.packbits(flips, bitorder="little").tobytes()
    return [packed[i // 8 : (i + b) // 8] for i, b in zip(at.tolist(), bits.tolist())]


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set in fewer bits: parities of a smaller modulus."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _quartered(sketch: bytes) -> bytes:
    """The sketch in a quarter of its bits, 1 to 2 per shingle, or in the fewest there are."""
    x = np.frombuffer(sketch, "<u8")
    return folded(x, max(SKETCH_WORDS, len(x) // 4)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance in the bits of the smaller sketch: never above the symmetric difference."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def _difference(a: int | np.ndarray, b: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


def _limits(most: int) -> np.ndarray:
    """Band limits D up to a difference, growing by 1.6."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 8 // 5))
    return np.array(out, np.int64)


def _entries(h: np.ndarray, bounds: np.ndarray, percent: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Pigeonhole keys of sets: (bucket, entry); an entry packs 40 key bits, slack, band and set id.

    Slack is the number of filled parts above the limit, in steps rounded down.
    """
    high, low = _class_ids(h, bounds)
    size = np.diff(bounds)
    least = _difference(size, -(-size * percent // 100), percent)
    most = _difference(size, size * 100 // percent, percent)
    limits = _limits(int(most.max()) if len(most) else 1)
    out_bucket, out = [np.zeros(0, np.int64)], [np.zeros(0, ENTRY)]
    first, last = np.searchsorted(limits, np.maximum(least, 1)), np.searchsorted(limits, most)

    def put(sets: np.ndarray, keys: np.ndarray, slack: np.ndarray, code: int) -> None:
        e = np.empty(len(keys), ENTRY)
        bits = (np.clip(slack // SLACK_STEP, 0, 63).astype(np.uint64) << np.uint64(2)) | np.uint64(code)
        e["k"] = (keys & np.uint64((1 << 40) - 1)) << np.uint64(24) | bits << np.uint64(16) | high[sets]
        e["s"] = low[sets]
        out.append(e)
        out_bucket.append(((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64))

    for step in range(int((last - first).max(initial=0)) + 1):
        chosen = np.flatnonzero((most > 0) & (first + step <= last))
        if not len(chosen):
            continue
        level = (first + step)[chosen]
        n = size[chosen]
        own = np.repeat(np.arange(len(chosen)), n)
        x = gather_spans(h, bounds[:-1][chosen], n)
        parts = limits[level] * 6 // 5 + 2
        salt = mix(level.astype(np.uint64) * _GOLD)
        part = (mix(x ^ salt[own]) % parts[own].astype(np.uint64)).astype(np.int64)
        place = (np.cumsum(parts) - parts)[own] + part
        order = np.argsort(place, kind="stable")
        where = place[order]
        begin = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        content = np.bitwise_xor.reduceat(mix(x + _GOLD)[order], begin)
        owner, number = own[order][begin], part[order][begin]
        keys = mix(content + mix(number.astype(np.uint64) + salt[owner]))
        limit = np.minimum(limits[level], most[chosen])  # what a partner of this set can differ by here
        slack = np.bincount(owner, minlength=len(chosen)) - limit
        for parity in (0, 1):
            mine = level[owner] % 2 == parity
            put(chosen[owner[mine]], keys[mine], slack[owner[mine]], parity)
        bare = (slack <= 0)[own]  # too few filled parts: each shingle is a key as well
        for parity in (0, 1):
            mine = bare & (level[own] % 2 == parity)
            put(chosen[own[mine]], mix(x[mine] + ~salt[own[mine]]), (n - limit)[own[mine]], 2 + parity)
    return np.concatenate(out_bucket), np.concatenate(out)


_SET_SCHEMA = "doc_id bigint, n_shingles bigint, ch bigint, cl bigint, sketch binary, small binary"


@gives_back
def _describe(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        ids = batch.column("doc_id")
        for first, h, bounds in shingle_sets(batch.column("text").to_pylist(), words):
            high, low = _class_ids(h, bounds)
            n = len(bounds) - 1
            sketch = _sketches(h, bounds)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, n), pa.array(np.diff(bounds)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                 pa.array(sketch, pa.binary()), pa.array([_quartered(x) for x in sketch], pa.binary())],
                ["doc_id", "n_shingles", "ch", "cl", "sketch", "small"])


def _packed(bucket: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """One row per bucket; copies among the entries go."""
    order = np.lexsort((entries["s"], entries["k"], bucket))
    bucket, entries = bucket[order], entries[order]
    new = np.ones(len(entries), bool)
    new[1:] = (entries[1:] != entries[:-1]) | (bucket[1:] != bucket[:-1])
    bucket, entries = bucket[new], entries[new]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(bucket))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[at], pa.int64()), pa.array([entries[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())],
        ["bucket", "packed"])


@gives_back
def _emit(batches: Iterator[pa.RecordBatch], words: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in slices(batches, "text"):
        for _, h, bounds in shingle_sets(batch.column("text").to_pylist(), words):
            held.append(_entries(h, bounds, percent, buckets))
            if sum(len(b) for b, _ in held) > FLUSH:
                yield _packed(*(np.concatenate(x) for x in zip(*held)))
                held = []
    if held:
        yield _packed(*(np.concatenate(x) for x in zip(*held)))


_MET_SCHEMA = "ah bigint, al bigint, bh bigint, bl bigint, key bigint, code int, slack int"


def _met_rows(bucket: int, e: np.ndarray, crowded: np.ndarray, last: bool) -> tuple[pa.RecordBatch | None, np.ndarray, np.ndarray]:
    """Pairs of sets that share a key of the bucket, and the members of its crowded keys.

    Before the ``last`` call only crowded keys give rows: their smallest set is kept, and the others'
    entries; keys that were crowded once stay so. Returns the rows, the entries kept, the crowded keys.
    """
    order = np.lexsort((e["s"], e["k"] & np.uint64(0xFFFF), e["k"] >> np.uint64(24)))
    e = e[order]
    key, high, low = e["k"] >> np.uint64(24), (e["k"] & np.uint64(0xFFFF)).astype(np.int64), e["s"].view(np.int64)
    new = np.ones(len(e), bool)
    new[1:] = (key[1:] != key[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    e, key, high, low = e[new], key[new], high[new], low[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(start, len(key)))
    is_hot = (count > CROWDED) | np.isin(key[start], crowded)
    crowded = np.union1d(crowded, key[start][is_hot])
    kept = np.empty(0, ENTRY)
    if last:
        some = is_hot | (count > 1)
    else:
        some = is_hot
        first = np.zeros(len(e), bool)
        first[start] = True
        kept = e[first | ~np.repeat(is_hot, count)]
    there = np.repeat(some, count)
    e, key, high, low, is_hot, count = e[there], key[there], high[there], low[there], is_hot[some], count[some]
    if not len(e):
        return None, kept, crowded
    start = np.cumsum(count) - count
    head, hot_row = np.repeat(start, count), np.repeat(is_hot, count)
    i = np.arange(len(key))
    pairs = [np.stack([head, i])[:, hot_row & (i > head)]]
    few = ~hot_row
    for gap in range(1, CROWDED):
        left = i[:-gap][few[:-gap] & (head[:-gap] == head[gap:])] if len(i) > gap else i[:0]
        pairs.append(np.stack([left, left + gap]))
    a, b = np.concatenate(pairs, axis=1)
    cols = np.stack([high[a], low[a], high[b], low[b]])
    cols = cols[:, np.lexsort(cols)]
    keep = np.ones(cols.shape[1], bool)
    keep[1:] = (cols[:, 1:] != cols[:, :-1]).any(axis=0)
    cols = cols[:, keep]
    hot = np.flatnonzero(hot_row)
    code = (e["k"][hot] >> np.uint64(16)).astype(np.int64) & 0xFF
    none = pa.nulls(len(hot), pa.int64())
    n = cols.shape[1]

    def both(pair: np.ndarray, own: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([pair, own]))

    def second(pair: np.ndarray) -> pa.Array:
        return pa.concat_arrays([pa.array(pair), none])

    def only(own: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.concat_arrays([pa.nulls(n, kind), pa.array(own, kind)])

    rows = pa.RecordBatch.from_arrays(
        [both(cols[0], high[hot]), both(cols[1], low[hot]), second(cols[2]), second(cols[3]),
         only(key[hot].astype(np.int64) | bucket << 40, pa.int64()), only(code & 3, pa.int32()), only(code >> 2, pa.int32())],
        ["ah", "al", "bh", "bl", "key", "code", "slack"])
    return rows, kept, crowded


@gives_back
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets, in order, to their pairs; what a bucket holds at once grows with its distinct keys only."""
    now, held, size, limit, crowded = None, [], 0, HELD, np.empty(0, np.uint64)
    for batch in batches:
        for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
            if bucket != now:
                if held and (out := _met_rows(now, np.concatenate(held), crowded, True)[0]) is not None:
                    yield out
                now, held, size, limit, crowded = bucket, [], 0, HELD, np.empty(0, np.uint64)
            held.append(np.frombuffer(packed, ENTRY))
            size += len(held[-1])
            if size > limit:
                out, kept, crowded = _met_rows(now, np.concatenate(held), crowded, False)
                held, size, limit = [kept], len(kept), HELD + 2 * len(kept)
                if out is not None:
                    yield out
    if held and (out := _met_rows(now, np.concatenate(held), crowded, True)[0]) is not None:
        yield out


@gives_back
def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches allow a link, with their distance as a share of the limit."""
    for batch in batches:
        n, m = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
        fits = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
        limit, far = _difference(n, m, percent), np.zeros(len(n))
        a, b = batch.column("a_sketch"), batch.column("b_sketch")
        for k in np.flatnonzero(fits).tolist():
            far[k] = sketch_distance(a[k].as_py(), b[k].as_py())
        keep = pa.array(fits & (far <= limit))
        cols = [batch.column("a_rep"), batch.column("b_rep"), pa.array(far / np.maximum(limit, 1))]
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], ["a_rep", "b_rep", "far"])


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """(a_rep < b_rep, far) of pairs (a_, b_ of rep, n, sketch) that can be links."""
    met = pairs.mapInArrow(partial(_near, percent=percent), "a_rep bigint, b_rep bigint, far double")
    return materialize(met.select(F.least("a_rep", "b_rep").alias("a_rep"), F.greatest("a_rep", "b_rep").alias("b_rep"), "far"), "pairs")


def _side(classes: DataFrame, end: str) -> DataFrame:
    return classes.select(
        F.col("ch").alias(f"{end}h"), F.col("cl").alias(f"{end}l"), F.col("rep").alias(f"{end}_rep"),
        F.col("n_shingles").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_sketch"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    known = found.select(F.col("node").alias("a_rep"), F.col("component").alias("_ca"))
    other = found.select(F.col("node").alias("b_rep"), F.col("component").alias("_cb"))
    return pairs.join(known, "a_rep", "left").join(other, "b_rep", "left").filter(
        F.coalesce("_ca", "a_rep") != F.coalesce("_cb", "b_rep")).select("a_rep", "b_rep", "far")


def _best(pairs: DataFrame) -> DataFrame:
    """The most alike pair of every set."""
    pair = F.struct("far", "a_rep", "b_rep")
    each = pairs.select(F.explode(F.array("a_rep", "b_rep")).alias("node"), pair.alias("pair"))
    return each.groupBy("node").agg(F.min("pair").alias("pair")).select("pair.a_rep", "pair.b_rep").distinct()


@gives_back
def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        ids = batch.column("doc_id")
        for first, h, bounds in shingle_sets(batch.column("text").to_pylist(), words):
            high, low = _class_ids(h, bounds)
            packed = [h[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(packed)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(packed, pa.binary())],
                ["doc_id", "ch", "cl", "members"])


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, as rising arrays, link."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


@gives_back
def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(batch.column("a_members"), batch.column("b_members"))
        keep = [_similar(*(np.frombuffer(m.as_buffer(), np.uint64) for m in pair), percent) for pair in both]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a_rep", "b_rep")], ["src", "dst"])


def _exact_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(rep, members): the shingle hashes of the representatives ``ids`` (doc_id), written once."""
    concerned = docs.join(materialize(ids, "concerned"), "doc_id", "left_semi")
    sets = concerned.mapInArrow(partial(_sets, words=words), "doc_id bigint, ch bigint, cl bigint, members binary")
    own = classes.select(F.col("rep").alias("doc_id"), "ch", "cl")
    sets = sets.join(own, ["doc_id", "ch", "cl"], "left_semi").groupBy(F.col("doc_id").alias("rep"))
    return materialize(sets.agg(F.first("members").alias("members")), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (src, dst) among candidate pairs (a_rep, b_rep), on the exact sets of the documents concerned."""
    pairs = materialize(pairs, "candidates")
    ids = pairs.select(F.explode(F.array("a_rep", "b_rep")).alias("doc_id")).distinct()
    sets = _exact_sets(ids, docs, classes, words)
    a = sets.select(F.col("rep").alias("a_rep"), F.col("members").alias("a_members"))
    b = sets.select(F.col("rep").alias("b_rep"), F.col("members").alias("b_members"))
    met = pairs.join(a, "a_rep").join(b, "b_rep")
    return materialize(met.mapInArrow(partial(_linked, percent=percent), "src bigint, dst bigint"), "links")


def _apart_in_cell(cols: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs of rows i and columns j in different components; of those seen from both ends only one way round."""
    ahead = cols["top"][j] | (cols["rep"][j] > cols["rep"][i[:, None]])
    return ahead & (cols["component"][j] != cols["component"][i[:, None]])


def _near_rows(rows: list[dict], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one cell the sets with a partner in another component which sizes and sketches allow, and a forest.

    The forest has (2, m) sets: possible pairs that span the components as all possible pairs would.
    """
    cols = {k: np.concatenate([r[k] for r in rows]) for k in ("rep", "component", "left", "top", "n")}
    sketch = [np.frombuffer(x, "<u8") for r in rows for x in r["small"]]
    width, n, rep = np.array([len(x) for x in sketch]), cols["n"], cols["rep"]
    near, forest = np.zeros(len(n), bool), [np.zeros((2, 0), np.int64)]
    now = cols["component"].copy()  # as if all possible pairs were links
    for w in np.unique(width).tolist():  # linked sets differ by a third in size, so their sketches by one step at most
        here = np.flatnonzero((width == w) | (width == 2 * w))
        bits = np.stack([folded(sketch[k], w) for k in here.tolist()])
        i, j = np.flatnonzero(cols["left"][here]), np.flatnonzero(~cols["left"][here])
        for x in i.tolist():
            at, there = here[x], here[j]
            fits = _apart_in_cell(cols, np.array([at]), there)[0] & ((width[at] == w) | (width[there] == w))
            fits &= np.minimum(n[at], n[there]) * 100 >= np.maximum(n[at], n[there]) * percent
            y = j[fits]
            far = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1)
            good = here[y[far <= _difference(n[at], n[here[y]], percent)]]
            if not len(good):
                continue
            near[at] = near[good] = True
            labels, first = np.unique(now[good], return_index=True)
            new = labels != now[at]
            if new.any():
                forest.append(np.stack([np.full(int(new.sum()), rep[at]), rep[good[first[new]]]]))
                now[np.isin(now, labels[new])] = now[at]
    return np.unique(rep[near]), np.concatenate(forest, axis=1)


def _cells(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[int, list[dict]]]:
    """(key, rows) of whole cells, along rows in order of the cells; binary columns come as lists."""
    held: list[dict] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(c).to_numpy() for c in ("key", "_i", "_j")])
        cols = {k: batch.column(k).to_pylist() if pa.types.is_binary(batch.column(k).type) else
                batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        cuts = np.concatenate([[0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            here = tuple(cell[:, i].tolist())
            if here != now:
                if held:
                    yield now[0], held
                held, now = [], here
            held.append({k: v[i:j] for k, v in cols.items()})
    if held:
        yield now[0], held


@gives_back
def _mark(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a_rep) of the sets that may link with another component in some cell; (a_rep, b_rep) of the forests."""
    for _, rows in _cells(batches, ["rep", "component", "left", "top", "n", "small"]):
        near, forest = _near_rows(rows, percent)
        if len(near):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([near, forest[0]])), pa.concat_arrays([pa.nulls(len(near), pa.int64()), pa.array(forest[1])])],
                ["a_rep", "b_rep"])


class _Cell:
    """Rows and columns of one cell of a crowded key; links are verified and kept only between components."""

    def __init__(self, rows: list[dict], percent: int) -> None:
        self.cols = {k: np.concatenate([r[k] for r in rows]) for k in ("rep", "component", "left", "top")}
        self.sets, self.percent = [np.frombuffer(x, np.uint64) for r in rows for x in r["members"]], percent
        self.n = np.array([len(x) for x in self.sets])
        names, self.component = np.unique(self.cols["component"], return_inverse=True)
        self.parent = np.arange(len(names))
        self.sketch = _sketches(np.concatenate(self.sets), np.concatenate([[0], np.cumsum(self.n)]))
        self.small = np.stack([folded(np.frombuffer(x, "<u8"), SKETCH_WORDS) for x in self.sketch])

    def _settled(self) -> np.ndarray:
        """The component of every row, after the links found so far."""
        while (up := self.parent[self.parent] != self.parent).any():
            self.parent[up] = self.parent[self.parent[up]]
        return self.parent[self.component]

    def links(self) -> Iterator[tuple[int, int]]:
        """At most one link fewer than there are components; none that is missing would join two of them."""
        rep, left = self.cols["rep"], self.cols["left"]
        i, j = np.flatnonzero(left), np.flatnonzero(~left)
        now = self._settled()
        for x in i.tolist():
            apart = j[_apart_in_cell(self.cols | {"component": now}, np.array([x]), j)[0]]
            n, m = self.n[x], self.n[apart]
            limit = _difference(n, m, self.percent)
            fits = np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent
            fits &= np.bitwise_count(self.small[apart] ^ self.small[x]).sum(axis=1) <= limit
            for y, most in zip(apart[fits].tolist(), limit[fits].tolist()):
                if now[y] == now[x] or sketch_distance(self.sketch[x], self.sketch[y]) > most:
                    continue
                if _similar(self.sets[x], self.sets[y], self.percent):
                    yield int(rep[x]), int(rep[y])
                    self.parent[max(now[x], now[y])] = min(now[x], now[y])
                    now = self._settled()


@gives_back
def _forest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Verified links (src, dst) of all cells."""
    for _, rows in _cells(batches, ["rep", "component", "left", "top", "members"]):
        if links := list(_Cell(rows, percent).links()):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["src", "dst"])


def _dealt(members: DataFrame, keys: DataFrame, held: DataFrame) -> DataFrame:
    """Members of ``keys`` in cells: those outside the top component as rows, all as columns, with what ``held`` has."""
    def stripes(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    all_rows = F.transform(stripes("rows"), lambda i: F.struct(i.alias("_i"), F.pmod("_at", "columns").alias("_j"), F.lit(False).alias("left")))
    all_columns = F.transform(stripes("columns"), lambda j: F.struct(F.pmod("_at", "rows").alias("_i"), j.alias("_j"), F.lit(True).alias("left")))
    top = F.col("component") == F.col("top_component")
    sides = F.when(top, all_rows).otherwise(F.concat(all_rows, all_columns))
    placed = members.join(keys, "key").withColumn("_at", F.xxhash64("rep"))
    placed = placed.select("key", "rep", "component", top.alias("top"), F.inline(sides)).join(held, "rep")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "rep")


def _unsettled(members: DataFrame, size: Column, cell: int) -> DataFrame:
    """Keys with members of several components: the top one and how many stripes of ``cell`` they need."""
    sizes = members.groupBy("key", "component").agg(F.sum(size).alias("n"))
    keys = sizes.groupBy("key").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("kinds"))
    return materialize(keys.filter("kinds > 1").select(
        "key", F.col("most.component").alias("top_component"), F.ceil((F.col("all") - F.col("most.n")) / cell).alias("rows"),
        F.ceil(F.col("all") / cell).alias("columns")), "keys")


def _joined(pairs: DataFrame, found: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``found`` with the links among ``pairs``: the best pair of every set first, then all that are still apart."""
    for some in (_best, lambda p: p.select("a_rep", "b_rep")):
        rest = materialize(_apart(pairs, found), "rest")
        if rest.isEmpty():
            break
        found = _merged(found, _verified(some(rest), docs, classes, words, percent))
    return found


def _needed(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, rep): the crowded keys that each set needs; of keys with the same sets only one."""
    hot = met.filter(F.col("bl").isNull()).select(F.col("ah").alias("ch"), F.col("al").alias("cl"), "key", "code", "slack")
    # a set needs all but (slack - 1) of its crowded keys, the least crowded ones; a row can come twice
    crowd = hot.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"))
    own = Window.partitionBy("ch", "cl", "code")
    placed = hot.join(crowd, "key").withColumn("place", F.dense_rank().over(own.orderBy("crowd", "key")))
    placed = placed.withColumn("held", F.max("place").over(own))
    needed = placed.filter(F.col("place") <= F.col("held") - F.greatest(F.col("slack") * SLACK_STEP - 1, F.lit(0)))
    return _different(needed.join(classes.select("ch", "cl", "rep"), ["ch", "cl"]).select("key", "rep").distinct())


def _different(members: DataFrame) -> DataFrame:
    """(key, rep) without keys whose sets another key has as well."""
    members = materialize(members, "members")
    same = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    keys = same.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return members.join(materialize(keys, "keys"), "key", "left_semi")


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with their components so far."""
    known = found.withColumnRenamed("node", "rep")
    return materialize(members.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")


def _with_hidden(met: DataFrame, docs: DataFrame, classes: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """``found`` with the links between different components whose sets both need a crowded key.

    A key's members outside its largest component are compared with all of its members by sketches, in
    cells of bounded size. Each cell returns the sets that have a possible partner and a forest of
    possible pairs; what these connect, over all keys, is a cluster. Sets that may link are in the same
    one, and in one only, so clusters are compared on exact sets, in cells again, each of which returns
    a spanning forest of its links.
    """
    members = _placed(_needed(met, classes), found)
    sketched = classes.select("rep", F.col("n_shingles").alias("n"), "small")
    cells = _dealt(members, _unsettled(members, F.lit(1), CELL_ROWS), sketched)
    near = materialize(cells.mapInArrow(partial(_mark, percent=percent), "a_rep bigint, b_rep bigint").distinct(), "near")
    if near.isEmpty():
        return found
    marked = _placed(near.filter("b_rep is null").select(F.col("a_rep").alias("rep")), found)
    own = marked.select("rep", "component")
    pairs = near.filter("b_rep is not null").join(own.toDF("a_rep", "src"), "a_rep").join(own.toDF("b_rep", "dst"), "b_rep")
    clusters = components(pairs.select("src", "dst")).select(F.col("node").alias("component"), F.col("component").alias("key"))
    clustered = materialize(marked.join(clusters, "component"), "clustered")
    sets = _exact_sets(marked.select(F.col("rep").alias("doc_id")), docs, classes, words)
    size = sets.select("rep", F.greatest(F.length("members"), F.lit(LEAST_BYTES)).alias("_bytes"))
    cells = _dealt(clustered, _unsettled(clustered.join(size, "rep"), F.col("_bytes"), CELL_BYTES), sets)
    return _merged(found, materialize(cells.mapInArrow(partial(_forest, percent=percent), "src bigint, dst bigint"), "hidden"))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links."""
    if links.isEmpty():
        return found
    settled = found.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    return materialize(components(settled.unionByName(links.select("src", "dst"))), "found")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents linked by the Jaccard of their shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document's set is its distinct shingles
    of ``words`` words; a shorter text is one sequence; a null text or one without words is empty
    (n_shingles 0) and linked with nothing. Sets link when 100 * intersection >= ``percent`` * union.
    component_id is the smallest doc_id reachable. One row per input row; rows that repeat a doc_id
    are one document of several texts. A null doc_id stays alone, with a null component_id. Only
    doc_id and text are read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    described = materialize(docs.mapInArrow(partial(_describe, words=words), _SET_SCHEMA), "described")
    filled = described.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("ch", "cl").agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "sketch", "small")]), "classes")

    shingles = described.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(n * BUCKETS_PER_PARTITION, shingles // BUCKET_SHINGLES)
    entries = docs.filter("doc_id is not null").mapInArrow(
        partial(_emit, words=words, percent=percent, buckets=buckets), "bucket bigint, packed binary")
    met = materialize(entries.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _MET_SCHEMA), "met")

    a, b = _side(classes, "a"), _side(classes, "b")
    pairs = met.filter(F.col("bl").isNotNull()).select("ah", "al", "bh", "bl").distinct()
    pairs = _possible(pairs.join(a, ["ah", "al"]).join(b, ["bh", "bl"]), percent)
    found = spark.createDataFrame([], "node bigint, component bigint")
    found = _joined(pairs, found, docs, classes, words, percent)
    found = _with_hidden(met, docs, classes, found, words, percent)

    reps = described.join(classes.select("ch", "cl", "rep"), ["ch", "cl"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"))
    reps = materialize(reps.withColumn("rep", F.coalesce("rep", "doc_id")), "reps")
    twice = reps.filter("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x <> y")
    several = reps.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    if not several.isEmpty():
        settled = found.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        found = components(settled.unionByName(several))
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return named.select("doc_id", "n_shingles", own.alias("component_id"))
