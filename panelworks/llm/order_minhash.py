"""Order MinHash (Marçais et al., 2019): fingerprints that follow edit distance, not just content.

A text's k-mers of words are numbered by occurrence. For each of m hash functions the l smallest
(k-mer, occurrence) are taken, put back into text order and hashed together. Texts with the same
k-mers in another order differ, as do texts that repeat them more often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.textarrays import HEAD, documents_words, mix
from panelworks.session import materialize

SLOTS, KMER, TAKEN = 64, 3, 2
PLACE_BITS = 28  # k-mers of one text are numbered below 2^28
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _numbered_kmers(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (k-mer, occurrence) in text order, and the documents' bounds; a short text is one k-mer."""
    n = np.diff(at)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), many)
    bounds = np.concatenate([[0], np.cumsum(many)])
    first = at[:-1][doc] + np.arange(len(doc)) - bounds[:-1][doc]
    h = np.zeros(len(doc), np.uint64)
    for i in range(k):
        there = i < n[doc]
        h = mix(h + np.where(there, words[np.minimum(first + i, max(len(words) - 1, 0))], np.uint64(i + 1)))
    h = mix(h ^ np.minimum(n, k)[doc].astype(np.uint64))
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    place = np.arange(len(h))
    occurrence = np.empty(len(h), np.int64)
    occurrence[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    return mix(h + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), bounds


def fingerprints(texts: Sequence[str], slots: int = SLOTS, k: int = KMER, taken: int = TAKEN) -> np.ndarray:
    """(texts, slots) of 16-bit hashes. Texts without words are all alike; fewer than ``taken`` k-mers: all."""
    out = np.zeros((len(texts), slots), np.uint16)
    for start, words, at in documents_words(texts, lower=False):
        h, bounds = _numbered_kmers(words, at, k)
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            continue
        first, count = bounds[full], np.diff(bounds)[full]
        own = np.repeat(np.arange(len(full)), count)
        place = (np.arange(len(h)) - first[own]).astype(np.uint64)
        low = np.uint64((1 << PLACE_BITS) - 1)
        for j in range(slots):
            x = h * (mix(np.array([j], np.uint64))[0] | np.uint64(1))
            x &= ~low
            x |= place
            chosen = []
            for t in range(taken):
                least = np.minimum.reduceat(x, first)
                chosen.append(np.where(least == _MAX, _MAX, least & low))
                if t + 1 < taken:
                    there = least != _MAX
                    x[first[there] + (least[there] & low).astype(np.int64)] = _MAX
            ordered = np.sort(np.stack(chosen), axis=0)
            total = np.zeros(len(full), np.uint64)
            for p in ordered:
                got = h[first + np.minimum(p, (count - 1).astype(np.uint64)).astype(np.int64)]
                total = np.where(p == _MAX, total, mix(total + got))
            out[start + full, j] = (total >> np.uint64(48)).astype(np.uint16)
    return out


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _hex(rows: np.ndarray) -> list[str]:
    raw = rows.astype(">u2").tobytes().hex()
    width = 4 * rows.shape[1]
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def _results(ids: list, texts: list[str], own: np.ndarray, following: list[str], then: np.ndarray) -> list:
    changed = [edited_text(a, b) for a, b in zip(texts, following)]
    other = fingerprints(changed)
    digests = [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]
    cols = [ids, list(map(len, texts)), digests, _hex(own), _hex(other),
            (own == other).mean(axis=1), (own == then).mean(axis=1)]
    return [pa.array(c, t) for c, t in zip(cols, _TYPES)]


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition against the row after each; its first and last rows go on with their texts."""
    part = TaskContext.get().partitionId()
    names = [*_RESULT, "kind", "part", "text"]

    def rows(cols: list, kind: int, texts: list) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(texts, pa.string())], names)

    def bare(doc_id: int | None) -> list:
        return [pa.array([doc_id], pa.int64()), *[pa.array([None], t) for t in _TYPES[1:]]]

    ids, texts, own = [], [], np.zeros((0, SLOTS), np.uint16)
    for batch in batches:
        more = batch.column("text").to_pylist()
        if not more:
            continue
        if not texts:
            yield rows(bare(batch.column("doc_id")[0].as_py()), 2, more[:1])
        ids, texts, own = ids + batch.column("doc_id").to_pylist(), texts + more, np.concatenate([own, fingerprints(more)])
        if len(texts) > 1:
            yield rows(_results(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:]), 0, [None] * (len(texts) - 1))
        ids, texts, own = ids[-1:], texts[-1:], own[-1:]
    if texts:
        yield rows(bare(ids[0]), 1, texts)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
        cols = _results(batch.column("doc_id").to_pylist(), texts, fingerprints(texts), following, fingerprints(following))
        yield pa.RecordBatch.from_arrays(cols, _RESULT)


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, its edited text's, and its likeness to that and to the next document's.

    The next document is by rising doc_id (null first; rows of one id in order of text), after the
    last the first. Only doc_id and text are read; a null text counts as empty. One row per input
    row. Rows are sorted by ranges of doc_id and the head of the text, so a repeated or null id is
    spread where its texts begin unlike; only the first and last row of each range meet across ranges.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
    made = materialize(dealt.mapInArrow(_along, f"{_SCHEMA}, kind int, part bigint, text string"), "fingerprints")
    heads = made.filter("kind = 2").select("part", F.col("text").alias("following"))
    order = Window.orderBy("part")
    nexts = heads.select(
        F.col("part").alias("_here"),
        F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("part"))
    last = made.filter("kind = 1").select("doc_id", "text", F.col("part").alias("_here"))
    seams = last.join(nexts, "_here").join(heads, "part").select("doc_id", "text", "following")
    return made.filter("kind = 0").select(*_RESULT).unionByName(seams.mapInArrow(_seams, _SCHEMA))
