"""Texts as numpy arrays: pieces of bounded size, code point classes, words, 64-bit hashes.

Python tasks get Arrow batches of texts and work on whole arrays instead of single words. A piece is
some whole documents, or a part of a long one cut before white space, so memory stays bounded and
no word or pre-token is ever cut. (Only a run without white space is kept whole at any length.)
"""

from __future__ import annotations

import ctypes
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_CHARS = 1 << 20
SLICE_BYTES = 1 << 20
HEAD = 64  # characters of a text in the keys of ranges, whose sample goes to the driver; sorting takes whole texts
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: White_Space of the Unicode Character Database.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, SPACE, LETTER, NUMBER, MARKER = range(5)
_CUT = re.compile(r"(?<!\s)[ \t\n\x0b\x0c\r]")
_BASE = 0x9E3779B97F4A7C15 | 1


def gives_back(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Return freed memory to the system when a task ends: its Python worker waits for later stages."""
    @wraps(task)
    def run(*args, **named) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(*args, **named)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in order, in slices of about ``size`` bytes of ``text``; a longer text is whole.

    Spark fills a batch by its number of rows; the strings made of a whole one are several times its size.
    """
    for batch in batches:
        part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for i, j in zip(cut, cut[1:]):
            yield batch.slice(i, j - i)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE_CHARS + 4096)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths_too: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of ``units`` (bytes or code points), from one running sum."""
    up, down = _POWERS.get(len(units) + 1)
    total = np.zeros(len(units) + 1, np.uint64)
    if len(units):
        np.cumsum(mix(units.astype(np.uint64) + np.uint64(0x51ED27)) * up[: len(units)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_BASE) if lengths_too else h)


def pieces(texts: Sequence[str], size: int = PIECE_CHARS) -> Iterator[tuple[int, list[str], bool]]:
    """(index of the first document, texts, whether they end their last document)."""
    held: list[str] = []
    first = chars = 0
    for i, text in enumerate(texts):
        if held and chars + len(text) > size:
            yield first, held, True
            held, chars = [], 0
        if not held:
            first = i
        at = 0
        while len(text) - at > size:
            cut = _CUT.search(text, at + size)
            if cut is None:
                break
            yield i, [text[at : cut.start()]], False
            at = cut.start()
        held.append(text[at:] if at else text)
        chars += len(text) - at
    if held:
        yield first, held, True


def code_points(texts: Sequence[str], between: str = "\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, one ``between`` after each; where each text starts and ends."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = (between.join(texts) + between).encode("utf-32-le", "surrogatepass")
    ends = np.cumsum(lengths + 1) - 1
    return np.frombuffer(joined, np.uint32), ends - lengths, ends


def utf8(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one line feed after each; where each text starts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), np.cumsum(lengths + 1) - lengths - 1


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


@lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.ones(256, bool)
    word[list(SPACE_BYTES)] = False
    return lower, word


def word_hashes(texts: Sequence[str], lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """By pieces: (first document, hashes of its words, words before each document, last one complete).

    Words are ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased.
    """
    low, word = _byte_tables()
    for first, part, whole in pieces(texts):
        raw, at = utf8(part)
        if lower:
            raw = low[raw]
        starts, ends = runs(word[raw])
        yield first, span_hashes(raw, starts, ends), np.append(np.searchsorted(starts, at), len(starts)), whole


def documents_words(texts: Sequence[str], lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Like ``word_hashes``, with the parts of a long document put together."""
    parts: list[np.ndarray] = []
    for first, h, at, whole in word_hashes(texts, lower):
        if not whole:
            parts.append(h)
        elif parts:
            joined = np.concatenate([*parts, h])
            at = at + (len(joined) - len(h))
            at[0] = 0
            parts = []
            yield first, joined, at
        else:
            yield first, h, at


@lru_cache(1)
def classes() -> np.ndarray:
    """Per code point: letter (L*), number (N*), white space, marker (a lone surrogate) or other."""
    table = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        table[c] = kinds.get(unicodedata.category(chr(c))[0], OTHER)
    table[WHITE_SPACE] = SPACE
    table[0xD800:0xE000] = MARKER
    return table


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Per code point: its lower case where that is a single code point, else itself."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, where each first occurs, and the number of each element's hash."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse


def gather_spans(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans ``values[starts[i] : starts[i] + lengths[i]]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
    return values[index]
