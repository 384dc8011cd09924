"""Texts to token ids by distinct pre-tokens: each distinct one is encoded once per task and cached.

The split patterns of the two public BPE files are evaluated on code point classes of whole pieces.
Strings of special tokens stand alone, as in the tokenizers library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

from panelworks.llm import textarrays
from panelworks.llm.textarrays import (
    LETTER, MARKER, NUMBER, OTHER, SPACE, classes, code_points, distinct, gather_spans, runs, span_hashes, utf8)

MAX_TYPES = 1_500_000
ENCODE_CHARS = 1 << 18
_END = "\ud800"
_FIRST_SPECIAL = 0xD801
#: Endings that follow an apostrophe as tokens of their own (fixed values of both files).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _contractions(cp: np.ndarray, kind: np.ndarray, after_blank: bool) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes that start a contraction, and where it ends."""
    p = np.flatnonzero(cp[:-1] == ord("'"))
    p = p[(kind[p + 1] == LETTER)]
    before = np.where(p > 0, kind[p - 1], SPACE)
    p = p[(before != OTHER) | (p == 0)]
    if not after_blank:
        p = p[(p == 0) | (cp[p - 1] != 0x20)]
    ends = np.zeros(len(p), np.int64)
    last = len(cp) - 1
    for tail in reversed(CONTRACTIONS):
        hit = np.ones(len(p), bool)
        for k, c in enumerate(tail, 1):
            hit &= cp[np.minimum(p + k, last)] == ord(c)
        ends[hit] = p[hit] + 1 + len(tail)
    return p[ends > 0], ends[ends > 0]


def byte_level_spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the byte-level pattern (words with their leading blank, numbers, signs, white space)."""
    kind = classes()[cp]
    n = len(cp)
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == MARKER)
    a, b = runs(kind == SPACE)
    follows = b < n
    follows[follows] = kind[b[follows]] != MARKER
    last = b[follows] - 1
    start[last] = True  # the last blank before a word is a token of its own or joins the word
    start[last[cp[last] == 0x20] + 1] = False
    p, ends = _contractions(cp, kind, after_blank=False)
    start[p + 1] = False
    start[ends] = True
    at = np.flatnonzero(start)
    return at[:-1], at[1:]


def word_spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the word pattern: letters, single numbers, signs; white space is dropped."""
    kind = classes()[cp]
    n = len(cp)
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == MARKER) | (kind[1:] == NUMBER)
    p, ends = _contractions(cp, kind, after_blank=True)
    start[p + 1] = False
    start[ends] = True
    at = np.flatnonzero(start)
    a, b = at[:-1], at[1:]
    keep = kind[a] != SPACE
    return a[keep], b[keep]


def lower_nfc(text: str) -> str:
    """NFC, then the lower case of each character by itself (a final sigma is not treated apart)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pieces(texts: Sequence[str], size: int = ENCODE_CHARS) -> Iterator[tuple[int, list[str], bool]]:
    """Smaller than elsewhere: the arrays over a piece are many times its size."""
    return textarrays.pieces(texts, size)


class _Cache:
    """Hash to id span, as sorted arrays; new entries are merged into the large part now and then."""

    def __init__(self) -> None:
        none = np.zeros(0, np.int64)
        self.old = self.new = (np.zeros(0, np.uint64), none, none)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return len(self.old[0]) + len(self.new[0])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each key's ids, -1 where unknown."""
        start, length = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known, at, size in (self.old, self.new):
            if len(known):
                k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[k] == keys
                start[hit], length[hit] = at[k[hit]], size[k[hit]]
        return start, length

    def add(self, keys: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        """Add unknown keys in rising order."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        mine = (keys, self.used + np.cumsum(lengths) - lengths, lengths)
        self.used += len(flat)
        self.new = self._merged(self.new, mine)
        if len(self.new[0]) > len(self.old[0]) // 8:
            none = np.zeros(0, np.int64)
            self.old, self.new = self._merged(self.old, self.new), (np.zeros(0, np.uint64), none, none)

    @staticmethod
    def _merged(x: tuple, y: tuple) -> tuple:
        at = np.searchsorted(x[0], y[0])
        return tuple(np.insert(p, at, q) for p, q in zip(x, y))


class Encoder:
    """Ids of whole texts. ``encode_types`` maps new distinct pre-tokens to (ids of all, number of each)."""

    def __init__(self, spans: Callable, encode_types: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                 specials: dict[str, int], normal: Callable[[str], str] | None = None,
                 max_types: int = MAX_TYPES) -> None:
        self.spans, self.encode_types, self.normal, self.max_types = spans, encode_types, normal, max_types
        self.special_ids = np.array(list(specials.values()), np.uint32)
        self.names = {s: chr(_FIRST_SPECIAL + i) for i, s in enumerate(specials)}
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.cache = _Cache()

    def _prepared(self, text: str) -> str:
        if self.special is None or not self.special.search(text):
            return self.normal(text) if self.normal else text
        out, at = [], 0
        for m in self.special.finditer(text):
            left = text[at : m.start()]
            out += [self.normal(left) if self.normal else left, self.names[m[0]]]
            at = m.end()
        return "".join([*out, self.normal(text[at:]) if self.normal else text[at:]])

    def _learn(self, keys: np.ndarray, strings: list[str]) -> None:
        marked = np.fromiter((_END < s[0] < "\ue000" for s in strings), bool, len(strings))
        if marked.any():
            own = self.special_ids[[ord(s[0]) - _FIRST_SPECIAL for s, m in zip(strings, marked) if m]]
            self.cache.add(keys[marked], np.ones(len(own), np.int64), own)
            keys, strings = keys[~marked], [s for s, m in zip(strings, marked) if not m]
        if strings:
            flat, lengths = self.encode_types(strings)
            self.cache.add(keys, lengths, flat)

    def _piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a piece and how many each text has."""
        cp, first, _ = code_points(texts, _END)
        a, b = self.spans(cp)
        ends_text = cp[a] == ord(_END)
        a, b = a[~ends_text], b[~ends_text]
        uniq, seen, inverse = distinct(span_hashes(cp, a, b))
        if len(self.cache) > self.max_types:
            self.cache = _Cache()
        start, length = self.cache.find(uniq)
        new = np.flatnonzero(start < 0)
        if len(new):
            joined = _END.join(texts) + _END
            at = seen[new]
            self._learn(uniq[new], [joined[i:j] for i, j in zip(a[at].tolist(), b[at].tolist())])
            start, length = self.cache.find(uniq)
        lengths = length[inverse]
        before = np.concatenate([[0], np.cumsum(lengths)])
        cut = before[np.append(np.searchsorted(a, first), len(a))]
        return gather_spans(self.cache.ids, start[inverse], lengths), np.diff(cut)

    def documents(self, texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, its ids), in order; null counts as empty."""
        ready = [self._prepared(t) if t else "" for t in texts]
        parts: list[np.ndarray] = []
        for first, part, whole in pieces(ready):
            ids, counts = self._piece(part)
            if not whole:
                parts.append(ids)
                continue
            at = 0
            for k, n in enumerate(counts.tolist()):
                own = ids[at : at + n]
                at += n
                if parts:
                    own, parts = np.concatenate([*parts, own]), []
                yield first + k, own


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


@lru_cache(4)
def byte_level_encoder(path: str) -> Encoder:
    """For a byte-level file; the tokenizers library's model encodes the distinct pre-tokens."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    with open(path, encoding="utf-8") as f:
        specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    shown = np.array([ord(c) for c in byte_characters()], np.uint32)

    def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, at = utf8(strings)
        text = shown[raw].tobytes().decode("utf-32-le")
        got = [model.tokenize(text[i : j - 1]) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(raw)])]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((t.id for tokens in got for t in tokens), np.uint32, int(lengths.sum())), lengths

    return Encoder(byte_level_spans, encode, specials)
