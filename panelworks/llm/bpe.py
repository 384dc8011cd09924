"""Byte-pair encoding by speculation: greedy tokens, one check per adjacent pair, merging for the rest.

Each distinct word of a piece is cut greedily into its longest vocabulary tokens, all words at once.
The cut is right if every token is what merging makes of its own characters and no merge joins two
neighbours before their inner merges are done; both are looked up for whole arrays of tokens and
pairs. Only words that fail are merged step by step. Results equal those of the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.pretokens import Encoder, byte_characters, lower_nfc, word_spans
from panelworks.llm.textarrays import distinct, gather_spans, gives_back, runs, slices, span_hashes, utf8

END = "</w>"
_LATE = np.int64(1) << 40
_WORD_END = np.uint64(0xC2B2AE3D27D4EB4F)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class WordBpe:
    """Merge table of a vocabulary whose words end in ``</w>``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.text = [b""] * size
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.text[i] = s.encode()
        byte = {c: b for b, c in enumerate(byte_characters())}
        self.inner = np.array([vocab[c] for c in byte_characters()], np.int64)
        self.final = np.array([vocab[c + END] for c in byte_characters()], np.int64)

        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.pair_rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (x, y) in enumerate(map(lambda m: m.split(" ") if isinstance(m, str) else m, merges)):
            a, b, made = vocab[x], vocab[y], vocab[x + y]
            self.pair_rank[a, b] = r, made
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = a, b, r
        keys = np.array([a << 32 | b for a, b in self.pair_rank], np.int64)
        order = np.argsort(keys)
        self.pairs = keys[order]
        self.pair_order, self.pair_made = np.array(list(self.pair_rank.values()), np.int64)[order].T.copy()

        spelled, ids = [], []
        for s, i in vocab.items():
            last = s.endswith(END) and len(s) > len(END)
            body = s.removesuffix(END) if last else s
            if all(c in byte for c in body):
                spelled.append((bytes(byte[c] for c in body), last))
                ids.append(i)
        raw = np.frombuffer(b"".join(b for b, _ in spelled), np.uint8)
        ends = np.cumsum([len(b) for b, _ in spelled])
        starts = ends - [len(b) for b, _ in spelled]
        h = span_hashes(raw, starts, ends) ^ np.where([e for _, e in spelled], _WORD_END, np.uint64(0))
        order = np.argsort(h)
        self.token_hash, self.token_id = h[order], np.array(ids, np.int64)[order]
        self.longest = int((ends - starts).max())
        self.whole = np.zeros(size, bool)  # tokens that merging makes of their own characters
        for (b, last), i in zip(spelled, ids):
            self.whole[i] = self.merged(b, last) == [i]

    def merged(self, raw: bytes, last: bool = True) -> list[int]:
        """Exact merging of one word: the lowest rank first, the leftmost of equals."""
        ids = [int(self.inner[b]) for b in raw]
        if last and raw:
            ids[-1] = int(self.final[raw[-1]])
        while len(ids) > 1:
            best, made = min((self.pair_rank.get(p, (1 << 60, -1)) for p in zip(ids, ids[1:])))
            if made < 0:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and self.pair_rank.get((ids[k], ids[k + 1]), (-1, -1))[0] == best:
                    out.append(made)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps each pair of tokens apart.

        A merge of rank m joins x, on the right edge of a's tree, with y, on the left edge of b's, if
        it comes before x's own merge (rank > m) and not after y's (rank >= m: the left one is first).
        """
        apart = np.ones(len(a), bool)
        i, x, x_until = np.arange(len(a)), a.copy(), np.full(len(a), _LATE)
        while len(i):
            k, y, y_until = np.arange(len(i)), b[i], np.full(len(i), _LATE)
            while len(k):
                m = _lookup(self.pairs, self.pair_order, x[k] << 32 | y, -1)
                apart[i[k[(m >= 0) & (m < x_until[k]) & (m <= y_until)]]] = False
                on = (self.left[y] >= 0) & apart[i[k]]
                k, y_until, y = k[on], self.rank[y[on]], self.left[y[on]]
            on = (self.right[x] >= 0) & apart[i]
            i, x_until, x = i[on], self.rank[x[on]], self.right[x[on]]
        return apart

    def _greedy(self, raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of each word's longest matches, in order."""
        n = len(raw)
        word = np.repeat(np.arange(len(at)), end - at)
        pos = np.arange(n)[np.repeat(at - np.concatenate([[0], np.cumsum(end - at)[:-1]]), end - at) + np.arange(len(word))]
        size, token = np.ones(n, np.int64), np.full(n, -1, np.int64)
        room = end[word] - pos
        token[pos] = np.where(room == 1, self.final[raw[pos]], self.inner[raw[pos]])
        for length in range(2, self.longest + 1):
            fits = room >= length
            if not fits.any():
                break
            pos, room = pos[fits], room[fits]
            h = span_hashes(raw, pos, pos + length) ^ np.where(room == length, _WORD_END, np.uint64(0))
            found = _lookup(self.token_hash, self.token_id, h, -1)
            hit = found >= 0
            size[pos[hit]], token[pos[hit]] = length, found[hit]
        out_word, out_token, w, p, turn = [], [], np.arange(len(at)), at.copy(), []
        w, p = w[p < end], p[p < end]
        step = 0
        while len(w):
            out_word.append(w)
            out_token.append(token[p])
            turn.append(np.full(len(w), step))
            p = p + size[p]
            on = p < end[w]
            w, p, step = w[on], p[on], step + 1
        words = np.concatenate(out_word)
        order = np.lexsort((np.concatenate(turn), words))
        return words[order], np.concatenate(out_token)[order]

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of each word's ids."""
        raw, at = utf8(strings)
        end = np.append(at[1:], len(raw)) - 1
        words, tokens = self._greedy(raw, at, end)
        failed = np.zeros(len(strings), bool)
        failed[words[~self.whole[tokens]]] = True
        near = np.flatnonzero(words[1:] == words[:-1])
        uniq, seen, inverse = distinct((tokens[near] << 32 | tokens[near + 1]).astype(np.uint64))
        good = self.compatible(tokens[near][seen], tokens[near + 1][seen])
        failed[words[near[~good[inverse]]]] = True
        fine = ~failed[words]
        w, t = self._exact(raw, at, end, np.flatnonzero(failed))
        words, tokens = np.concatenate([words[fine], w]), np.concatenate([tokens[fine], t])
        order = np.argsort(words, kind="stable")
        return tokens[order].astype(np.uint32), np.bincount(words, minlength=len(strings))

    def _exact(self, raw: np.ndarray, at: np.ndarray, end: np.ndarray, which: np.ndarray) -> tuple:
        """(word, token) by merging: in each round every word takes its lowest pair, leftmost first."""
        size = end[which] - at[which]
        word = np.repeat(which, size)
        codes = gather_spans(raw, at[which], size)
        token = self.inner[codes]
        last = np.cumsum(size) - 1
        token[last] = self.final[codes[last]]
        done = [(word[:0], token[:0])]
        while len(word):
            inside = word[1:] == word[:-1]
            pair = np.minimum(np.searchsorted(self.pairs, key := token[:-1] << 32 | token[1:]), len(self.pairs) - 1)
            rank = np.append(np.where(inside & (self.pairs[pair] == key), self.pair_order[pair], _LATE), _LATE)
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            count = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, first), count)
            over = best == _LATE
            done.append((word[over], token[over]))
            hit = (rank == best) & ~over
            start, stop = runs(hit)  # in a run of equal pairs every second one overlaps the one before
            odd = np.arange(int((stop - start).sum())) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start)
            taken = np.flatnonzero(hit)[odd % 2 == 0]
            token[taken] = self.pair_made[pair[taken]]
            keep = ~over
            keep[taken + 1] = False
            word, token = word[keep], token[keep]
        w, t = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(w, kind="stable")
        return w[order], t[order]


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(2)
def word_encoder(path: str) -> Encoder:
    bpe = word_bpe(path)
    return Encoder(word_spans, bpe.encode, bpe.specials, lower_nfc)


@gives_back
def _round_trip(batches: Iterator[pa.RecordBatch], path: str, with_texts: bool) -> Iterator[pa.RecordBatch]:
    encoder, text = word_encoder(path), word_bpe(path).text
    for batch in slices(batches, "_text"):
        n, ids_hash, decoded_hash, ids_out, texts_out = [], [], [], [], []
        for _, ids in encoder.documents(batch.column("_text").to_pylist()):
            decoded = b" ".join([text[k] for k in ids.tolist()])
            packed = ids.astype("<u4").tobytes()
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(packed).hexdigest())
            decoded_hash.append(hashlib.sha256(decoded).hexdigest())
            if with_texts:
                ids_out.append(ids)
                texts_out.append(decoded.decode())
        made = [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        if with_texts:
            made += [pa.array([x.tolist() for x in ids_out], pa.list_(pa.int64())), pa.array(texts_out, pa.string())]
            names += ["ids", "decoded"]
        kept = [(batch.column(i), f) for i, f in enumerate(batch.schema.names) if f != "_text"]
        yield pa.RecordBatch.from_arrays([c for c, _ in kept] + made, [f for _, f in kept] + names)


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  with_texts: bool = False) -> DataFrame:
    """Ids of each whole text and their decoding: counts and digests, on demand the ids and texts.

    One row per input row, in no stated order, with the columns ``keep`` before the result (others
    are dropped, so names cannot clash). A null text counts as empty: no ids, decoded as "".
    Repeated rows give repeated results. Decoding joins the tokens' own strings with blanks, as the
    library does for this file, which names no decoder.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{kept}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_texts:
        schema += ", ids array<bigint>, decoded string"
    return rows.mapInArrow(partial(_round_trip, path=path, with_texts=with_texts), schema)
