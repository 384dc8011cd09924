"""Language of every word by a linear-chain conditional random field, and of documents from their words.

Words are runs of letters. A word's features are its n-grams of one to four letters with its bounds
(so affixes too) and the word itself (the lexicon), hashed into one weight table; transitions between
the languages of neighbouring words are learned with them. Training sequences are spliced from spans
of documents of different languages, so switches inside a text are seen. They are written once, as
blocks of bounded size; in every round the tasks find the expected counts of their blocks, and the
driver adds up one gradient per block. Decoding is forward-backward over whole texts. Long texts are
cut into segments that are joined exactly by products of their transition matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.textarrays import LETTER, classes, code_points, distinct, gives_back, lower_table, mix, pieces, runs, slices, span_hashes
from panelworks.session import materialize

TRAIN_DOCS = 1000  # expected number of training documents, drawn by hash, equally many per language
TRAIN_CHARS = 4_000_000  # and their expected number of characters at most
SLICE_WORDS = 1 << 13
PREDICT_CHARS = 1 << 18
BLOCK_CHARS = 1 << 20
SLICE = 1 << 20  # numbers in a lattice of a task at once
BITS, LONGEST_GRAM = 18, 4
ROUNDS, RATE, DECAY = 30, 0.15, 1e-5
SPAN, LENGTH, SEED = (4, 24), 48, 11
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (features, languages)
    switch: np.ndarray  # log transition weights, from row to column


class _Words:
    """Words of a piece: code points, spans, distinct ones, and which of those each word is."""

    def __init__(self, texts: Sequence[str]) -> None:
        cp, first, _ = code_points(texts)
        cp = lower_table()[cp]
        self.cp = cp
        self.start, self.end = runs(classes()[cp] == LETTER)
        self.at = np.append(np.searchsorted(self.start, first), len(self.start))
        self.hashes, seen, self.kind = distinct(span_hashes(cp, self.start, self.end))
        self.type_start, self.type_end = self.start[seen], self.end[seen]

    def features(self, part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers of the distinct words of ``part``, the word of each, and a weight per word."""
        begin, hashes = self.type_start[part], self.hashes[part]
        size = self.type_end[part] - begin
        wide = size + 2  # with a mark before and after
        ends = np.cumsum(wide)
        word = np.repeat(np.arange(len(size)), wide)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - (ends - wide)[word]
        at = np.clip(begin[word] + place - 1, 0, len(self.cp) - 1)
        units = np.where(place == 0, 2, np.where(place == wide[word] - 1, 3, self.cp[at])).astype(np.uint64)
        left = wide[word] - place
        grams, owners = [hashes], [np.arange(len(size))]
        h = np.zeros(len(units), np.uint64)
        for n in range(1, LONGEST_GRAM + 1):
            shifted = np.concatenate([units[n - 1 :], np.zeros(n - 1, np.uint64)])
            h = mix(h * np.uint64(0x100000001B3) + shifted + np.uint64(n << 32))
            whole = left >= n
            grams.append(h[whole])
            owners.append(word[whole])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        number = (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)
        owner = owner[order]
        return number[order], owner, 1 / np.sqrt(np.bincount(owner, minlength=len(size)) + 1.0)


def _type_scores(number: np.ndarray, owner: np.ndarray, share: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(share):
        return np.zeros((0, weights.shape[1]))
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return np.add.reduceat(weights[number], begin, axis=0) * share[:, None]


def _exp(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=1, keepdims=True))


def _sequences(words: _Words, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequences, LENGTH) of distinct words and of languages, spliced from spans of all documents."""
    draw = np.random.default_rng(SEED)
    n = len(words.kind)
    label = np.repeat(lang, np.diff(words.at))
    cut = np.cumsum(draw.integers(*SPAN, size=n // SPAN[0] + 1))
    bounds = np.unique(np.concatenate([[0], cut[cut < n], words.at[words.at < n], [n]]))
    spans = draw.permutation(len(bounds) - 1)
    size = np.diff(bounds)[spans]
    index = np.repeat(bounds[:-1][spans] - (np.cumsum(size) - size), size) + np.arange(n)
    index = np.resize(index, -(-n // LENGTH) * LENGTH).reshape(-1, LENGTH)
    return words.kind[index], label[index]


_BLOCK = ["number", "owner", "share", "kinds", "label"]
_BLOCK_TYPES = ["<i4", "<i4", "<f8", "<i4", "<i2"]


@gives_back
def _blocks(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to blocks of training sequences, with the features of their distinct words."""
    known = {x: k for k, x in enumerate(langs)}
    texts, lang = [], []

    def made() -> Iterator[pa.RecordBatch]:
        words = _Words(texts)
        if not len(words.kind):
            return
        number, owner, share = words.features()
        kinds, label = _sequences(words, np.array(lang))
        arrays = [number, owner, share, kinds, label]
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(arrays, _BLOCK_TYPES)], _BLOCK)

    for batch in batches:
        of = batch.column("lang").to_pylist()
        for first, part, _ in pieces(batch.column("text").to_pylist(), BLOCK_CHARS):
            if texts and sum(map(len, texts)) + sum(map(len, part)) > BLOCK_CHARS:
                yield from made()
                texts, lang = [], []
            texts += part
            lang += [known[x] for x in of[first : first + len(part)]]
    if texts:
        yield from made()


def expectations(kinds: np.ndarray, label: np.ndarray, scores: np.ndarray, switch: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of labelled sequences, and expected minus observed counts of (word, language) and of switches."""
    k, length = scores.shape[1], kinds.shape[1]
    top, e_all, a = scores.max(axis=1), _exp(scores), np.exp(switch - switch.max())
    by_type, pairs, likelihood = np.zeros(scores.shape), np.zeros((k, k)), 0.0
    step = max(1, SLICE // (length * k))
    for at in range(0, len(kinds), step):
        x, y = kinds[at : at + step], label[at : at + step]
        e, count = e_all[x], len(x)
        alpha, beta = np.empty((length, count, k)), np.ones((length, count, k))
        state = np.ones((count, k))
        for t in range(length):
            state = (state @ a if t else state) * e[:, t]
            total = state.sum(axis=1, keepdims=True)
            likelihood -= float(np.log(total).sum())
            state = state / total
            alpha[t] = state
        for t in range(length - 1, 0, -1):
            ahead = e[:, t] * beta[t]
            norm = ((alpha[t - 1] @ a) * ahead).sum(axis=1, keepdims=True)
            pairs += a * (alpha[t - 1].T @ (ahead / norm))
            back = ahead @ a.T
            beta[t - 1] = back / back.sum(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        off = post.transpose(1, 0, 2).reshape(-1, k)
        off[np.arange(len(off)), y.ravel()] -= 1
        np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        likelihood += float((scores[x, y] - top[x]).sum() + (switch[y[:, :-1], y[:, 1:]] - switch.max()).sum())
        flat = x.ravel()
        by_type += np.stack([np.bincount(flat, off[:, c], minlength=len(scores)) for c in range(k)], axis=1)
    return likelihood, by_type, pairs


@gives_back
def _gradients(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of each block: sequences, log likelihood, gradients of the switches and of the features that occur in it."""
    weights, switch = shared.value
    k = len(switch)
    for batch in batches:
        for raw in batch.select(_BLOCK).to_pylist():
            number, owner, share, kinds, label = (np.frombuffer(raw[c], t) for c, t in zip(_BLOCK, _BLOCK_TYPES))
            kinds, label = kinds.reshape(-1, LENGTH), label.reshape(-1, LENGTH)
            scores = _type_scores(number, owner, share, weights).astype(np.float64)
            likelihood, by_type, pairs = expectations(kinds, label, scores, switch)
            by_type *= share[:, None]
            there, place = np.unique(number, return_inverse=True)
            grad = np.stack([np.bincount(place, by_type[owner, c], minlength=len(there)) for c in range(k)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(kinds)], pa.int64()), pa.array([likelihood]),
                 *[pa.array([x.tobytes()], pa.binary()) for x in (pairs, there.astype("<i4"), grad.astype("<f4"))]],
                ["n", "likelihood", "pairs", "numbers", "gradient"])


def objective(blocks: DataFrame, weights: np.ndarray, switch: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood with its penalty, and its gradients. One row per block reaches the driver."""
    context = blocks.sparkSession.sparkContext
    shared = context.broadcast((weights, switch))  # 2^BITS weights per language
    count, loss, grad, pairs = 0, 0.0, np.zeros(weights.shape, np.float32), np.zeros(switch.shape)
    rows = blocks.mapInArrow(partial(_gradients, shared=shared), "n bigint, likelihood double, pairs binary, numbers binary, gradient binary")
    for r in rows.collect():
        count, loss = count + r["n"], loss - r["likelihood"]
        pairs += np.frombuffer(r["pairs"]).reshape(pairs.shape)
        grad[np.frombuffer(r["numbers"], "<i4")] += np.frombuffer(r["gradient"], "<f4").reshape(-1, len(switch))
    shared.destroy()
    loss = loss / count + DECAY / 2 * (float((weights.astype(np.float64) ** 2).sum()) + float((switch**2).sum()))
    return loss, grad / np.float32(count) + np.float32(DECAY) * weights, pairs / count + DECAY * switch


def train(blocks: DataFrame, langs: list[str]) -> Model | None:
    """A model from blocks of sequences; None without a word. Adam on the sums of all blocks' gradients."""
    if blocks.isEmpty():
        return None
    k = len(langs)
    params = [np.zeros((1 << BITS, k), np.float32), np.zeros((k, k))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, ROUNDS + 1):
        _, *grads = objective(blocks, *params)
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Model(langs, *params)


def forward_backward(e: np.ndarray, at: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Posterior of every word: e (words, languages) > 0, documents' bounds ``at``, transitions ``a`` > 0."""
    k = e.shape[1]
    step = max(32, 8 * k)
    n = np.diff(at)
    segs = -(-n // step)
    doc = np.repeat(np.arange(len(n)), segs)
    head = np.cumsum(segs) - segs
    turn = np.arange(len(doc)) - head[doc]
    start = at[:-1][doc] + turn * step
    size = np.minimum(step, at[1:][doc] - start)
    order = np.argsort(-size, kind="stable")
    start_o, active = start[order], [int((size > t).sum()) for t in range(step)]
    longest = active.index(0) if 0 in active else step
    alpha_in, beta_out = np.full((len(doc), k), 1 / k), np.ones((len(doc), k))
    most = int(segs.max()) if len(segs) else 0
    if most > 1:
        m = np.empty((len(doc), k, k))
        m[:] = np.eye(k)
        for t in range(longest):
            c = active[t]
            m[:c] = m[:c] @ (a * e[start_o[:c] + t][:, None, :])
            m[:c] /= m[:c].sum(axis=(1, 2), keepdims=True)
        whole = np.empty_like(m)
        whole[order] = m
        for j in range(most - 1):
            s = head[segs > j + 1] + j
            v = np.einsum("nk,nkl->nl", alpha_in[s], whole[s])
            alpha_in[s + 1] = v / v.sum(axis=1, keepdims=True)
        for j in range(most - 1, 0, -1):
            s = head[segs > j] + j
            v = np.einsum("nkl,nl->nk", whole[s], beta_out[s])
            beta_out[s - 1] = v / v.sum(axis=1, keepdims=True)
    post = np.empty((len(e), k))
    state = alpha_in[order]
    for t in range(longest):
        c = active[t]
        w = start_o[:c] + t
        state = (state[:c] @ a) * e[w]
        state /= state.sum(axis=1, keepdims=True)
        post[w] = state
    tail = beta_out[order]
    for t in range(longest - 1, -1, -1):
        c = active[t]
        w = start_o[:c] + t
        post[w] *= tail[:c]
        back = (e[w] * tail[:c]) @ a.T
        tail[:c] = back / back.sum(axis=1, keepdims=True)
    return post / post.sum(axis=1, keepdims=True)


def _word_scores(words: _Words, model: Model) -> np.ndarray:
    """Scores of all words; features are made for SLICE_WORDS distinct words at a time, which bounds their memory."""
    if not len(words.kind):
        return np.zeros((0, len(model.langs)))
    slices = [slice(k, k + SLICE_WORDS) for k in range(0, len(words.hashes), SLICE_WORDS)]
    return np.concatenate([_exp(_type_scores(*words.features(x), model.weights)) for x in slices])[words.kind]


def _emissions(texts: Sequence[str], model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, word scores, bounds) by pieces; parts of a long document are put together."""
    parts: list[np.ndarray] = []
    for first, part, whole in pieces(texts, PREDICT_CHARS):
        words = _Words(part)
        e = _word_scores(words, model)
        at = words.at
        if not whole:
            parts.append(e)
            continue
        if parts:
            at = at + sum(map(len, parts))
            at[0] = 0
            e, parts = np.concatenate([*parts, e]), []
        yield first, e, at


def _spans(label: np.ndarray, langs: list[str]) -> list[dict]:
    begin = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(label) else []
    return [{"first": int(i), "words": int(j - i), "lang": langs[label[i]]} for i, j in zip(begin, [*begin[1:], len(label)])]


@gives_back
def _predict(batches: Iterator[pa.RecordBatch], shared: Broadcast, with_spans: bool) -> Iterator[pa.RecordBatch]:
    model: Model | None = shared.value
    for batch in slices(batches, "_text"):
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        pred, score, count, switches, spans = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), int), np.zeros(len(texts), int), [[]] * len(texts)
        for first, e, at in _emissions(texts, model) if model else ():
            post = forward_backward(e, at, np.exp(model.switch - model.switch.max()))
            label = post.argmax(axis=1)
            for d in np.flatnonzero(np.diff(at)).tolist():
                mine = slice(at[d], at[d + 1])
                mean = post[mine].mean(axis=0)
                best = int(mean.argmax())
                pred[first + d], score[first + d] = model.langs[best], min(1.0, mean[best])
                count[first + d] = at[d + 1] - at[d]
                switches[first + d] = int((label[mine][1:] != label[mine][:-1]).sum())
                if with_spans:
                    spans[first + d] = _spans(label[mine], model.langs)
        made = [pa.array(pred, pa.string()), pa.array(score), pa.array(count), pa.array(switches)]
        names = ["lang_pred", "score", "n_words", "n_switches"]
        if with_spans:
            made.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
            names.append("spans")
        kept = [(batch.column(i), f) for i, f in enumerate(batch.schema.names) if f != "_text"]
        yield pa.RecordBatch.from_arrays([c for c, _ in kept] + made, [f for _, f in kept] + names)


def held_out() -> Column:
    """Documents that nothing is learned from: crc32(doc_id as text) mod 4 is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_blocks(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> tuple[DataFrame, list[str]] | None:
    """Training sequences of a sample of ``docs``, written once, and the languages; None without usable rows."""
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).orderBy("lang").collect()
    if not counts:
        return None
    unit, share, chars = 1 << 30, F.lit(0), 0.0
    for r in counts:
        part = min(1.0, train_docs / len(counts) / r["n"], train_chars / len(counts) / max(r["chars"], 1))
        chars += part * r["chars"]
        share = F.when(F.col("lang") == r["lang"], min(unit, int(unit * part) + 1)).otherwise(share)
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(unit)) < share)
    drawn = drawn.repartition(int(chars // BLOCK_CHARS) + 1).sortWithinPartitions("doc_id", "lang", "text")
    langs = [r["lang"] for r in counts]
    made = drawn.select("lang", "text").mapInArrow(partial(_blocks, langs=langs), ", ".join(f"{c} binary" for c in _BLOCK))
    return materialize(made, "blocks"), langs


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model | None:
    """Learn from ``train_docs`` documents or so, as many of each language, drawn by a hash of doc_id.

    Where these would exceed ``train_chars`` characters, fewer are drawn. Held-out rows and rows with a
    null lang, text or doc_id teach nothing. Both bounds hold on average; texts drawn are used whole, in
    blocks of 2^20 characters at most, so no task or driver holds more. What the driver holds are the
    model and a gradient of the features in each block, whose number the bounds limit. A single
    language is learned as well; the model grows with the number of languages, not of rows.
    """
    found = training_blocks(docs, train_docs, train_chars)
    return train(*found) if found else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: Sequence[str] = ("doc_id",),
            with_spans: bool = False) -> DataFrame:
    """Language of every whole text: ``keep``, lang_pred, score, n_words, n_switches, on demand spans.

    lang_pred has the largest mean posterior over the words, score is that mean; n_switches counts
    neighbouring words of different languages; spans are runs of words of one language (first word,
    words, lang). A null text, or one without a letter, is ``und`` with score 0; so is every text
    without a model. One row per input row; other columns are dropped.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{kept}, lang_pred string, score double, n_words bigint, n_switches bigint"
    if with_spans:
        schema += ", spans array<struct<first:bigint,words:bigint,lang:string>>"
    # at most 2^BITS weights per language
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_predict, shared=shared, with_spans=with_spans), schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, n_switches) of documents (doc_id, text, lang)."""
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
