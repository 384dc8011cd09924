"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel on standardised statistics (Rahimi and Recht, 2007). Each
partition sums its part of the normal equations; the sums of all partitions are added row by row of
the matrix, and only that one matrix and a histogram of 1,024 bins reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.textarrays import LETTER, NUMBER, OTHER, SPACE, classes, code_points, documents_words, pieces
from panelworks.session import materialize

FEATURES, WIDTH, RIDGE, SEED = 256, 2.0, 1.0, 7
BINS = 1024
SIGNS = {"lines": "\n", "pipes": "|", "ends": ".!?", "bangs": "!", "symbols": "#$%&*@^~<>=+\\/_{}[]"}
STATISTICS = ["size", "letters", "upper", "digits", "signs", "blanks", "ends", "bangs", "symbols", "pipes", "lines",
              "word_length", "distinct", "repeats", "top_word", "foreign"]


@lru_cache(1)
def _upper() -> np.ndarray:
    return np.array([chr(c).isupper() for c in range(0x110000)])


def statistics(texts: Sequence[str | None]) -> np.ndarray:
    """(texts, STATISTICS) of whole texts; a null text counts as empty."""
    texts = [t or "" for t in texts]
    names = ["letter", "upper", "digit", "sign", "blank", *SIGNS, "foreign", "all"]
    counts = {k: np.zeros(len(texts)) for k in names}
    for first, part, _ in pieces(texts):
        cp, start, end = code_points(part)
        kind = classes()[cp]
        masks = {"letter": kind == LETTER, "upper": _upper()[cp], "digit": kind == NUMBER, "sign": kind == OTHER,
                 "blank": kind == SPACE, "foreign": (cp > 127) & (kind == LETTER), "all": np.ones(len(cp), bool)}
        masks |= {k: np.isin(cp, [ord(c) for c in v]) for k, v in SIGNS.items()}
        for k, m in masks.items():
            run = np.concatenate([[0], np.cumsum(m)])
            counts[k][first : first + len(part)] += run[end] - run[start]
    words, distinct, repeats, top = (np.zeros(len(texts)) for _ in range(4))
    for first, h, at in documents_words(texts):
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        here = slice(first, first + len(n))
        words[here], distinct[here] = n, np.bincount(doc[begin], minlength=len(n))
        often = np.zeros(len(n))
        np.maximum.at(often, doc[begin], np.diff(np.append(begin, len(h))))
        top[here] = often
        repeats[here] = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(n))
    c, w = counts, np.maximum(words, 1)
    size, letters = np.maximum(c["all"], 1), np.maximum(c["letter"], 1)
    made = [np.log1p(c["all"]), c["letter"] / size, c["upper"] / letters, c["digit"] / size, c["sign"] / size,
            c["blank"] / size, c["ends"] / w, c["bangs"] / w, c["symbols"] / w, c["pipes"] / w, c["lines"] / w,
            np.log1p((c["all"] - c["blank"]) / w), np.log1p(distinct) / np.log1p(w), repeats / w, top / w, c["foreign"] / letters]
    return np.stack(made, axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Fourier:
    """cos(Wx + b) of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = draw.normal(size=(len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)) / 2)
        self.b = draw.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _normal_rows(batches: Iterator[pa.RecordBatch], fourier: Fourier) -> Iterator[pa.RecordBatch]:
    """This partition's share of Z'Z and Z'y, a row of the matrix each."""
    n = FEATURES + 1
    total = np.zeros((n, n + 1))
    for batch in batches:
        z = fourier(_matrix(batch.column("x")))
        total += z.T @ np.column_stack([z, batch.column("y").to_numpy()])
    part = TaskContext.get().partitionId() % 256
    yield pa.RecordBatch.from_arrays(
        [pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
        ["part", "i", "row"])


def _add_rows(group: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(r) for r in group["row"]], axis=0)
    return pd.DataFrame({"part": [group["part"].iloc[0]], "i": [group["i"].iloc[0]], "row": [total.tobytes()]})


def _raw(batches: Iterator[pa.RecordBatch], fourier: Fourier, beta: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = np.clip(fourier(_matrix(batch.column("x"))) @ beta, 0, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum((raw * BINS).astype(np.int32), BINS - 1)), batch.column("y")], ["bin", "y"])


def isotonic(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising weighted least-squares fit."""
    blocks: list[list[float]] = []
    for weight, value in zip(n.tolist(), mean.tolist()):
        blocks.append([weight, value, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, v, k = blocks.pop()
            u = blocks[-1]
            u[1] = (u[0] * u[1] + w * v) / (u[0] + w)
            u[0] += w
            u[2] += k
    return np.concatenate([np.full(int(k), v) for _, v, k in blocks]) if blocks else np.zeros(0)


def _score(batches: Iterator[pa.RecordBatch], fourier: Fourier | None, beta: np.ndarray, at: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if fourier is None:
            s = np.full(batch.num_rows, 0.5)
        else:
            s = np.interp(np.clip(fourier(_matrix(batch.column("x"))) @ beta, 0, 1), at, level)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])


def fit(measured: DataFrame, labelled: DataFrame) -> tuple[Fourier | None, np.ndarray, np.ndarray, np.ndarray]:
    """Features, ridge weights and calibration (points, levels) from (doc_id, y) with y in 0..1.

    A quarter of the labelled documents, by hash, is kept for the calibration (all of them if that
    quarter lacks a class). Without labelled documents there is no model.
    """
    none = np.zeros(0)
    rows = materialize(measured.join(labelled, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4))), "labelled")
    k = range(len(STATISTICS))
    sums = rows.agg(F.count(F.lit(1)), *[F.avg(F.get("x", F.lit(i))) for i in k], *[F.stddev_pop(F.get("x", F.lit(i))) for i in k]).first()
    if not sums[0]:
        return None, none, none, none
    mean, spread = np.array(sums[1 : 1 + len(k)], float), np.array(sums[1 + len(k) :], float)
    fourier = Fourier(mean, np.where(spread > 1e-9, spread, 1.0))
    learn = rows.filter("fold > 0") if rows.filter("fold > 0").agg(F.count_distinct("y")).first()[0] > 1 else rows
    sums = learn.select("x", "y").mapInArrow(partial(_normal_rows, fourier=fourier), "part int, i int, row binary")
    schema = "part int, i int, row binary"
    sums = sums.groupBy("part", "i").applyInPandas(_add_rows, schema).groupBy("i").applyInPandas(_add_rows, schema)
    total = np.stack([np.frombuffer(r["row"]) for r in sums.orderBy("i").collect()])
    a = total[:, :-1] + RIDGE * np.diag([*[1.0] * FEATURES, 1e-9])
    beta = np.linalg.solve(a, total[:, -1])
    held = rows.filter("fold = 0")
    held = held if held.agg(F.count_distinct("y")).first()[0] > 1 else rows
    bins = held.select("x", "y").mapInArrow(partial(_raw, fourier=fourier, beta=beta), "bin int, y double")
    counted = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).orderBy("bin").collect()
    n, m = np.array([r["n"] for r in counted], float), np.array([r["m"] for r in counted], float)
    return fourier, beta, np.array([(r["bin"] + 0.5) / BINS for r in counted]), isotonic(n, m)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Learns from rows of ``labels`` (doc_id, quality; null quality is ignored, repeated ids are
    averaged) whose crc32(doc_id as text) mod 3 is not 1; held_out is that remainder being 1 (false
    for a null doc_id). score is 0..1, higher for quality 1; predicted is 1 from 0.5. Null and empty
    texts are scored by their statistics like others. Without any labels every score is 0.5.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    measured = materialize(rows.mapInArrow(_measure, "doc_id bigint, x array<double>"), "statistics")
    known = labels.filter(F.col("quality").isNotNull() & (fold != 1)).groupBy(F.col("doc_id").cast("bigint")).agg(
        F.avg(F.col("quality").cast("double")).alias("y")).select("doc_id", "y")
    fourier, beta, at, level = fit(measured, known)
    scored = measured.mapInArrow(partial(_score, fourier=fourier, beta=beta, at=at, level=level), "doc_id bigint, score double")
    return scored.select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
