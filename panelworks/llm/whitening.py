"""Whitening of embeddings from an exact integer scatter, added up over bit planes.

Entries become integers, and the integers of a batch bit planes: for each dimension one plane per bit
of its shifted values, packed across rows into 64-bit words. Ones in common of two planes (popcount of
their AND), weighted by 2^(a + b), add up to the exact sum of products of two dimensions. Each batch
shifts by its own smallest values and undoes that in integers, so no pass over the data is needed
beforehand. Batches are added up as exact integers in each task, tasks as decimals by Spark. Only the
d x d sums reach the driver, whatever the number of rows; there they are centred as integers, and the
eigenvectors of the covariance are refined beyond double precision.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = 1 << 52  # integers beyond are clamped, so that no product leaves a decimal(38)
NEGLIGIBLE = 1e-13  # share of the variance at which a direction counts as constant
REFINEMENTS = 3
BATCH_ROWS = 1 << 14
OUT_ROWS = 4096


@dataclass
class Whitening:
    n: int
    sums: list[int]  # per dimension
    axes: np.ndarray  # (dimensions, components), each divided by the root of its variance
    variance: np.ndarray  # per component, falling
    total: float  # trace of the covariance
    identity_error: float


def integers(values: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """floor(scale * c) + offset of doubles, clamped to +-2^52."""
    return np.clip(np.floor(values * scale) + offset, -LARGEST, LARGEST).astype(np.int64)


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, int]:
    size = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size), size


def _planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of shifted columns: words (planes, ceil(rows / 64)), dimension and bit of each, shifts."""
    low = x.min(axis=0)
    y = x - low
    width = [int(v).bit_length() for v in y.max(axis=0)]
    dim = np.repeat(np.arange(x.shape[1]), width)
    bit = np.concatenate([np.arange(w) for w in width]) if len(dim) else dim
    room = np.zeros((len(dim), -(-len(x) // 64) * 64), bool)
    for p, (d, b) in enumerate(zip(dim.tolist(), bit.tolist())):
        room[p, : len(x)] = (y[:, d] >> b) & 1
    return np.packbits(room, axis=1, bitorder="little").view(np.uint64), dim, bit, low


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and sums of products of the columns of an integer matrix, as Python integers."""
    n, d = x.shape
    words, dim, bit, low = _planes(x)
    q = len(dim)
    common = np.zeros((q, q), np.int64)
    for p in range(q):
        common[p, p:] = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
    common = np.triu(common) + np.triu(common, 1).T
    most = int(bit.max()) + 1 if q else 0
    kind = np.int64 if 2 * most + n.bit_length() < 62 else object
    weight = np.array([1 << b for b in bit.tolist()], kind)
    products, sums = np.zeros((d, d), object), np.zeros(d, object)
    if q:
        start = np.flatnonzero(np.concatenate([[True], dim[1:] != dim[:-1]]))
        there = dim[start]
        by_row = np.add.reduceat(common.astype(kind) * weight[:, None] * weight, start, axis=0)
        products[np.ix_(there, there)] = np.add.reduceat(by_row, start, axis=1).astype(object)
        sums[there] = np.add.reduceat(np.diagonal(common).astype(kind) * weight, start).astype(object)
    low = low.astype(object)
    # sum (y + l)(y' + l') = sum yy' + l sum y' + l' sum y + n l l'
    crossed = np.multiply.outer(low, sums)
    products = products + crossed + crossed.T + n * np.multiply.outer(low, low)
    return sums + n * low, products


def _scatter_rows(batches: Iterator[pa.RecordBatch], scale: int, offset: int) -> Iterator[pa.RecordBatch]:
    """One partition to (i, j, value): sums of products for i <= j, sums at j = -1, rows at (-1, -1)."""
    n, sums, products = 0, 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            values, size = _matrix(batch.column("_v").slice(at, BATCH_ROWS))
            if not size:
                continue
            s, p = scatter(integers(values, scale, offset))
            n, sums, products = n + len(values), sums + s, products + p
    if n:
        i, j = np.triu_indices(len(sums))
        value = [n, *sums.tolist(), *products[i, j].tolist()]
        i = np.concatenate([[-1], np.arange(len(sums)), i])
        j = np.concatenate([np.full(len(sums) + 1, -1), j])
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in value])], ["i", "j", "value"])


def usable(vectors: DataFrame, vector: str = "embedding", dimensions: int | None = None) -> DataFrame:
    """Rows whose vector has no null or non-finite entry and ``dimensions`` of them.

    Unless given, that is the most frequent length (ties: the longer).
    """
    v = F.col(vector)
    whole = vectors.filter(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    if dimensions is None:
        sizes = whole.groupBy(F.size(v).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
        most = sizes.orderBy(F.desc("_n"), F.desc("_d")).first()
        dimensions = most["_d"] if most else 0
    return whole.filter(F.size(v) == dimensions)


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of symmetric ``a`` from approximate ones (Ogita and Aishima, 2018)."""
    size = np.sqrt((a * a).sum())
    for _ in range(REFINEMENTS):
        r = np.eye(len(a), dtype=a.dtype) - x.T @ x
        s = x.T @ a @ x
        value = np.diagonal(s) / (1 - np.diagonal(r))
        apart = value[None, :] - value[:, None]
        near = 2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + size * np.sqrt((r * r).sum()))
        wide = np.abs(apart) > near
        e = np.where(wide, (s + value[None, :] * r) / np.where(wide, apart, 1), r / 2)
        x = x + x @ e
    return np.diagonal(x.T @ a @ x) / (x * x).sum(axis=0), x


def solve(n: int, sums: list[int], products: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """The whitening of a scatter: n^2 times the covariance is an exact integer matrix."""
    s = np.array(sums, object)
    exact = n * products - np.multiply.outer(s, s)
    v = exact.astype(np.longdouble) / np.longdouble(n) ** 2
    _, x = np.linalg.eigh(v.astype(np.float64))
    value, x = _refined(v, x.astype(np.longdouble))
    order = np.argsort(-value, kind="stable")
    total = np.trace(v)
    order = order[value[order] > NEGLIGIBLE * total][:components]
    axes = x[:, order] / np.sqrt(value[order])
    inner = axes.T @ v @ axes
    error = float(np.abs(inner - np.eye(len(order))).max()) if len(order) else 0.0
    return Whitening(n, [int(k) for k in sums], axes.astype(np.float64), value[order].astype(np.float64), float(total), error)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
        offset: int = OFFSET) -> Whitening | None:
    """The whitening of all ``usable`` vectors; None without one. d * (d + 3) / 2 sums reach the driver."""
    rows = usable(vectors, vector).select(F.transform(vector, lambda c: c.cast("double")).alias("_v"))
    parts = rows.mapInArrow(partial(_scatter_rows, scale=scale, offset=offset), "i int, j int, value string")
    total = parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    if not total:
        return None
    value = {(r["i"], r["j"]): int(r["value"]) for r in total}
    d = max(i for i, _ in value) + 1
    products = np.array([[value[min(i, j), max(i, j)] for j in range(d)] for i in range(d)], object)
    return solve(value[-1, -1], [value[i, -1] for i in range(d)], products, components)


def _deviation(x: np.ndarray, n: int, sums: Sequence[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exactly."""
    whole, rest = np.array([s // n for s in sums], object), np.array([s % n for s in sums], object)
    far = x - whole.astype(np.int64)
    reach = n * (int(np.abs(far).max(initial=0)) + 1)
    kind = np.int64 if reach * reach * len(sums) < 1 << 62 else object
    return ((n * far.astype(kind) - rest.astype(kind)) ** 2).sum(axis=1).tolist()


def _project(batches: Iterator[pa.RecordBatch], model: Whitening, scale: int, offset: int) -> Iterator[pa.RecordBatch]:
    sums, n = model.sums, model.n
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            x = integers(_matrix(part.column("_v"))[0], scale, offset)
            white = ((x - whole).astype(np.float64) - rest) @ model.axes
            exact = _deviation(x, n, sums)
            k = white.shape[1]
            kept = [c for c, f in zip(part.columns, part.schema.names) if f != "_v"]
            made = [pa.array([str(v) for v in exact]),
                    pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, white.ravel())]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*[f for f in part.schema.names if f != "_v"], "_exact", "whitened"])


def transform(vectors: DataFrame, model: Whitening | None, vector: str = "embedding", keep: Sequence[str] = ("vec_id",),
              scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``keep``, deviation, deviation_exact, whitened (array): one row per ``usable`` vector.

    deviation is the sum over dimensions of (n x - S)^2 as a long, null where that does not fit;
    deviation_exact holds it as decimal(38,0), null beyond. Without a model there are no rows.
    """
    rows = usable(vectors, vector, len(model.sums)) if model is not None else vectors.limit(0)
    rows = rows.select(*keep, F.transform(vector, lambda c: c.cast("double")).alias("_v"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    model = model or Whitening(1, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    out = rows.mapInArrow(partial(_project, model=model, scale=scale, offset=offset),
                          f"{kept}, _exact string, whitened array<double>")
    return out.select(*keep, F.expr("try_cast(_exact as bigint)").alias("deviation"),
                      F.expr("try_cast(_exact as decimal(38,0))").alias("deviation_exact"), "whitened")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact).

    One row per usable vector and component. Vectors that are null, hold a null or non-finite entry or
    differ in length from most others are left out; so are directions without variance (1e-13 of the
    total at most), because no scaling gives them a unit one: a table of equal vectors, of empty
    vectors or without rows gives no rows. Repeated rows and ids are rows of their own. Only ``key``
    and ``vector`` are read. identity_error is of the exact covariance under the linear map applied.
    """
    model = fit(vectors, vector, components)
    rows = transform(vectors, model, vector, [key])
    each = rows.select(F.col(key).alias("vec_id"), "deviation", "deviation_exact", F.posexplode("whitened").alias("_k", "whitened"))
    share = [float(v / model.total) for v in model.variance] if model else []
    explained = F.element_at(F.array(*[F.lit(s) for s in share or [0.0]]), F.col("_k") + 1)
    return each.select(
        "vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.n if model else 0).cast("bigint").alias("n"),
        "deviation", "whitened", explained.alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"), "deviation_exact")
