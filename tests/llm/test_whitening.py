"""Whitening against plain integer arithmetic and numpy."""

import random
from fractions import Fraction

import numpy as np
import pytest

from panelworks.llm import whitening
from panelworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, whitened string, _v int"


def brute(rows, components=32):
    """(vec_id, deviation) of the rows kept, and the covariance, in whole numbers."""
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(d)]
    far = [(i, [n * x[k] - sums[k] for k in range(d)]) for i, x in kept]
    cov = [[Fraction(sum(f[a] * f[b] for _, f in far), n**3) for b in range(d)] for a in range(d)]
    return n, [(i, sum(c * c for c in f)) for i, f in far], np.array(cov, float), np.array([[c / n for c in f] for _, f in far])


def test_planes_give_exact_sums():
    draw = np.random.default_rng(1)
    for x in (draw.integers(-40, 40, (131, 5)), np.full((7, 3), -9), draw.integers(-(1 << 52), 1 << 52, (65, 3)), np.array([[5, 0, -1]])):
        sums, products = whitening.scatter(x)
        exact = x.astype(object)
        assert sums.tolist() == exact.sum(axis=0).tolist()
        assert products.tolist() == (exact.T @ exact).tolist()


def test_small_directions_keep_their_scale():
    draw = np.random.default_rng(3)
    x = np.stack([draw.integers(-(10**6), 10**6, 400), draw.integers(-1, 2, 400), draw.integers(-1, 2, 400)], axis=1)
    x = np.concatenate([x, x[:, :1] + draw.integers(-1, 2, (400, 1))], axis=1)
    model = whitening.solve(400, *[f(v) for f, v in zip((list, np.array), whitening.scatter(x))])
    assert model.identity_error < 1e-6 and len(model.variance) == 4
    white = (x - x.mean(axis=0)) @ model.axes
    assert np.abs(white.T @ white / 400 - np.eye(4)).max() < 1e-4


def test_query_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviation, cov, far = brute(rows)
    got = QUERIES["op11_bit_sliced_whitening"](spark, SF).toPandas()
    value, axes = np.linalg.eigh(cov)
    value, axes = value[::-1][:32], axes[:, ::-1][:, :32]
    assert len(got) == 32 * n and set(got["n"]) == {n}
    assert sorted(set(zip(got["vec_id"], got["deviation"]))) == sorted(deviation)
    want = np.abs(far @ axes / np.sqrt(value))
    order = {i: k for k, (i, _) in enumerate(deviation)}
    table = np.zeros_like(want)
    table[[order[i] for i in got["vec_id"]], got["component"] - 1] = got["whitened"]
    assert np.allclose(np.abs(table), want, atol=1e-6)
    assert np.allclose(table.T @ table / n, np.eye(32), atol=1e-8)
    explained = got.drop_duplicates("component").sort_values("component")["explained"]
    assert np.allclose(explained, value / np.trace(cov), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() <= 1e-4


def test_odd_vectors(spark):
    draw = random.Random(4)
    good = [(i % 20, [draw.uniform(-1, 1) for _ in range(3)], "mine", 0) for i in range(40)]
    good += [(50, [0.5, 0.5, 0.5], "mine", 0)] * 25 + [(None, [0.1, 0.2, 0.3], None, None)]
    odd = [(90, None), (91, [1.0, None, 0.0]), (92, [float("nan"), 0.0, 0.0]), (93, [float("inf"), 0.0, 0.0]), (94, [1.0]), (95, [])]
    df = spark.createDataFrame(good + [(i, v, "x", 1) for i, v in odd], SCHEMA)
    n, deviation, _, _ = brute([(i, [float(np.float32(c)) for c in v]) for i, v, _, _ in good])
    got = whitening.whiten(df).collect()
    assert sorted(((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1), key=repr) == sorted(deviation, key=repr)
    assert n == 66 and len(got) == 3 * n


@pytest.mark.parametrize("rows", [[], [(1, [], "", 0)], [(1, None, "", 0)], [(1, [1.0, 2.0], "", 0)], [(k, [1.0, 2.0], "", 0) for k in range(5)]])
def test_no_direction(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_flat_direction_and_huge_entries(spark):
    rows = [(k, [float(k), 2.0, 3e38 if k == 3 else 0.0], "", 0) for k in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2} or {r["component"] for r in got} == {1}
    assert all(r["identity_error"] <= 1e-4 for r in got)
