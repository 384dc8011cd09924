"""Contributions of features to single scores, against exact enumeration."""

from itertools import combinations, permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from panelworks.operators import interpret as I
from panelworks.operators import models as M

WIDTH = 5


@pytest.fixture(scope="module")
def case(spark):
    rows = [(i, [float((i * a) % 11) for a in (1, 3, 4, 7, 9)]) for i in range(120)]
    df = spark.createDataFrame([(i, v, int(v[0] + v[2] > 9 or v[4] > 8)) for i, v in rows], "id long, v array<double>, y int")
    return M.fit_forest(df, "v", "y", trees=12, depth=4, min_leaf=2), df


def scores_of(spark, model, vectors):
    df = spark.createDataFrame([(k, list(v)) for k, v in vectors.items()], "k string, v array<double>")
    return {r["k"]: r["p"] for r in M.score(model, df, "v").collect()}


def exact(spark, model, x, zs):
    """Shapley values by the sum over all coalitions, averaged over the background."""
    out = [0.0] * WIDTH
    for z in zs:
        subsets = [c for n in range(WIDTH + 1) for c in combinations(range(WIDTH), n)]
        p = scores_of(spark, model, {str(c): [x[i] if i in c else z[i] for i in range(WIDTH)] for c in subsets})
        for i in range(WIDTH):
            for c in subsets:
                if i not in c:
                    weight = factorial(len(c)) * factorial(WIDTH - len(c) - 1) / factorial(WIDTH)
                    out[i] += weight * (p[str(tuple(sorted((*c, i))))] - p[str(c)]) / len(zs)
    return out


def test_all_orders_equal_exact_enumeration(spark, case):
    model, df = case
    z = df.filter("id = 17").select(F.lit(0).alias("_r"), "v")
    some = df.filter("id in (3, 17, 64)")
    got = I.row_contributions(model, some, "id", "v", z, list(permutations(range(WIDTH)))).collect()
    assert len(got) == 3 * WIDTH
    vectors = {r["id"]: r["v"] for r in some.collect()}
    for key, x in vectors.items():
        want = exact(spark, model, x, [vectors[17]])
        for r in got:
            if r["id"] == key:
                assert r["contribution"] == pytest.approx(want[r["feature"]], abs=1e-9)
    # the background row itself owes nothing to any feature
    assert all(abs(r["contribution"]) < 1e-12 for r in got if r["id"] == 17)


def test_sampled_contributions_add_up_and_come_near(spark, case):
    model, df = case
    orders = I.feature_orders(WIDTH, 60, 5)
    assert all(sorted(o) == list(range(WIDTH)) for o in orders) and orders == I.feature_orders(WIDTH, 60, 5)
    background = I.background_rows(df, "id", "v", 3, 4)
    assert background.count() == 3
    some = df.filter("id in (5, 80)")
    got = I.row_contributions(model, some, "id", "v", background, orders).collect()
    p = {r["id"]: r["p"] for r in M.score(model, some, "v").collect()}
    zs = [r["v"] for r in background.orderBy("_r").collect()]
    base = scores_of(spark, model, dict(zip("abc", zs)))
    for r in some.collect():
        mine = {g["feature"]: g for g in got if g["id"] == r["id"]}
        assert sorted(mine) == list(range(WIDTH))
        assert {round(g["p"], 9) for g in mine.values()} == {round(p[r["id"]], 9)}
        assert mine[0]["base"] == pytest.approx(sum(base.values()) / 3)
        assert sum(g["contribution"] for g in mine.values()) == pytest.approx(mine[0]["p"] - mine[0]["base"], abs=1e-9)
        want = exact(spark, model, r["v"], zs)
        assert max(abs(mine[i]["contribution"] - want[i]) for i in range(WIDTH)) < 0.05


def test_empty_tables(spark, case):
    model, df = case
    orders = I.feature_orders(WIDTH, 1, 5)
    background = I.background_rows(df, "id", "v", 2, 4)
    for rows, back in ((df.limit(0), background), (df, background.limit(0))):
        out = I.row_contributions(model, rows, "id", "v", back, orders)
        assert out.columns == ["id", "feature", "contribution", "p", "base"] and out.count() == 0
