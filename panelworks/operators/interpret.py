"""Feature importance and partial dependence, each as one scoring pass."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators.evaluate import grid_points
from panelworks.operators.models import score
from panelworks.operators.position import with_hash_rank


def tree_importance(model, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, importance) of a tree model; one row per feature."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.lit(float(x)).alias("importance"))
        for n, x in zip(names, model.featureImportances.toArray())
    ])
    return df.sparkSession.range(1).select(F.explode(pairs).alias("e")).select("e.*")


def _with_value(v: str, i, value):
    return F.transform(v, lambda x, at: F.when(at == i, value).otherwise(x))


def permutation_importance(
    model, df: DataFrame, key: str, v: str, label: str, features: Sequence[int], seed: int
) -> DataFrame:
    """Drop of accuracy when one feature is reordered: (feature, accuracy, drop).

    Every row meets the row of the same rank in another hash order and takes one value from it.
    """
    a = with_hash_rank(df.select(key, label, v), key, seed, name="_r")
    b = with_hash_rank(df.select(key, F.col(v).alias("_o")), key, seed + 1, name="_r").drop(key)
    tries = F.array(*[F.lit(i) for i in [-1, *features]])  # -1 leaves the row as it is
    each = a.join(b, "_r").select(key, label, v, "_o", F.explode(tries).alias("feature"))
    moved = each.withColumn("_v", _with_value(v, F.col("feature"), F.get("_o", F.greatest("feature", F.lit(0)))))
    scored = score(model, moved.select(label, "feature", "_v"), "_v")
    acc = scored.groupBy("feature").agg(F.avg((F.col(label) == F.col("cls")).cast("double")).alias("accuracy"))
    base = F.max(F.when(F.col("feature") == -1, F.col("accuracy")))
    return acc.withColumn("_b", acc.agg(base).scalar()).filter("feature >= 0").select(
        "feature", "accuracy", (F.col("_b") - F.col("accuracy")).alias("drop"))


def partial_dependence(
    model, df: DataFrame, key: str, v: str, features: Sequence[int], points: int = 10, per_row: bool = False
) -> DataFrame:
    """Mean score over all rows with features set to each grid value (or grid pair).

    The grid has at most ``points`` percentiles per feature, so rows grow by that constant only.
    Columns are ``value_<i>``, ``n`` and ``p``; with ``per_row`` the single curves (key, p).
    """
    slim = df.select(key, v)
    out = slim
    for i in features:
        column = slim.select(F.get(v, F.lit(i)).alias("x"))
        out = out.withColumn("_g", grid_points(column, "x", points).scalar())
        out = out.select(*[c for c in out.columns if c != "_g"], F.explode("_g").alias(f"value_{i}"))
    for i in features:
        out = out.withColumn(v, _with_value(v, F.lit(i), F.col(f"value_{i}")))
    scored = score(model, out, v)
    names = [f"value_{i}" for i in features]
    if per_row:
        return scored.select(key, *names, "p")
    return scored.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"))


def feature_orders(width: int, pairs: int, seed: int) -> list[list[int]]:
    """Seeded orders of the features, each followed by its reverse, which halves the spread of the means."""
    draw, out = random.Random(seed), []
    for _ in range(pairs):
        order = list(range(width))
        draw.shuffle(order)
        out += [order, order[::-1]]
    return out


def background_rows(df: DataFrame, key: str, v: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows in hash order: the stated bound on the rows that stand for a missing feature."""
    return with_hash_rank(df.select(key, v), key, seed, name="_r").filter(F.col("_r") <= n).select(
        (F.col("_r") - 1).cast("int").alias("_r"), v)


def row_contributions(
    model, df: DataFrame, key: str, v: str, background: DataFrame, orders: Sequence[Sequence[int]]
) -> DataFrame:
    """What each feature of each row adds to its score: (key, feature, contribution, p, base).

    Sampled Shapley values. In each order the features pass one by one from a background row to the
    row explained; a feature's contribution is the mean rise of the score as it passes. Order ``m`` takes
    background row ``m`` modulo their number (``background_rows``). The contributions of a row add up to
    ``p - base`` exactly, base being the mean score of the background rows taken; a single one has the
    spread of the sampled orders, and none with all orders of the features.

    ``v`` is an array of doubles, one row per key. A row is scored ``len(orders) * (width + 1)`` times in
    place; only sums per (key, feature) are shuffled. Rows without a key are left out; empty tables, of rows
    or background, give no rows.
    """
    width = len(orders[0])
    places = F.lit([[list(o).index(i) for i in range(width)] for o in orders])
    named = F.lit([[*o, -1] for o in orders])  # what passes after so many features; -1 after the last
    rows = background.agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", v))), lambda e: e[v])).scalar()
    each = (
        df.select(key, v).withColumn("_b", rows).filter(F.size("_b") > 0)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("_m"))
        .select(key, v, F.get("_b", F.col("_m") % F.size("_b")).alias("_z"), F.get(places, F.col("_m")).alias("_at"),
                F.get(named, F.col("_m")).alias("_o"), F.explode(F.sequence(F.lit(0), F.lit(width))).alias("_j"))
        .withColumn("_x", F.transform(v, lambda x, i: F.when(F.get("_at", i) < F.col("_j"), x).otherwise(F.get("_z", i))))
    )
    scored = score(model, each.select(key, "_x", "_o", "_j"), "_x")
    # a score counts for the feature that passed last and against the one that passes next; -1 is before the first
    last = F.when(F.col("_j") > 0, F.get("_o", F.col("_j") - 1)).otherwise(F.lit(-2))
    moves = F.array(
        F.struct(last.alias("feature"), F.col("p").alias("_d")),
        F.struct(F.get("_o", "_j").alias("feature"), (-F.col("p")).alias("_d")))
    sums = (
        scored.select(key, F.explode(moves).alias("_e")).groupBy(key, "_e.feature")
        .agg((F.sum("_e._d") / len(orders)).alias("contribution"))
    )
    whole = F.first(F.when(F.col("feature") == -1, -F.col("contribution")), ignorenulls=True)
    start = F.first(F.when(F.col("feature") == -2, F.col("contribution")), ignorenulls=True)
    ends = sums.filter("feature < 0").groupBy(key).agg(whole.alias("p"), start.alias("base"))
    return sums.filter("feature >= 0").join(ends, key).select(key, "feature", "contribution", "p", "base")
