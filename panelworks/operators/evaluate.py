"""Evaluation of scores and classes; every figure comes from pre-aggregated counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.scalars import above
from panelworks.operators.aggregate import exact_quantiles
from panelworks.operators.position import range_segments, running_within_segments


def confusion_shares(df: DataFrame, y: str, cls: str) -> DataFrame:
    """Shares of all rows: tn, fp, fn, tp."""
    cell = lambda a, b: F.avg(((F.col(y) == a) & (F.col(cls) == b)).cast("double"))
    return df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def accuracy(df: DataFrame, y: str, cls: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(cls)).cast("double")).alias("accuracy"))


def rmse(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))).alias("rmse"))


def classification_report(df: DataFrame, y: str, cls: str) -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg."""
    cells = df.groupBy(F.col(y).alias("a"), F.col(cls).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("a").alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("t")),
        F.struct(F.col("b").alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("t")))).alias("e")).select("e.*")
    per = sides.groupBy("c").agg(F.sum("s").alias("support"), F.sum("p").alias("pred"), F.sum("t").alias("tp"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumns({"precision": zero(F.col("tp"), F.col("pred")), "recall": zero(F.col("tp"), F.col("support"))})
    per = per.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = ["precision", "recall", "f1"]
    classes = per.select(F.col("c").cast("string").alias("label"), *cols, "support")
    acc = F.sum("tp") / F.sum("support")
    rows = [
        ("accuracy", [acc] * 3),
        ("macro avg", [F.avg(c) for c in cols]),
        ("weighted avg", [F.sum(F.col(c) * F.col("support")) / F.sum("support") for c in cols]),
    ]
    totals = per.agg(F.array(*[
        F.struct(F.lit(n).alias("label"), *[e.alias(c) for e, c in zip(es, cols)], F.sum("support").alias("support"))
        for n, es in rows]).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return classes.unionByName(totals)


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties averaged; null if one class is missing.

    Rows without a score (null or NaN) are left out.
    """
    s = F.nanvl(F.col(score).cast("double"), F.lit(None))
    by_score = df.select(s.alias("_s"), y).filter(F.col("_s").isNotNull()).groupBy("_s").agg(
        F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    by_score = range_segments(by_score, "_s", name="_seg")
    placed = running_within_segments(by_score, "_s", [], ["_n"])
    wins = F.sum(F.col("_p").cast("double") * (F.col("_n_before") + F.col("_n") / 2))
    return placed.agg(F.try_divide(wins, F.sum("_p").cast("double") * F.sum("_n").cast("double")).alias("auc"))


def threshold_sweep(df: DataFrame, y: str, score: str, lo: int = 20, hi: int = 79) -> DataFrame:
    """Class 1 from ``score >= i / 100`` for i in lo ... hi: accuracy, recalls, precision.

    Rows are counted per hundredth once; the thresholds are running sums over those counts.
    """
    s = F.col(score).cast("double")
    guess = F.floor(s * 100)
    step = (
        F.when(s >= (guess + 1) / F.lit(100.0), guess + 1)
        .when(s < guess / F.lit(100.0), guess - 1)
        .otherwise(guess)
    )
    counts = df.groupBy(F.greatest(F.least(step, F.lit(hi)), F.lit(lo - 1)).alias("i")).agg(
        F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    grid = df.sparkSession.range(lo - 1, hi + 1).select(F.col("id").alias("i"))
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("i"))  # one row per threshold
    full = grid.join(counts, "i", "left").fillna(0)
    run = full.withColumns({"tp": F.sum("p").over(up), "fp": F.sum("n").over(up)})
    every = Window.partitionBy(F.lit(0))
    run = run.withColumns({"pos": F.sum("p").over(every), "neg": F.sum("n").over(every)}).filter(F.col("i") >= lo)
    tn = F.col("neg") - F.col("fp")
    return run.select(
        (F.col("i") / F.lit(100.0)).alias("threshold"),
        F.try_divide(F.col("tp") + tn, F.col("pos") + F.col("neg")).alias("accuracy"),
        F.try_divide("tp", "pos").alias("recall_1"),
        F.try_divide(tn, F.col("neg")).alias("recall_0"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_1"))


def prediction_table(scores: DataFrame, labels: DataFrame, test_ids: DataFrame, key: str, score: str, y: str) -> DataFrame:
    """Score, class (> 0.5) and truth of the test ids, aligned by id."""
    joined = scores.join(labels, key).join(test_ids.select(key), key, "left_semi")
    return joined.select(key, score, above(score, 0.5).alias("cls"), F.col(y).alias("truth"))


# --- target by percentile bucket --------------------------------------------------------


def grid_points(df: DataFrame, column: str, points: int = 10) -> DataFrame:
    """One row: the sorted distinct percentiles at equally spaced points from 0 to 100."""
    q = exact_quantiles(df, column, [i / (points - 1) for i in range(points)])
    return q.agg(F.array_sort(F.collect_set("value")).alias("grid"))


def _bucket(value, grid):
    """0-based bucket: left-closed, the last one closed on both sides; null for an unknown value."""
    at = F.size(F.filter(grid, lambda e: e <= value)) - 1
    return F.when(value.isNotNull(), F.least(at, F.greatest(F.size(grid) - 2, F.lit(0))))


def target_by_bucket(df: DataFrame, columns: Sequence[str], target: str, points: int = 10) -> DataFrame:
    """Count and mean target per percentile bucket of one or more features.

    Unknown values (null or NaN) have a bucket of their own, null.
    """
    out = df
    for c in columns:
        out = out.withColumn(f"_g_{c}", grid_points(df, c, points).scalar())
    out = out.withColumns({f"bucket_{c}": _bucket(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.col(f"_g_{c}")) for c in columns})
    return out.groupBy(*[f"bucket_{c}" for c in columns]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate"))
