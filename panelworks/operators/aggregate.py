"""Aggregates that hold no group's values in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators.position import range_segments


def conflicting_ids(df: DataFrame, key: str, period: str, checked: str) -> DataFrame:
    """Ids with more than one known ``checked`` value in one period."""
    return (
        df.groupBy(key, period)
        .agg(F.count(checked).alias("_n"))
        .filter(F.col("_n") > 1)
        .select(key)
        .distinct()
    )


def distinct_counts(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Distinct known values per key, ``{output: input}``."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.count_distinct(F.col(c)).alias(out) for out, c in columns.items()]
    )


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    )


def lookup_aggregate(df: DataFrame, key: str, agg: Column, name: str) -> DataFrame:
    """Put a per-key aggregate on every row of the key; null keys get none."""
    stats = df.filter(F.col(key).isNotNull()).groupBy(key).agg(agg.alias(name))
    return df.join(stats, key, "left")


def mean_by(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], digits: int | None = None
) -> DataFrame:
    """Means of known values per key, ``{output: input}``; null keys are left out.

    With ``digits`` the sums are decimals of that scale, so a mean never hangs on the order of rows.
    """

    def mean(c: str) -> Column:
        if digits is None:
            return F.avg(c)
        return F.try_divide(F.sum(F.col(c).cast(f"decimal(28,{digits})")).cast("double"), F.count(c))

    known = df
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(*[mean(c).alias(out) for out, c in columns.items()])


def modes(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent known value, smallest on ties. Counts first, so state stays one row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return counts.groupBy(*by).agg(
        F.min_by(value, F.struct((-F.col("_n")).alias("a"), F.col(value).alias("b"))).alias(name)
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    name: str = "value",
) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (by, prob, value).

    Values are counted first (a hot value is one row), dealt into balanced ranges of (by, value),
    and only the one or two ranges that hold a wanted rank are searched. NaN counts as unknown.
    """
    by = list(by)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    counts = df.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = range_segments(counts, *by, "_v", name="_seg")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # rows are segments
    up = group.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("prob") * (F.col("_total") - 1)

    def holds(first, n):
        last = first + n - 1
        return (F.col("_lo").between(first, last)) | (F.col("_hi").between(first, last))

    hit = (
        counts.groupBy(*by, "_seg").agg(F.sum("_n").alias("_in"))
        .withColumns({"_before": F.coalesce(F.sum("_in").over(up), F.lit(0)), "_total": F.sum("_in").over(group)})
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumns({"_at": at, "_lo": F.floor(at), "_hi": F.ceil(at)})
        .filter(holds(F.col("_before"), F.col("_in")))
    )
    here = Window.partitionBy(*by, "_seg", "prob").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        counts.join(hit, [*by, "_seg"])
        .withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(here), F.lit(0)))
        .filter(holds(F.col("_first"), F.col("_n")))
    )
    step = F.max("_at") - F.max("_lo")
    return found.groupBy(*by, "prob").agg((F.min("_v") + (F.max("_v") - F.min("_v")) * step).alias(name))


def exact_medians(
    df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median"
) -> DataFrame:
    return exact_quantiles(df, value, [0.5], by, name).drop("prob")


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence) -> DataFrame:
    """Contingency table with an explicit value list; empty cells are 0."""
    return df.groupBy(rows).pivot(cols, list(values)).agg(F.count(F.lit(1))).fillna(0)


def global_value(df: DataFrame, expr: Column) -> Column:
    """A one-row aggregate as a scalar subquery."""
    return df.agg(expr.alias("v")).scalar()


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
