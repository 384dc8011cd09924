"""Feature shaping: grouping, encoding, imputing, scaling, power transform."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.functions.scalars import col
from panelworks.operators.aggregate import exact_medians, global_value, modes
from panelworks.operators.position import range_segments, with_position


def group_rare(df: DataFrame, column: str, out: str, max_count: int = 10, other: str = "Other") -> DataFrame:
    """Values seen at most ``max_count`` times become ``other``; null stays null.

    Only the frequent values are joined back: there are at most rows / max_count of them.
    """
    frequent = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > max_count)
    )
    joined = df.join(frequent, df[column] == F.col("_v"), "left")
    value = F.when(F.col("_n").isNotNull() | F.col(column).isNull(), F.col(column)).otherwise(F.lit(other))
    return joined.withColumn(out, value).drop("_v", "_n")


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """0-based code of each known value in alphabetical order.

    Codes come from a distributed position over the distinct values, so a column of many
    millions of values never passes through the driver.
    """
    values = df.select(F.col(column).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    dealt = range_segments(values, "_v")
    codes = with_position(dealt, ["_v"], F.col("_range"), name="_code").drop("_range")
    return (
        df.join(codes, df[column] == F.col("_v"), "left")
        .withColumn(out, (F.col("_code") - 1).cast("int"))
        .drop("_v", "_code")
    )


def one_hot(df: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    """Columns with stated values become 0/1 columns ``<column>_<value>``; null and others give all zeros."""
    kept = [c for c in df.columns if c not in values]
    hot = [
        F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, vs in values.items()
        for v in vs
    ]
    return df.select(*kept, *hot)


def one_hot_long(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, code, flag): the form for columns of unknown width, a row per known value."""
    coded = label_encode(df.select(key, column), column, "code").filter(F.col("code").isNotNull())
    return coded.select(key, "code", F.lit(1).alias("flag"))


def minmax_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Scale to [0, 1] (within ``by``); a constant column becomes 0."""
    bounds = [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{c}") for c in columns]
    if by:
        out = df.join(df.groupBy(*by).agg(*bounds), list(by))
    else:
        out = df.withColumn("_b", global_value(df, F.struct(*bounds)))
    scaled = {}
    for c in columns:
        b = F.col(f"_{c}") if by else F.col(f"_b._{c}")
        span = b["hi"] - b["lo"]
        scaled[c] = F.when(F.col(c).isNull(), F.lit(None)).when(
            span == 0, F.lit(0.0)).otherwise((F.col(c) - b["lo"]) / span)
    return out.withColumns(scaled).select(*df.columns)


# --- imputing ---------------------------------------------------------------------------


def impute_median(df: DataFrame, column: str) -> DataFrame:
    m = exact_medians(df, column).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), m))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), modes(df, column).scalar()))


def _impute_group(df: DataFrame, column: str, by: str, stats: DataFrame) -> DataFrame:
    s = stats.select(F.col(by).alias("_g"), F.col(stats.columns[-1]).alias("_s"))
    return (
        df.join(s, df[by] == F.col("_g"), "left")
        .withColumn(column, F.coalesce(F.col(column), F.col("_s")))
        .drop("_g", "_s")
        .select(*df.columns)
    )


def impute_group_median(df: DataFrame, column: str, by: str) -> DataFrame:
    return _impute_group(df, column, by, exact_medians(df.filter(F.col(by).isNotNull()), column, [by]))


def impute_group_mode(df: DataFrame, column: str, by: str) -> DataFrame:
    return _impute_group(df, column, by, modes(df.filter(F.col(by).isNotNull()), column, [by]))


def impute_two_level(df: DataFrame, column: str, by: str, kind: str) -> DataFrame:
    """Group fill first, then the global statistic of the filled column for what is left."""
    if kind == "median":
        return impute_median(impute_group_median(df, column, by), column)
    if kind == "mode":
        return impute_mode(impute_group_mode(df, column, by), column)
    raise ValueError(kind)


# --- Yeo-Johnson ------------------------------------------------------------------------


def yeo_johnson(c: Column | str, lam: float) -> Column:
    x = col(c).cast("double")
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_fit(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Maximum-likelihood exponent per column: three passes, each over a finer grid.

    One pass is one aggregation of all columns and grid points; only the sums reach the driver.
    """
    grids = {c: [-2 + 0.5 * i for i in range(13)] for c in columns}
    best: dict[str, float] = {}
    for step in (0.5, 0.05, 0.005):
        aggs = []
        for c in columns:
            x = F.col(c).cast("double")
            aggs.append(F.count(x).alias(f"{c}|n"))
            aggs.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"{c}|s"))
            aggs += [F.var_pop(yeo_johnson(c, g)).alias(f"{c}|{i}") for i, g in enumerate(grids[c])]
        row = df.agg(*aggs).first().asDict()
        for c in columns:
            n, s = row[f"{c}|n"], row[f"{c}|s"]
            scored = [
                (-n / 2 * math.log(v) + (g - 1) * s, g)
                for i, g in enumerate(grids[c])
                if (v := row[f"{c}|{i}"]) is not None and v > 0
            ]
            best[c] = max(scored)[1] if scored else 1.0
            grids[c] = [round(best[c] + step / 10 * k, 6) for k in range(-10, 11)]
    return best


def power_transform(df: DataFrame, lambdas: Mapping[str, float]) -> DataFrame:
    """Apply fitted exponents, then zero mean and unit population variance; constant gives 0."""
    moved = df.withColumns({c: yeo_johnson(c, lam) for c, lam in lambdas.items()})
    stats = global_value(moved, F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in lambdas
    ]))
    out = moved.withColumn("_st", stats)
    scaled = {
        c: F.when(F.col(c).isNull(), F.lit(None))
        .when(F.col(f"_st.{c}.s") < 1e-12, F.lit(0.0))
        .otherwise((F.col(c) - F.col(f"_st.{c}.m")) / F.col(f"_st.{c}.s"))
        for c in lambdas
    }
    return out.withColumns(scaled).drop("_st")
