"""Per-entity history: transitions, history text, checkpoints, bounded history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.scalars import gap_days
from panelworks.operators.position import with_position


def level_transitions(
    df: DataFrame, key: str, order: Sequence[str], value: Column, segment: Column
) -> DataFrame:
    """Rises and falls between consecutive known values: (key, rises, falls).

    Two stages: inside each (key, segment), then across the segments' first and last values, so
    a hot key is spread over its segments.
    """
    known = df.select(key, *order, value.alias("_v"), segment.alias("_seg")).filter(
        F.col("_v").isNotNull() & F.col(key).isNotNull()
    )
    here = Window.partitionBy(key, "_seg").orderBy(*order)
    at = F.struct(*order)
    per_segment = (
        known.withColumn("_p", F.lag("_v").over(here))
        .groupBy(key, "_seg")
        .agg(
            F.count_if(F.col("_v") > F.col("_p")).alias("_up"),
            F.count_if(F.col("_v") < F.col("_p")).alias("_down"),
            F.min_by("_v", at).alias("_first"),
            F.max_by("_v", at).alias("_last"),
        )
    )
    across = Window.partitionBy(key).orderBy("_seg")
    return (
        per_segment.withColumn("_p", F.lag("_last").over(across))
        .groupBy(key)
        .agg(
            F.sum(F.col("_up") + F.coalesce((F.col("_first") > F.col("_p")).cast("long"), F.lit(0))).alias("rises"),
            F.sum(F.col("_down") + F.coalesce((F.col("_first") < F.col("_p")).cast("long"), F.lit(0))).alias("falls"),
        )
    )


def history_string(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    value: str,
    segment: Column,
    part_rows: int = 1000,
) -> DataFrame:
    """Comma-joined history of an entity: (key, part, history).

    Each part joins at most ``part_rows`` values, so one row never grows with the entity; the
    parts in order are the whole history. Null values are joined as ``nan``.
    """
    placed = with_position(df.filter(F.col(key).isNotNull()), order, segment, [key], "_pos")
    item = F.struct("_pos", F.coalesce(F.col(value).cast("string"), F.lit("nan")).alias("v"))
    return (
        placed.withColumn("part", F.floor((F.col("_pos") - 1) / part_rows).cast("long"))
        .groupBy(key, "part")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select(key, "part", F.array_join(F.transform("_items", lambda x: x["v"]), ",").alias("history"))
    )


def nearest_snapshot(
    df: DataFrame, key: str, snap: str, checkpoint: str, tolerance: int
) -> DataFrame:
    """Rows of an entity nearest to its checkpoint, ties kept, at most ``tolerance`` days away."""
    w = Window.partitionBy(key).orderBy("gap")
    return (
        df.withColumn("gap", gap_days(checkpoint, snap))
        .withColumn("_r", F.rank().over(w))
        .filter((F.col("_r") == 1) & (F.col("gap") <= tolerance))
        .drop("_r")
    )


def history_until(df: DataFrame, cutoffs: DataFrame, key: str, date: str, cutoff: str) -> DataFrame:
    """All rows of an entity up to its own cutoff date; entities without a cutoff drop out."""
    c = cutoffs.select(F.col(key).alias("_k"), F.col(cutoff))
    return df.join(c, (df[key] == F.col("_k")) & (df[date] <= F.col(cutoff))).drop("_k")


def multi_hot(
    df: DataFrame, key: str, attributes: dict[str, Sequence]
) -> DataFrame:
    """Presence flags ``<column>_<value>`` per key; several attributes in one pass."""
    flags = [
        F.max((F.col(c) == F.lit(v)).cast("int")).alias(f"{c}_{v}")
        for c, values in attributes.items()
        for v in values
    ]
    return df.groupBy(key).agg(*flags).fillna(0)
