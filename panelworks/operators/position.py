"""Global and per-group row positions without a one-task sort.

A coarse, monotone *segment* of the sort key splits every group. Segment sizes are counted with
partial aggregation, their running total gives each segment's offset, and rows are numbered
inside their segment only. No task sorts a whole group, however hot the group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.scalars import hash_order
from panelworks.session import materialize

SEGMENT_ROWS = 50_000


def _running_offsets(counts: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    """Rows before each segment. ``counts`` holds one row per segment, not per input row."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = w.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum(n).over(before), F.lit(0)))


def with_position(
    df: DataFrame,
    order: Sequence[Column | str],
    segment: Column,
    by: Sequence[str] = (),
    name: str = "pos",
) -> DataFrame:
    """Add the 1-based position of each row within ``by``; ``segment`` must rise with ``order``."""
    seg = df.withColumn("_seg", segment)
    keys = [*by, "_seg"]
    offsets = _running_offsets(
        seg.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), by, "_n"
    ).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_before")
    here = Window.partitionBy(*keys).orderBy(*order)
    numbered = seg.withColumn("_rn", F.row_number().over(here))
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (
        numbered.join(offsets, cond)
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .select(*df.columns, name)
    )


def range_segments(keys: DataFrame, *order: str, name: str = "_range") -> DataFrame:
    """Distinct sort keys of any type with a balanced, rising segment number.

    Spark samples the ranges; writing the result freezes them for every later reader. With several
    keys the number rises within each value of the first ones, so a hot group is cut as well.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id())
    return materialize(dealt, "ranges")


def with_hash_rank(
    df: DataFrame, key: str, seed: int, by: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Position in seeded pseudo-random order; leading hash digits are the segment.

    As many digits as bring a segment down to SEGMENT_ROWS rows on average, whatever the row count.
    """
    digits = hash_digits(df.count())
    keyed = df.withColumn("_h", hash_order(key, seed))
    return with_position(
        keyed, ["_h", key], F.substring("_h", 1, digits), by, name
    ).drop("_h")


def hash_digits(rows: int) -> int:
    """Leading hexadecimal digits that cut ``rows`` into segments of SEGMENT_ROWS at most on average."""
    digits = 1
    while rows > SEGMENT_ROWS * 16**digits:
        digits += 1
    return digits


def shift_rows(
    df: DataFrame,
    order: str,
    segment: Column,
    columns: dict[str, str],
    shifts: dict[str, int],
) -> DataFrame:
    """Row-shifted copies ``{new: source}`` by ``shifts[new]`` rows (> 0 looks back).

    Dates of the series must be unique. The shift is an equi-join on the row position.
    """
    placed = with_position(df, [order], segment, name="_pos")
    out = placed
    for n in sorted(set(shifts.values())):
        mine = [c for c in columns if shifts[c] == n]
        moved = placed.select(
            (F.col("_pos") + F.lit(n)).alias("_pos"), *[F.col(columns[c]).alias(c) for c in mine]
        )
        out = out.join(moved, "_pos", "left")
    return out.drop("_pos")


def running_within_segments(
    df: DataFrame, order: str, by: Sequence[str], weights: Sequence[str]
) -> DataFrame:
    """Running totals of ``weights`` strictly before each row (columns ``<w>_before``).

    ``df`` needs a column ``_seg`` that rises with ``order`` and one row per (by, order) value.
    """
    keys = [*by, "_seg"]
    seg = df.groupBy(*keys).agg(*[F.sum(w).alias(w) for w in weights])
    outer = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_seg")
    outer = outer.rowsBetween(Window.unboundedPreceding, -1)
    offs = seg.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(w).over(outer), F.lit(0)).alias(f"_o_{w}") for w in weights],
    )
    inner = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns(
        {f"_l_{w}": F.coalesce(F.sum(w).over(inner), F.lit(0)) for w in weights}
    )
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return local.join(offs, cond).select(
        *df.columns, *[(F.col(f"_o_{w}") + F.col(f"_l_{w}")).alias(f"{w}_before") for w in weights]
    )
