"""Blocked self-joins whose blocks may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def split_blocks(df: DataFrame, keys: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Left and right side of a self-join on ``keys``; join on ``[*keys, "_i", "_j"]``.

    A block of n rows becomes s x s cells with s = ceil(n / BLOCK_ROWS): the left row goes to all
    cells of its row stripe, the right row to all cells of its column stripe. Every pair of the
    block meets in exactly one cell, and no cell outgrows the stripes. Single rows are left out.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    sized = df.join(sizes, list(keys)).withColumn("_cells", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int"))
    stripe = F.pmod(F.xxhash64(key), F.col("_cells")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))
    left = sized.withColumn("_i", stripe).select("*", others.alias("_j"))
    right = sized.withColumn("_j", stripe).select("*", others.alias("_i"))
    return left.drop("_n", "_cells"), right.drop("_n", "_cells")
