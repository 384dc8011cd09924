"""Joins: right-hand clashes are dropped before the join, null keys never match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_keep_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join; right columns whose names clash with the left side are discarded."""
    clash = [c for c in right.columns if c in left.columns and c != key]
    return left.join(right.drop(*clash), key, "left")


def left_join_renamed(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on differently named keys; the right key is dropped."""
    return left.join(right, left[left_key] == right[right_key], "left").drop(right[right_key])


def span_of_control(df: DataFrame, key: str, manager: str, name: str = "n_reports") -> DataFrame:
    """Number of rows per manager, put on every row of the manager's reports."""
    spans = df.filter(F.col(manager).isNotNull()).groupBy(manager).agg(F.count(key).alias(name))
    return df.join(spans, manager, "left")


def both_ends_in(edges: DataFrame, ids: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """Edges whose two endpoints are both known ids."""
    known = ids.select(key).distinct()
    return edges.join(
        known.withColumnRenamed(key, src), src, "left_semi"
    ).join(known.withColumnRenamed(key, dst), dst, "left_semi")


def pair_attributes(
    pairs: DataFrame, nodes: DataFrame, src: str, dst: str, key: str, columns: Sequence[str]
) -> DataFrame:
    """Attach node attributes to both ends: ``<column>_src`` and ``<column>_dst``."""
    out = pairs
    for end, suffix in ((src, "src"), (dst, "dst")):
        side = nodes.select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{suffix}") for c in columns])
        out = out.join(side, end, "left")
    return out


def join_blocks(blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Put feature blocks side by side by id (never by row position)."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, key)
    return out
