"""Rules that remove entities with incomplete or contradictory records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.functions.scalars import not_in_keep_null
from panelworks.operators.aggregate import global_value


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def drop_stale_actives(
    df: DataFrame, key: str, date: str, label: str, grace_days: int = 0
) -> DataFrame:
    """Drop active ids whose latest report is older than the newest one of all actives."""
    active = df.filter(F.col(label) == 0)
    newest = global_value(active, F.max(date))
    stale = active.filter(F.col(date) < F.date_sub(newest, grace_days)).select(key).distinct()
    return drop_ids(df, stale, key)


def drop_inconsistent_exits(
    df: DataFrame, key: str, date: str, exit_date: str, max_days: int = 62
) -> DataFrame:
    """Drop ids whose exit lies before, or more than ``max_days`` after, a report."""
    days = F.datediff(exit_date, date)
    bad = df.filter((days < 0) | (days > max_days)).select(key).distinct()
    return drop_ids(df, bad, key)


def keep_exit_reasons(
    df: DataFrame, reason: str, excluded: Sequence[str], active: str = "Active"
) -> DataFrame:
    """Drop the excluded reasons; rows without a reason count as active."""
    return df.filter(not_in_keep_null(reason, excluded)).fillna({reason: active})
