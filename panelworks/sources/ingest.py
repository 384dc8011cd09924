"""Batch ingest: monthly files to one panel table, the exit report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.functions.scalars import ne_keep_null
from panelworks.sources.files import read_stacked, write_csv


def ingest_headcount(
    spark: SparkSession, groups: Mapping[str, T.StructType], worker: str, worker_types: Sequence[str],
    category: str, wanted: str, out: str,
) -> str:
    """Stack files by column name, keep some worker types of one category, write CSV."""
    stacked = read_stacked(spark, groups)
    kept = stacked.filter(F.col(worker).isin(*worker_types) & (F.col(category) == wanted))
    return write_csv(kept, out)


def ingest_exits(exits: DataFrame, kind: str, category: str, wanted: str, exit_date: str) -> DataFrame:
    """Exit report: a kind that is not blank, one category, with month and year of the exit."""
    kept = exits.filter(ne_keep_null(kind, "") & (F.col(category) == wanted))
    return kept.withColumns({"term_month": F.month(exit_date), "term_year": F.year(exit_date)})
