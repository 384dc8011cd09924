"""Projection, filling and auditing of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.functions.scalars import ne_keep_null, replace_text


def prune_columns(df: DataFrame, *groups: Sequence[str]) -> DataFrame:
    """Drop every column named in any group; unknown names are ignored, order is kept."""
    return df.drop(*{c for g in groups for c in g})


def drop_columns_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if pattern in c])


def rename_by_position(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    return df.withColumnsRenamed({df.columns[i]: n for i, n in names.items()})


def drop_sentinels(df: DataFrame, sentinels: Mapping[str, Sequence]) -> DataFrame:
    """Drop rows equal to a sentinel in its column; nulls stay."""
    for c, values in sentinels.items():
        for v in values:
            df = df.filter(ne_keep_null(c, v))
    return df


def _of_type(df: DataFrame, *kinds) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.NumericType)


def fill_all_zero(df: DataFrame) -> DataFrame:
    """Every remaining null becomes 0, in text columns the text '0'."""
    return df.fillna(0).fillna("0")


def strip_spaces(df: DataFrame) -> DataFrame:
    """Remove all spaces in every text column."""
    return df.withColumns({c: replace_text(c, " ") for c in text_columns(df)})


def null_audit(df: DataFrame) -> DataFrame:
    """(column, nulls) of the columns that hold any null; one pass."""
    cols = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return (
        counts.unpivot([], cols, "column_name", "nulls").filter(F.col("nulls") > 0)
    )


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("long")
    )


def unpivot(df: DataFrame, ids: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long; null cells are dropped."""
    cols = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), cols, name, value).filter(F.col(value).isNotNull())
