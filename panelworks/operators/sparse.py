"""Sparse features: long rows (key, feature, value), a dictionary of features as a table, sparse vectors.

No value list is stated and none passes through the driver: a column of many millions of values only
makes the dictionary longer. A feature is named ``column=value`` for a text, ``column:value`` for a
value found in the history, and ``column`` for a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from panelworks.operators.features import label_encode
from panelworks.session import fresh_path


def _known(df: DataFrame, key: str, items: Sequence[tuple[Column, Column]]) -> DataFrame:
    pairs = F.array(*[F.struct(name.alias("feature"), value.alias("value")) for name, value in items])
    rows = df.filter(F.col(key).isNotNull()).select(key, F.explode(pairs).alias("_e")).select(key, "_e.*")
    return rows.filter(F.col("feature").isNotNull() & F.col("value").isNotNull())


def _named(column: str, mark: str) -> Column:
    return F.concat(F.lit(column + mark), F.col(column).cast("string"))


def row_features(df: DataFrame, key: str, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """(key, feature, value) of a table with one row per key.

    A known text is one feature of value 1. Numbers that are null, NaN or 0 have no row. Rows without
    a key are left out.
    """
    one = F.lit(1.0)
    items = [(_named(c, "="), one) for c in texts]
    for c in numbers:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None))
        items.append((F.lit(c), F.when(x != 0, x)))
    return _known(df, key, items)


def history_features(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, feature, 1.0) for every known value that a key ever had, all columns in one pass.

    Repeats are removed before the shuffle and by (key, feature), so a hot key is spread.
    """
    return _known(df, key, [(_named(c, ":"), F.lit(1.0)) for c in columns]).distinct()


def feature_dictionary(features: DataFrame) -> DataFrame:
    """(feature, code): 0-based codes in alphabetical order, fitted on the rows given."""
    return label_encode(features.select("feature").distinct(), "feature", "code")


def encode(features: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Codes on the long rows; a feature that the dictionary does not know has no row."""
    return features.join(dictionary, "feature")


def sparse_vectors(df: DataFrame, key: str, coded: DataFrame, width: int, name: str = "features") -> DataFrame:
    """The rows of ``df`` with a sparse vector each, written once; without any feature it is empty.

    The vectors are packed as the columns behind Spark's vector type and read back as that type, so no
    Python sees a row. A row holds the features of its own key only.
    """
    items = F.array_sort(F.collect_list(F.struct("code", "value")))
    packed = coded.groupBy(F.col(key).alias("_k")).agg(items.alias("_f"))
    codes = F.coalesce(F.col("_f.code"), F.array().cast("array<int>"))
    values = F.coalesce(F.col("_f.value"), F.array().cast("array<double>"))
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(width).cast("int").alias("size"),
        codes.alias("indices"), values.alias("values"))
    out = df.join(packed, df[key] == F.col("_k"), "left").select(*df.columns, parts.alias(name))
    path = fresh_path(df.sparkSession, "vectors")
    out.write.parquet(path)
    schema = StructType([*df.schema.fields, StructField(name, VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)
