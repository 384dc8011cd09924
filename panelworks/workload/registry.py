"""Query registry: a Spark callable and, where expressible, the same question in plain SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.workload.views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Dates leave the queries as ISO text, so any client compares them alike."""
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df


def query(name: str, sql: str | None = None, views: str = "", dates: str = "") -> Callable[[QueryFn], QueryFn]:
    """Register a query. ``views`` names the CTEs the SQL needs, ``dates`` its date columns."""

    def add(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        text = None
        if sql is not None:
            text = with_views(views.split(), sql)
            if dates:
                casts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates.split())
                text = f"SELECT * REPLACE ({casts}) FROM ({text}) AS q"
            text = re.sub(r"[ \t]*\n\s*", "\n", text).strip()
        REGISTRY[name] = Query(name, lambda spark, sf: _dates_as_text(fn(spark, sf)), text)
        return fn

    return add
