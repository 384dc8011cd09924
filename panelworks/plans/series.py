"""Monthly features from daily series: row shifts, currency clean-up, monthly means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.functions.scalars import currency_to_double, month_index
from panelworks.operators.aggregate import mean_by
from panelworks.operators.position import shift_rows


def _calendar(df: DataFrame, day: str) -> DataFrame:
    return df.withColumns({"yr": F.year(day), "mon": F.month(day)})


def ticker_monthly(
    series: DataFrame, day: str, prices: Sequence[str], text_prices: Sequence[str], shift: int, base_shift: int = 30,
    digits: int | None = None,
) -> DataFrame:
    """Monthly means of each price ``base_shift`` rows back and ``shift`` rows back.

    Rows are months of the calendar; ``<price>`` holds the base shift, ``<price>_shifted`` the other.
    """
    clean = series.withColumns({c: currency_to_double(c) for c in text_prices})
    names = [*prices, *text_prices]
    columns = {f"_b_{c}": c for c in names} | {f"_s_{c}": c for c in names}
    shifts = {f"_b_{c}": base_shift for c in names} | {f"_s_{c}": shift for c in names}
    moved = shift_rows(clean.select(day, *names), day, month_index(day), columns, shifts)
    means = {c: f"_b_{c}" for c in names} | {f"{c}_shifted": f"_s_{c}" for c in names}
    return mean_by(_calendar(moved, day), ["yr", "mon"], means, digits)


def macro_monthly(
    series: DataFrame, day: str, columns: Sequence[str], shift: int = 0, digits: int | None = None
) -> DataFrame:
    """Monthly means of the shifted columns, ``<column>_shifted``; shift 0 keeps the rows in place."""
    if shift == 0:
        moved = series.select(day, *[F.col(c).alias(f"{c}_shifted") for c in columns])
    else:
        names = {f"{c}_shifted": c for c in columns}
        moved = shift_rows(series.select(day, *columns), day, month_index(day), names, dict.fromkeys(names, shift))
    means = {f"{c}_shifted": f"{c}_shifted" for c in columns}
    return mean_by(_calendar(moved, day), ["yr", "mon"], means, digits)
