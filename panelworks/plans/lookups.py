"""Assembly of per-entity lookups: scores by year, ratings from several lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.functions.scalars import either, not_in_keep_null, replace_text
from panelworks.operators.select import drop_sentinels


def by_exit_year(exit_date: str, years: tuple[int, int], prefix: str) -> Column:
    """The first year's value for exits in that year, else the second year's."""
    a, b = years
    return either(F.year(exit_date) == a, f"{prefix}_{a}", f"{prefix}_{b}")


def score_assembly(
    scores: DataFrame, key: str, year: str, kind: str, score: str, years: tuple[int, int],
    first: str = "Self", second: str = "Team",
) -> DataFrame:
    """Wide scores: ``self_<y>``, ``team_<y>`` and ``combined_<y>`` (self before team)."""
    kinds = (first, second)
    wide = scores.groupBy(key).agg(*[
        F.max(F.when((F.col(year) == y) & (F.col(kind) == k), F.col(score))).alias(f"{k.lower()}_{y}")
        for y in years for k in kinds
    ])
    return wide.withColumns({
        f"combined_{y}": F.coalesce(f"{first.lower()}_{y}", f"{second.lower()}_{y}") for y in years
    })


@dataclass(frozen=True)
class WideRatings:
    """A department list: one column per year, its sentinels and code corrections."""

    df: DataFrame
    key: str
    columns: Mapping[int, str]
    drop_rows: Mapping[str, Sequence[str]] = field(default_factory=dict)
    drop_cells: Mapping[str, Sequence[str]] = field(default_factory=dict)
    fixes: Mapping[str, Sequence[tuple[str, str]]] = field(default_factory=dict)

    def of_year(self, year: int, key: str) -> DataFrame:
        df = self.df.select(self.key, *self.columns.values()).dropna("any")
        df = drop_sentinels(df, self.drop_rows)
        c = self.columns[year]
        df = drop_sentinels(df, {c: self.drop_cells.get(c, [])})
        for old, new in self.fixes.get(c, []):
            df = df.withColumn(c, replace_text(c, old, new))
        return df.select(F.col(self.key).alias(key), F.col(c).alias("rating"))


def ratings_of_year(
    main: DataFrame, lists: Sequence[WideRatings], key: str, year_col: str, rating: str, year: int,
    sentinels: Sequence[str] = ("joined",), excluded_ids: Sequence = (), known_only: bool = False,
) -> DataFrame:
    """All ratings of one year, (key, rating), duplicates removed."""
    m = drop_sentinels(main.filter(F.col(year_col) == year), {rating: sentinels})
    if excluded_ids:
        m = m.filter(not_in_keep_null(key, excluded_ids))
    if known_only:
        m = m.dropna("any")
    parts = [m.select(key, F.col(rating).alias("rating")), *[w.of_year(year, key) for w in lists]]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()
