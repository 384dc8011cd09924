"""Entity frames: one row per entity as of a date, or at its checkpoint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.functions.scalars import (
    asof,
    captures_joined,
    clamp_low,
    known_flag,
    month_index,
    ne_keep_null,
    range_case,
)
from panelworks.operators import aggregate as A
from panelworks.operators import history as H
from panelworks.operators import joins as J
from panelworks.operators import quality as Q
from panelworks.session import materialize

# The exit reasons the workload leaves out, and the shape of a reason text.
EXCLUDED_REASONS = ["Retirement", "Severance Reasons", "Death in Service", "Did Not Start"]
REASON_PATTERN = "> (.*?) >"


@dataclass(frozen=True)
class PanelSpec:
    """Column names of a panel; ``row_key`` breaks ties of equal dates."""

    key: str = "entity_id"
    date: str = "snap_date"
    row_key: str = "row_key"
    status: str = "function"
    manager: str = "manager_id"
    level_number: Column | None = None
    counts: Mapping[str, str] = field(default_factory=dict)
    keep: Sequence[str] = ()

    @property
    def order(self) -> list[str]:
        return [self.date, self.row_key]

    @property
    def newest_first(self) -> list[Column]:
        return [F.desc(self.date), F.desc(self.row_key)]


def clean_panel(panel: DataFrame, spec: PanelSpec, snap_date=None) -> DataFrame:
    """Rows up to the snapshot date, full duplicates and conflicting ids removed; written once.

    The key is not pre-partitioned: distinct spreads a hot entity by its whole rows, and every later
    step on the key aggregates before its shuffle.
    """
    hist = panel.filter(asof(spec.date, snap_date)).distinct()
    bad = A.conflicting_ids(hist, spec.key, spec.date, spec.status)
    return materialize(Q.drop_ids(hist, bad, spec.key), "panel")


def history_features(hist: DataFrame, spec: PanelSpec) -> DataFrame:
    """Distinct counts and level moves per entity. A rising level number is a move down."""
    moves = H.level_transitions(hist, spec.key, spec.order, spec.level_number, month_index(spec.date))
    moves = moves.select(
        spec.key, F.col("rises").alias("downward_levels"), F.col("falls").alias("upward_levels"))
    return A.distinct_counts(hist, spec.key, spec.counts).join(moves, spec.key, "left")


def with_exits(df: DataFrame, exits: DataFrame, key: str, reason: str, exit_date: str) -> DataFrame:
    """Exit columns, the label, the cleaned reason; excluded reasons removed, no reason = active."""
    e = exits.withColumn("term_reason", captures_joined(reason, REASON_PATTERN)).drop(reason)
    joined = J.left_join_keep_left(df, e, key).withColumn("churn", known_flag(exit_date))
    return Q.keep_exit_reasons(joined, "term_reason", EXCLUDED_REASONS)


def with_calendar(df: DataFrame, calendar: DataFrame, date: str, earliest) -> DataFrame:
    """Monthly calendar values for the (clamped) month of a date; ``calendar`` has yr and mon."""
    eff = clamp_low(date, F.lit(earliest))
    return (
        df.withColumns({"yr": F.year(eff), "mon": F.month(eff)})
        .join(calendar, ["yr", "mon"], "left")
        .drop("yr", "mon")
    )


def entity_frame(
    panel: DataFrame,
    exits: DataFrame,
    spec: PanelSpec,
    snap_date=None,
    grace_days: int = 0,
    max_exit_days: int = 62,
    exit_date: str = "term_date",
    reason: str = "reason",
    lookups: Sequence[DataFrame] = (),
) -> DataFrame:
    """One row per entity as of ``snap_date``: latest attributes, history, exit, span, lookups."""
    hist = clean_panel(panel, spec, snap_date)
    latest = A.latest_per_key(
        hist.select(spec.key, *spec.order, *spec.keep), [spec.key], spec.newest_first)
    frame = latest.join(history_features(hist, spec), spec.key, "left")
    frame = materialize(with_exits(frame, exits, spec.key, reason, exit_date), "entities")
    frame = Q.drop_stale_actives(frame, spec.key, spec.date, "churn", grace_days)
    frame = Q.drop_inconsistent_exits(frame, spec.key, spec.date, exit_date, max_exit_days)
    frame = J.span_of_control(frame, spec.key, spec.manager)
    for lk in lookups:
        frame = frame.join(lk, spec.key, "left")
    return frame


def checkpoint_rows(
    hist: DataFrame, exits: DataFrame, spec: PanelSpec, ranges: Sequence[tuple], default: Column,
    tolerance: int = 31, exit_date: str = "term_date", reason: str = "reason",
) -> DataFrame:
    """Clean panel rows nearest to each entity's checkpoint; involuntary exits are left out."""
    rows = with_exits(hist, exits, spec.key, reason, exit_date)
    rows = rows.filter(ne_keep_null("term_reason", "Involuntary"))
    rows = rows.withColumn("checkpoint", range_case(exit_date, ranges, default))
    return H.nearest_snapshot(rows, spec.key, spec.date, "checkpoint", tolerance)


def history_at(hist: DataFrame, rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Clean panel rows of each entity up to its latest kept row."""
    cut = rows.groupBy(spec.key).agg(F.max(spec.date).alias("_cutoff"))
    return H.history_until(hist, cut, spec.key, spec.date, "_cutoff").drop("_cutoff")


def checkpoint_frame(
    panel: DataFrame, exits: DataFrame, spec: PanelSpec, ranges: Sequence[tuple], default: Column,
    tolerance: int = 31, exit_date: str = "term_date", reason: str = "reason",
    lookups: Sequence[DataFrame] = (), hist: DataFrame | None = None, ties: Sequence[Column] = (),
) -> DataFrame:
    """One row per entity at its checkpoint, with history up to it and days until exit.

    ``hist`` is the clean panel where the caller has it already. Lookups may repeat an entity;
    ``ties`` orders such rows, of which the first stays.
    """
    hist = clean_panel(panel, spec) if hist is None else hist
    rows = materialize(
        checkpoint_rows(hist, exits, spec, ranges, default, tolerance, exit_date, reason), "checkpoints")
    feats = history_features(history_at(hist, rows, spec), spec)
    frame = rows.select(
        spec.key, *spec.order, *spec.keep, exit_date, "term_reason", "churn", "checkpoint")
    frame = J.span_of_control(frame.join(feats, spec.key, "left"), spec.key, spec.manager)
    for lk in lookups:
        frame = frame.join(lk, spec.key, "left")
    one = A.latest_per_key(frame, [spec.key], [*spec.newest_first, *ties])
    return one.withColumn("days_to_exit", F.datediff(exit_date, "checkpoint"))
