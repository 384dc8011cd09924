"""Column expressions with the null rules of the panel workload."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- predicates -------------------------------------------------------------------------

def not_in_keep_null(c: ColumnOrName, values: Sequence) -> Column:
    """Non-membership where a null counts as a non-member (SQL's NOT IN drops it)."""
    return ~F.coalesce(col(c).isin(*values), F.lit(False))


def ne_keep_null(c: ColumnOrName, value) -> Column:
    """``!=`` that keeps nulls."""
    return ~col(c).eqNullSafe(F.lit(value))


def asof(c: ColumnOrName, cut, inclusive: bool = True) -> Column:
    """Rows up to ``cut``; ``cut=None`` means no cut."""
    if cut is None:
        return F.lit(True)
    bound = cut if isinstance(cut, Column) else F.lit(cut).cast("date")
    return col(c) <= bound if inclusive else col(c) < bound


# --- conditional columns ----------------------------------------------------------------

def either(cond: Column, a: ColumnOrName, b: ColumnOrName) -> Column:
    """``a`` where ``cond`` holds, else ``b``; an unknown condition takes ``b``."""
    return F.when(cond, col(a)).otherwise(col(b))


def known_flag(c: ColumnOrName) -> Column:
    """1 where the value is known, else 0."""
    return col(c).isNotNull().cast("int")


def range_case(c: ColumnOrName, ranges: Sequence[tuple], default: Column) -> Column:
    """First ``(lo, hi, value)`` with ``lo <= c <= hi``; no match gives ``default``."""
    out = None
    for lo, hi, value in ranges:
        hit = (col(c) >= F.lit(lo)) & (col(c) <= F.lit(hi))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return default if out is None else out.otherwise(default)


def clamp_low(c: ColumnOrName, lo: Column) -> Column:
    """Clamp from below; null stays null."""
    return F.when(col(c) < lo, lo).otherwise(col(c))


def recode(c: ColumnOrName, mapping: Mapping) -> Column:
    """Dictionary recode; an unmapped value becomes null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[col(c)]


def above(c: ColumnOrName, threshold: float) -> Column:
    """1 where strictly above the threshold."""
    return (col(c) > F.lit(threshold)).cast("int")


def same_flag(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 where equal, null equal to null."""
    return col(a).eqNullSafe(col(b)).cast("int")


def bin_right_closed(c: ColumnOrName, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins, lowest edge included; outside or null gives null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    out = F.when(col(c) < F.lit(edges[0]), F.lit(None))
    for hi, label in zip(edges[1:], labels):
        out = out.when(col(c) <= F.lit(hi), F.lit(label))
    return out


# --- text -------------------------------------------------------------------------------

def captures_joined(c: ColumnOrName, pattern: str, group: int = 1) -> Column:
    """All captures of a pattern, concatenated; null text gives ''."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), group)
    return F.array_join(found, "")


def label_by_patterns(c: ColumnOrName, patterns: Sequence[str]) -> Column:
    """The last pattern that matches anywhere in the text; none gives ''."""
    out = F.when(col(c).rlike(patterns[-1]), F.lit(patterns[-1]))
    for p in reversed(patterns[:-1]):
        out = out.when(col(c).rlike(p), F.lit(p))
    return out.otherwise(F.lit(""))


def replace_text(c: ColumnOrName, old: str, new: str = "") -> Column:
    return F.replace(col(c), F.lit(old), F.lit(new))


def strip_digits_dots(c: ColumnOrName) -> Column:
    return replace_text(F.regexp_replace(col(c), r"\d+", ""), ".")


def currency_to_double(c: ColumnOrName) -> Column:
    return replace_text(c, "$").cast("double")


def bag_of_words(cols: Sequence[ColumnOrName]) -> Column:
    """Row-wise text; a null becomes the token ``nan``."""
    return F.concat_ws(" ", *[F.coalesce(col(c).cast("string"), F.lit("nan")) for c in cols])


def tokens(c: ColumnOrName) -> Column:
    """Lower-cased runs of two or more word characters, any script."""
    runs = F.split(F.lower(col(c)), r"[^\p{L}\p{N}_]+")
    return F.filter(runs, lambda t: F.char_length(t) >= 2)


def has_token(c: ColumnOrName) -> Column:
    return col(c).rlike(r"[\p{L}\p{N}_]{2}")


# --- dates ------------------------------------------------------------------------------

def gap_days(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Absolute whole days between two dates."""
    return F.abs(F.datediff(col(a), col(b)))


def month_index(c: ColumnOrName) -> Column:
    """Months since year 0: a monotone, coarse segment of a date."""
    return F.year(col(c)) * F.lit(12) + F.month(col(c))


# --- ordering ---------------------------------------------------------------------------

def hash_order(key: ColumnOrName, seed: int) -> Column:
    """Seeded pseudo-random order key, the same in every engine that has md5."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))

