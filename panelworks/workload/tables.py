"""Queries: series, lookups, ingest and the table-level frames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelworks.functions import scalars as S
from panelworks.operators import aggregate as A
from panelworks.operators import features as FE
from panelworks.operators import history as H
from panelworks.operators import joins as J
from panelworks.operators import quality as Q
from panelworks.operators import select as SEL
from panelworks.plans import frames, lookups
from panelworks.plans import series as PS
from panelworks.session import fresh_path
from panelworks.sources import files, ingest
from panelworks.workload import views as V
from panelworks.workload.features import FUNCTIONS, LEVELS
from panelworks.workload.registry import query
from panelworks.workload.relational import HISTORY_COUNTS
from panelworks.workload.views import table

YEARS = (2000, 2001)

# --- series -----------------------------------------------------------------------------


@query("ticker_monthly", """
  with m as (select year(day) as yr, month(day) as mon, lag(v, 30) over w as v, lag(v, 365) over w as vs,
      lag(cast(replace(px, '$', '') as double), 30) over w as px,
      lag(cast(replace(px, '$', '') as double), 365) over w as pxs
    from series window w as (order by day))
  select cast(yr as int) as yr, cast(mon as int) as mon, cast(sum(cast(v as decimal(28,2))) as double) / count(v) as v,
    cast(sum(cast(vs as decimal(28,2))) as double) / count(vs) as v_shifted,
    cast(sum(cast(px as decimal(28,2))) as double) / count(px) as px,
    cast(sum(cast(pxs as decimal(28,2))) as double) / count(pxs) as px_shifted from m group by yr, mon""", "series")
def ticker_monthly(spark, sf):
    return PS.ticker_monthly(V.series(spark, sf), "day", ["v"], ["px"], 365, digits=2)


@query("macro_monthly", """
  with m as (select year(day) as yr, month(day) as mon, lag(v, 100) over (order by day) as v from series)
  select cast(yr as int) as yr, cast(mon as int) as mon, cast(sum(cast(v as decimal(28,2))) as double) / count(v) as v_shifted from m group by yr, mon""",
       "series")
def macro_monthly(spark, sf):
    return PS.macro_monthly(V.series(spark, sf), "day", ["v"], 100, digits=2)


# --- lookups ----------------------------------------------------------------------------

_SCORES_SQL = """
  sw as (select entity_id, max(score) filter (where yr = 2000 and type = 'Self') as self_2000,
      max(score) filter (where yr = 2000 and type = 'Team') as team_2000,
      max(score) filter (where yr = 2001 and type = 'Self') as self_2001,
      max(score) filter (where yr = 2001 and type = 'Team') as team_2001 from scores group by entity_id),
  sc as (select *, coalesce(self_2000, team_2000) as combined_2000, coalesce(self_2001, team_2001) as combined_2001
    from sw)"""


def _scores(spark, sf):
    return lookups.score_assembly(V.scores(spark, sf), "entity_id", "yr", "type", "score", YEARS)


@query("score_assembly", f"""
  with {_SCORES_SQL.strip()}
  select s.entity_id, round(self_2000, 6) as self_2000, round(team_2000, 6) as team_2000,
    round(self_2001, 6) as self_2001, round(team_2001, 6) as team_2001,
    round(case when year(e.term_date) = 2000 then combined_2000 else combined_2001 end, 6) as recent
  from sc s left join exits e on s.entity_id = e.entity_id""", "scores exits")
def score_assembly(spark, sf):
    s = J.left_join_keep_left(_scores(spark, sf), V.exits(spark, sf), "entity_id")
    cols = ["self_2000", "team_2000", "self_2001", "team_2001"]
    recent = lookups.by_exit_year("term_date", YEARS, "combined")
    return s.select("entity_id", *[F.round(c, 6).alias(c) for c in cols], F.round(recent, 6).alias("recent"))


def _rating_lists(spark, sf):
    w = V.ratings_wide(spark, sf)
    cols = {2000: "r_2000", 2001: "r_2001"}
    either = lambda *v: {"r_2000": v, "r_2001": v}

    def dept(name, **kw):
        return lookups.WideRatings(w.filter(F.col("dept") == name), "entity_id", cols, **kw)

    return [
        dept("BUILDING", drop_rows=either("late", "0")),
        dept("MACHINERY", drop_cells={"r_2000": ["split"]}),
        dept("FURNITURE", drop_rows=either("early", "open"),
             fixes={"r_2000": [("k2", "K2"), ("k3", "K3")]}),
        dept("HOUSEHOLD"),
    ]


def _ratings(spark, sf, year):
    later = year == 2001
    return lookups.ratings_of_year(
        V.ratings_main(spark, sf), _rating_lists(spark, sf), "entity_id", "yr", "rating", year,
        excluded_ids=[3, 5, 8, 13] if later else [], known_only=later,
    ).withColumnRenamed("rating", f"rating_{year}")


_RATINGS_SQL = """
  rw as (select * from ratings_wide where r_2000 is not null and r_2001 is not null),
  ra as (select distinct entity_id, rating as rating_2000 from (
      select entity_id, rating from ratings_main where yr = 2000 and rating is distinct from 'joined'
      union all select entity_id, r_2000 from rw where dept = 'BUILDING'
        and r_2000 not in ('late', '0') and r_2001 not in ('late', '0')
      union all select entity_id, r_2000 from rw where dept = 'MACHINERY' and r_2000 <> 'split'
      union all select entity_id, replace(replace(r_2000, 'k2', 'K2'), 'k3', 'K3') from rw where dept = 'FURNITURE'
        and r_2000 not in ('early', 'open')
        and r_2001 not in ('early', 'open')
      union all select entity_id, r_2000 from rw where dept = 'HOUSEHOLD') x),
  rb as (select distinct entity_id, rating as rating_2001 from (
      select entity_id, rating from ratings_main where yr = 2001 and rating <> 'joined'
        and entity_id not in (3, 5, 8, 13)
      union all select entity_id, r_2001 from rw where dept = 'BUILDING'
        and r_2000 not in ('late', '0') and r_2001 not in ('late', '0')
      union all select entity_id, r_2001 from rw where dept = 'MACHINERY'
      union all select entity_id, r_2001 from rw where dept = 'FURNITURE'
        and r_2000 not in ('early', 'open')
        and r_2001 not in ('early', 'open')
      union all select entity_id, r_2001 from rw where dept = 'HOUSEHOLD') x)"""


@query("rating_assembly", f"""
  with {_RATINGS_SQL.strip()}
  select k.c_custkey as entity_id, ra.rating_2000, rb.rating_2001,
    case when year(e.term_date) = 2000 then ra.rating_2000 else rb.rating_2001 end as recent
  from customer k left join exits e on e.entity_id = k.c_custkey left join ra on ra.entity_id = k.c_custkey
  left join rb on rb.entity_id = k.c_custkey""", "ratings_main ratings_wide exits")
def rating_assembly(spark, sf):
    k = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    df = J.left_join_keep_left(k, V.exits(spark, sf), "entity_id")
    for y in YEARS:
        df = df.join(_ratings(spark, sf, y), "entity_id", "left")
    return df.select("entity_id", "rating_2000", "rating_2001",
                     lookups.by_exit_year("term_date", YEARS, "rating").alias("recent"))


# --- ingest -----------------------------------------------------------------------------


@query("headcount_ingest", """
  select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders
  where o_orderstatus in ('F', 'O') and o_orderpriority = '1-URGENT' and o_orderdate >= timestamp '1998-01-01'""")
def headcount_ingest(spark, sf):
    o = table(spark, sf, "orders")
    old = o.filter(F.col("o_orderdate") < "1998-01-01").drop("o_orderdate", "o_orderpriority")
    new = o.filter(F.col("o_orderdate") >= "1998-01-01").drop("o_orderdate")
    groups = {files.write_csv(d, fresh_path(spark, "month")): d.schema for d in (old, new)}
    out = ingest.ingest_headcount(
        spark, groups, "o_orderstatus", ["F", "O"], "o_orderpriority", "1-URGENT", fresh_path(spark, "headcount"))
    # the stacked column order is that of the first group, then the added columns
    schema = old.schema.add(new.schema["o_orderpriority"])
    return files.read_csv(spark, out, schema)


@query("exits_ingest", """
  select entity_id, term_date, reason, cast(month(term_date) as int) as term_month,
    cast(year(term_date) as int) as term_year
  from exits where reason <> '' and split_part(reason, ' > ', 2) = 'Voluntary'""", "exits", "term_date")
def exits_ingest(spark, sf):
    e = V.exits(spark, sf).withColumn("category", F.split_part("reason", F.lit(" > "), F.lit(2)))
    return ingest.ingest_exits(e, "reason", "category", "Voluntary", "term_date").drop("category")


# --- quality rules ----------------------------------------------------------------------

_LATEST_SQL = """
  latest as (select * from (select *, row_number() over (partition by entity_id
      order by snap_date desc, row_key desc) as rn from panel) x where rn = 1),
  f as (select l.entity_id, l.snap_date, e.term_date, case when e.term_date is null then 0 else 1 end as churn
    from latest l left join exits e on l.entity_id = e.entity_id)"""


def _latest_with_exits(spark, sf):
    p = V.panel(spark, sf).select("entity_id", "snap_date", "row_key")
    latest = A.latest_per_key(p, ["entity_id"], [F.desc("snap_date"), F.desc("row_key")])
    joined = J.left_join_keep_left(latest, V.exits(spark, sf), "entity_id")
    return joined.select("entity_id", "snap_date", "term_date", S.known_flag("term_date").alias("churn"))


@query("drop_stale_actives", f"""
  with {_LATEST_SQL.strip()}
  select entity_id, snap_date, term_date, churn from f
  where churn = 1 or snap_date >= (select max(snap_date) from f where churn = 0) - interval '365' day""",
       "panel exits", "snap_date term_date")
def drop_stale_actives(spark, sf):
    return Q.drop_stale_actives(_latest_with_exits(spark, sf), "entity_id", "snap_date", "churn", 365)


@query("drop_inconsistent_exits", f"""
  with {_LATEST_SQL.strip()}
  select entity_id, snap_date, term_date, churn from f
  where term_date is null or date_diff('day', snap_date, term_date) between 0 and 62""",
       "panel exits", "snap_date term_date")
def drop_inconsistent_exits(spark, sf):
    return Q.drop_inconsistent_exits(_latest_with_exits(spark, sf), "entity_id", "snap_date", "term_date")


@query("exit_reason_filter", """
  select p.row_key, coalesce(array_to_string(regexp_extract_all(e.reason, '> (.*?) >', 1), ''), 'Active') as term_reason
  from panel p left join exits e on p.entity_id = e.entity_id
  where e.reason is null or array_to_string(regexp_extract_all(e.reason, '> (.*?) >', 1), '') not in
    ('Retirement', 'Severance Reasons', 'Death in Service', 'Did Not Start')""", "panel exits")
def exit_reason_filter(spark, sf):
    e = V.exits(spark, sf).select(
        "entity_id", S.captures_joined("reason", frames.REASON_PATTERN).alias("term_reason"))
    j = J.left_join_keep_left(V.panel(spark, sf), e, "entity_id")
    return Q.keep_exit_reasons(j, "term_reason", frames.EXCLUDED_REASONS).select("row_key", "term_reason")


# --- frames -----------------------------------------------------------------------------


def spec():
    return frames.PanelSpec(
        level_number=V.level_number(), counts=HISTORY_COUNTS,
        keep=["level", "function", "band", "unit", "manager_id"])


_CLEAN_SQL = """
  bad as (select distinct entity_id from (select entity_id, snap_date from {src}
    group by entity_id, snap_date having count(function) > 1) x),
  hist as (select * from {src} where entity_id not in (select entity_id from bad))"""

_FEATS_SQL = """
  cnt as (select entity_id, count(distinct level) as n_level, count(distinct function) as n_function,
      count(distinct band) as n_band, count(distinct unit) as n_unit, count(distinct manager_id) as n_manager
    from {h} group by entity_id),
  mv as (select entity_id, count(*) filter (where v > p) as downward_levels, count(*) filter (where v < p) as upward_levels
    from (select entity_id, cast(replace(level, 'L', '') as int) as v,
        lag(cast(replace(level, 'L', '') as int)) over (partition by entity_id order by snap_date, row_key) as p
      from {h}) d group by entity_id)"""

_REASON = "array_to_string(regexp_extract_all(e.reason, '> (.*?) >', 1), '')"
_REASON_OK = f"(e.reason is null or {_REASON} not in ('Retirement', 'Severance Reasons', 'Death in Service', 'Did Not Start'))"

_CAL_SQL = """
  cal as (select year(day) as yr, month(day) as mon, cast(sum(cast(v as decimal(28,2))) as double) / count(v) as cal_v
    from series group by year(day), month(day))"""

ENTITY_SQL = f"""
  with cut as (select * from panel where snap_date <= date '2001-06-30'),
  {_CLEAN_SQL.format(src='cut').strip()},
  {_FEATS_SQL.format(h='hist').strip()},
  latest as (select * from (select *, row_number() over (partition by entity_id order by snap_date desc, row_key desc) as rn
    from hist) x where rn = 1),
  fx as (select l.entity_id, l.snap_date, l.level, l.function, l.band, l.unit, l.manager_id, e.term_date,
      coalesce({_REASON}, 'Active') as term_reason, case when e.term_date is null then 0 else 1 end as churn
    from latest l left join exits e on l.entity_id = e.entity_id where {_REASON_OK}),
  fs as (select * from fx where churn = 1
    or snap_date >= (select max(snap_date) from fx where churn = 0) - interval '365' day),
  fk as (select * from fs where term_date is null or date_diff('day', snap_date, term_date) between 0 and 62),
  sp as (select manager_id, count(entity_id) as n_reports from fk group by manager_id),
  {_SCORES_SQL.strip()},
  {_RATINGS_SQL.strip()},
  {_CAL_SQL.strip()},
  wide as (select fk.*, cnt.n_level, cnt.n_function, cnt.n_band, cnt.n_unit, cnt.n_manager, mv.downward_levels,
      mv.upward_levels, sp.n_reports,
      case when year(fk.term_date) = 2000 then sc.combined_2000 else sc.combined_2001 end as recent_score,
      case when year(fk.term_date) = 2000 then ra.rating_2000 else rb.rating_2001 end as recent_rating,
      d.distance, n.n_name, cal.cal_v,
      row_number() over (partition by fk.entity_id order by rb.rating_2001 desc nulls first,
        ra.rating_2000 desc nulls first, d.distance desc nulls first) as pick
    from fk join cnt on cnt.entity_id = fk.entity_id join mv on mv.entity_id = fk.entity_id
    left join sp on sp.manager_id = fk.manager_id left join sc on sc.entity_id = fk.entity_id
    left join ra on ra.entity_id = fk.entity_id left join rb on rb.entity_id = fk.entity_id
    left join distances d on d.entity_id = fk.entity_id left join nation n on n.n_nationkey = fk.manager_id
    left join cal on cal.yr = year(greatest(fk.snap_date, date '1996-01-01'))
      and cal.mon = month(greatest(fk.snap_date, date '1996-01-01'))),
  entity as (select entity_id, snap_date, level, function, band, unit, manager_id, term_date, term_reason, churn,
    n_level, n_function, n_band, n_unit, n_manager, downward_levels, upward_levels, n_reports,
    round(recent_score, 6) as recent_score, recent_rating, distance, n_name, cal_v
    from wide where pick = 1)"""
ENTITY_VIEWS = "panel exits scores ratings_main ratings_wide distances series"

ENTITY_COLUMNS = [
    "entity_id", "snap_date", "level", "function", "band", "unit", "manager_id", "term_date", "term_reason",
    "churn", "n_level", "n_function", "n_band", "n_unit", "n_manager", "downward_levels", "upward_levels",
    "n_reports", "recent_score", "recent_rating", "distance", "n_name", "cal_v"]


def _lookups(spark, sf):
    """Scores, ratings and distances by entity; ratings and distances may repeat an entity."""
    found = [_scores(spark, sf).select("entity_id", "combined_2000", "combined_2001")]
    return found + [_ratings(spark, sf, y) for y in YEARS] + [V.distances(spark, sf)]


def _lookup_ties():
    return [F.desc_nulls_first(c) for c in ("rating_2001", "rating_2000", "distance")]


def _with_place_and_calendar(spark, sf, frame):
    """The manager's nation, and the calendar values of the clamped month of the row."""
    frame = J.left_join_renamed(
        frame, table(spark, sf, "nation").select("n_nationkey", "n_name"), "manager_id", "n_nationkey")
    cal = PS.macro_monthly(V.series(spark, sf), "day", ["v"], digits=2).withColumnRenamed("v_shifted", "cal_v")
    return frames.with_calendar(frame, cal, "snap_date", dt.date(1996, 1, 1))


def _with_recent(frame):
    """Score and rating of the year of the exit."""
    return frame.withColumns({
        "recent_score": lookups.by_exit_year("term_date", YEARS, "combined"),
        "recent_rating": lookups.by_exit_year("term_date", YEARS, "rating")})


def entity_table(spark, sf, snap_date="2001-06-30"):
    """The flagship: entity frame with scores, ratings, distances, names and calendar values."""
    frame = frames.entity_frame(
        V.panel(spark, sf), V.exits(spark, sf), spec(), snap_date, grace_days=365, lookups=_lookups(spark, sf))
    one = A.latest_per_key(_with_recent(_with_place_and_calendar(spark, sf, frame)), ["entity_id"], _lookup_ties())
    return one.withColumn("recent_score", F.round("recent_score", 6)).select(*ENTITY_COLUMNS)


@query("entity_frame", ENTITY_SQL + " select * from entity", ENTITY_VIEWS, "snap_date term_date")
def entity_frame(spark, sf):
    return entity_table(spark, sf)


CHECKPOINT_SQL = f"""
  with {_CLEAN_SQL.format(src='panel').strip()},
  je as (select p.*, e.term_date, coalesce({_REASON}, 'Active') as term_reason,
      case when e.term_date is null then 0 else 1 end as churn, coalesce(c.checkpoint, date '2001-07-01') as checkpoint
    from hist p left join exits e on p.entity_id = e.entity_id
    left join checkpoints c on e.term_date between c.lo and c.hi where {_REASON_OK}),
  jv as (select * from je where term_reason <> 'Involuntary'),
  ng as (select *, abs(date_diff('day', checkpoint, snap_date)) as gap,
      min(abs(date_diff('day', checkpoint, snap_date))) over (partition by entity_id) as mg from jv),
  near as (select * from ng where gap = mg and gap <= 31),
  hcut as (select h.* from hist h join (select entity_id, max(snap_date) as c from near group by entity_id) m
    on h.entity_id = m.entity_id and h.snap_date <= m.c),
  {_FEATS_SQL.format(h='hcut').strip()},
  sp as (select manager_id, count(entity_id) as n_reports from near group by manager_id),
  {_SCORES_SQL.strip()},
  {_RATINGS_SQL.strip()},
  {_CAL_SQL.strip()},
  cw as (select near.entity_id, near.snap_date, near.level, near.function, near.band, near.unit, near.manager_id,
      near.term_date, near.term_reason, near.churn, near.checkpoint, cnt.n_level, cnt.n_function, cnt.n_band,
      cnt.n_unit, cnt.n_manager, mv.downward_levels, mv.upward_levels, sp.n_reports,
      case when year(near.term_date) = 2000 then sc.combined_2000 else sc.combined_2001 end as recent_score,
      case when year(near.term_date) = 2000 then ra.rating_2000 else rb.rating_2001 end as recent_rating,
      d.distance, n.n_name, cal.cal_v,
      row_number() over (partition by near.entity_id order by near.snap_date desc, near.row_key desc,
        rb.rating_2001 desc nulls first, ra.rating_2000 desc nulls first, d.distance desc nulls first) as rn
    from near join cnt on cnt.entity_id = near.entity_id join mv on mv.entity_id = near.entity_id
    left join sp on sp.manager_id = near.manager_id left join sc on sc.entity_id = near.entity_id
    left join ra on ra.entity_id = near.entity_id left join rb on rb.entity_id = near.entity_id
    left join distances d on d.entity_id = near.entity_id left join nation n on n.n_nationkey = near.manager_id
    left join cal on cal.yr = year(greatest(near.snap_date, date '1996-01-01'))
      and cal.mon = month(greatest(near.snap_date, date '1996-01-01'))),
  cf as (select entity_id, snap_date, level, function, band, unit, manager_id, term_date, term_reason, churn, checkpoint,
      n_level, n_function, n_band, n_unit, n_manager, downward_levels, upward_levels, n_reports,
      cast(date_diff('day', checkpoint, term_date) as int) as days_to_exit, recent_score, recent_rating, distance,
      n_name, cal_v
    from cw where rn = 1)"""
CHECKPOINT_VIEWS = "panel exits checkpoints scores ratings_main ratings_wide distances series"


def checkpoint_table(spark, sf, hist=None):
    """Entities at their checkpoints with scores, ratings, distances, names and calendar values."""
    default = F.lit(V.DEFAULT_CHECKPOINT).cast("date")
    one = frames.checkpoint_frame(
        V.panel(spark, sf), V.exits(spark, sf), spec(), V.checkpoint_ranges(), default,
        lookups=_lookups(spark, sf), hist=hist, ties=_lookup_ties())
    # one row per entity now, so the small tables are joined to the fewest rows
    return _with_recent(_with_place_and_calendar(spark, sf, one)).drop(
        "combined_2000", "combined_2001", "rating_2000", "rating_2001", "row_key")


@query("checkpoint_frame", CHECKPOINT_SQL + """
  select * replace (round(recent_score, 6) as recent_score) from cf""",
       CHECKPOINT_VIEWS, "snap_date term_date checkpoint")
def checkpoint_frame(spark, sf):
    return checkpoint_table(spark, sf).withColumn("recent_score", F.round("recent_score", 6))
