"""Queries: sources, projections, joins, aggregates, sorts and unions."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelworks.functions import scalars as S
from panelworks.operators import aggregate as A
from panelworks.operators import history as H
from panelworks.operators import joins as J
from panelworks.operators import position as P
from panelworks.operators import quality as Q
from panelworks.operators import select as SEL
from panelworks.session import fresh_path
from panelworks.sources import files
from panelworks.workload import views as V
from panelworks.workload.registry import query
from panelworks.workload.views import table

# --- sources and sinks ------------------------------------------------------------------


@query("csv_roundtrip", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_roundtrip(spark, sf):
    df = table(spark, sf, "customer")
    path = files.write_csv(df, fresh_path(spark, "csv"))
    return files.read_csv(spark, path, df.schema)


@query("csv_latin1", "select doc_id, concat('é', lang) as lang from documents")
def csv_latin1(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("é"), "lang").alias("lang"))
    path = files.write_csv(df, fresh_path(spark, "latin1"), "ISO-8859-1")
    return files.read_csv(spark, path, df.schema, "ISO-8859-1")


@query("union_files_by_name", """
  select s_suppkey as id, s_name as name, s_acctbal as balance, cast(null as varchar) as segment from supplier
  union all select c_custkey, c_name, null, c_mktsegment from customer""")
def union_files_by_name(spark, sf):
    a = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    groups = {files.write_csv(d, fresh_path(spark, "stack")): d.schema for d in (a, b)}
    return files.read_stacked(spark, groups)


@query("partitioned_scan", """
  select entity_id, type, round(score, 6) as score, yr from scores where yr = 2001""", "scores")
def partitioned_scan(spark, sf):
    df = V.scores(spark, sf).select("entity_id", "type", F.round("score", 6).alias("score"), "yr")
    path = files.write_partitioned(df, fresh_path(spark, "scores"), ["yr"])
    return files.read_partitioned(spark, path, df.schema).filter(F.col("yr") == 2001)


# --- projections and predicates ---------------------------------------------------------


@query("project_columns", "select entity_id, level, unit from panel", "panel")
def project_columns(spark, sf):
    return V.panel(spark, sf).select("entity_id", "level", "unit")


@query("drop_columns", "select entity_id, row_key, level, function, band, unit from panel", "panel")
def drop_columns(spark, sf):
    return V.panel(spark, sf).drop("snap_date", "manager_id", "amount", "balance")


@query("prune_columns", "select entity_id, row_key, level, unit, amount from panel", "panel")
def prune_columns(spark, sf):
    return SEL.prune_columns(
        V.panel(spark, sf), ["snap_date", "manager_id", "no_such_column"], ["function", "band"], ["balance"])


@query("drop_columns_like", "select o_orderstatus, o_totalprice from orders")
def drop_columns_like(spark, sf):
    df = table(spark, sf, "orders")
    for pattern in ("key", "date", "priority"):
        df = SEL.drop_columns_like(df, pattern)
    return df


@query("rename_columns", "select n_nationkey as id, n_name as name, n_regionkey as region from nation")
def rename_columns(spark, sf):
    df = table(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "id", "n_name": "name"})
    return SEL.rename_by_position(df, {2: "region"})


@query("asof_cut_inclusive", "select row_key, snap_date from panel where snap_date <= date '1998-06-01'",
       "panel", "snap_date")
def asof_cut_inclusive(spark, sf):
    return V.panel(spark, sf).filter(S.asof("snap_date", "1998-06-01")).select("row_key", "snap_date")


@query("asof_cut_strict", "select row_key, snap_date from panel where snap_date < date '1998-06-01'",
       "panel", "snap_date")
def asof_cut_strict(spark, sf):
    return V.panel(spark, sf).filter(S.asof("snap_date", "1998-06-01", inclusive=False)).select(
        "row_key", "snap_date")


@query("filter_in", "select row_key, unit from panel where unit in ('BUILDING', 'MACHINERY')", "panel")
def filter_in(spark, sf):
    return V.panel(spark, sf).filter(F.col("unit").isin("BUILDING", "MACHINERY")).select("row_key", "unit")


@query("filter_not_in_keep_null", """
  select id, unit from gaps where unit is null or unit not in ('BUILDING', 'MACHINERY')""", "gaps")
def filter_not_in_keep_null(spark, sf):
    return V.gaps(spark, sf).filter(S.not_in_keep_null("unit", ["BUILDING", "MACHINERY"])).select("id", "unit")


@query("filter_conjunction", """
  select row_key, unit, function from panel where unit in ('BUILDING', 'HOUSEHOLD') and function = 'O'""", "panel")
def filter_conjunction(spark, sf):
    keep = F.col("unit").isin("BUILDING", "HOUSEHOLD") & (F.col("function") == "O")
    return V.panel(spark, sf).filter(keep).select("row_key", "unit", "function")


@query("filter_ne_keep_null", "select id, place from gaps where place is distinct from 'N7'", "gaps")
def filter_ne_keep_null(spark, sf):
    return V.gaps(spark, sf).filter(S.ne_keep_null("place", "N7")).select("id", "place")


@query("drop_null_rows", """
  select id, unit, x, place from gaps where unit is not null and x is not null and place is not null""", "gaps")
def drop_null_rows(spark, sf):
    return V.gaps(spark, sf).dropna("any")


@query("drop_sentinels", """
  select id, unit, place from gaps where coalesce(unit, '') <> 'FURNITURE'
    and coalesce(place, '') not in ('N0', 'N1')""", "gaps")
def drop_sentinels(spark, sf):
    return SEL.drop_sentinels(
        V.gaps(spark, sf).drop("x"), {"unit": ["FURNITURE"], "place": ["N0", "N1"]})


@query("conditional_column", """
  select id, case when x > 5000 then 'high' else 'other' end as grade from gaps""", "gaps")
def conditional_column(spark, sf):
    return V.gaps(spark, sf).select(
        "id", S.either(F.col("x") > 5000, F.lit("high"), F.lit("other")).alias("grade"))


@query("coalesce_columns", "select id, coalesce(place, unit) as spot from gaps", "gaps")
def coalesce_columns(spark, sf):
    return V.gaps(spark, sf).select("id", F.coalesce("place", "unit").alias("spot"))


@query("label_from_exit", """
  select p.row_key, case when e.term_date is null then 0 else 1 end as churn
  from panel p left join exits e on p.entity_id = e.entity_id""", "panel exits")
def label_from_exit(spark, sf):
    joined = J.left_join_keep_left(V.panel(spark, sf), V.exits(spark, sf), "entity_id")
    return joined.select("row_key", S.known_flag("term_date").alias("churn"))


@query("fill_constant", """
  select id, coalesce(unit, 'Active') as unit, coalesce(x, 0) as x, coalesce(place, 'Other') as place
  from gaps""", "gaps")
def fill_constant(spark, sf):
    return V.gaps(spark, sf).fillna({"unit": "Active", "x": 0.0, "place": "Other"})


@query("fill_all_zero", """
  select id, coalesce(unit, '0') as unit, coalesce(x, 0) as x, coalesce(place, '0') as place from gaps""", "gaps")
def fill_all_zero(spark, sf):
    return SEL.fill_all_zero(V.gaps(spark, sf))


@query("assign_checkpoint", """
  select e.entity_id, e.term_date, coalesce(c.checkpoint, date '2001-07-01') as checkpoint
  from exits e left join checkpoints c on e.term_date between c.lo and c.hi""",
       "exits checkpoints", "term_date checkpoint")
def assign_checkpoint(spark, sf):
    default = F.lit(V.DEFAULT_CHECKPOINT).cast("date")
    return V.exits(spark, sf).select(
        "entity_id", "term_date",
        S.range_case("term_date", V.checkpoint_ranges(), default).alias("checkpoint"))


@query("clamp_date", """
  select row_key, case when snap_date < date '1996-01-01' then date '1996-01-01' else snap_date end as eff
  from panel""", "panel", "eff")
def clamp_date(spark, sf):
    lo = F.lit(dt.date(1996, 1, 1))
    return V.panel(spark, sf).select("row_key", S.clamp_low("snap_date", lo).alias("eff"))


@query("recode_values", """
  select id, case unit when 'BUILDING' then 'G1' when 'MACHINERY' then 'G2' when 'HOUSEHOLD' then 'G3' end as g
  from gaps""", "gaps")
def recode_values(spark, sf):
    return V.gaps(spark, sf).select(
        "id", S.recode("unit", {"BUILDING": "G1", "MACHINERY": "G2", "HOUSEHOLD": "G3"}).alias("g"))


@query("threshold_class", "select id, p, case when p > 0.5 then 1 else 0 end as cls from preds", "preds")
def threshold_class(spark, sf):
    return V.preds(spark, sf).select("id", "p", S.above("p", 0.5).alias("cls"))


@query("null_audit", """
  select 'unit' as column_name, count(*) as nulls from gaps where unit is null having count(*) > 0
  union all select 'x', count(*) from gaps where x is null having count(*) > 0
  union all select 'place', count(*) from gaps where place is null having count(*) > 0
  union all select 'id', count(*) from gaps where id is null having count(*) > 0""", "gaps")
def null_audit(spark, sf):
    return SEL.null_audit(V.gaps(spark, sf))


@query("filter_label", "select id, p from preds where y = 1", "preds")
def filter_label(spark, sf):
    return V.preds(spark, sf).filter(F.col("y") == 1).select("id", "p")


# --- joins ------------------------------------------------------------------------------


@query("left_join_exits", """
  select p.row_key, p.entity_id, p.unit, e.term_date, e.reason
  from panel p left join exits e on p.entity_id = e.entity_id""", "panel exits", "term_date")
def left_join_exits(spark, sf):
    p = V.panel(spark, sf).select("row_key", "entity_id", "unit")
    e = V.exits(spark, sf).withColumn("unit", F.lit("discarded"))
    return J.left_join_keep_left(p, e, "entity_id")


@query("left_join_renamed_key", """
  select c.c_custkey, n.n_name from customer c left join nation n on c.c_nationkey = n.n_nationkey""")
def left_join_renamed_key(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return J.left_join_renamed(
        table(spark, sf, "customer"), n, "c_nationkey", "n_nationkey").select("c_custkey", "n_name")


@query("span_of_control", """
  select g.id, g.unit, s.n_reports from gaps g
  left join (select unit, count(id) as n_reports from gaps where unit is not null group by unit) s
  on g.unit = s.unit""", "gaps")
def span_of_control(spark, sf):
    return J.span_of_control(V.gaps(spark, sf), "id", "unit").select("id", "unit", "n_reports")


_MONTHLY_SQL = """
  select cast(year(day) as int) as yr, cast(month(day) as int) as mon, cast(sum(cast(v as decimal(28,2))) as double) / count(v) as v_mean
  from series group by year(day), month(day)"""


def _monthly(spark, sf):
    s = V.series(spark, sf).withColumns({"yr": F.year("day"), "mon": F.month("day")})
    return A.mean_by(s, ["yr", "mon"], {"v_mean": "v"}, digits=2)


@query("calendar_join", f"""
  with m as ({_MONTHLY_SQL})
  select p.row_key, m.v_mean from panel p
  left join m on m.yr = year(p.snap_date) and m.mon = month(p.snap_date)""", "panel series")
def calendar_join(spark, sf):
    p = V.panel(spark, sf).select("row_key", F.year("snap_date").alias("yr"), F.month("snap_date").alias("mon"))
    return p.join(_monthly(spark, sf), ["yr", "mon"], "left").select("row_key", "v_mean")


@query("series_with_shift", """
  select day, v, lag(v, 30) over (order by day) as v_30 from series""", "series", "day")
def series_with_shift(spark, sf):
    s = V.series(spark, sf).select("day", "v")
    return P.shift_rows(s, "day", S.month_index("day"), {"v_30": "v"}, {"v_30": 30})


@query("edges_semi_both", """
  with e as (select distinct o_custkey as src, l_suppkey as dst from orders join lineitem on o_orderkey = l_orderkey),
  k as (select c_custkey as id from customer where c_acctbal > 0)
  select src, dst from e where src in (select id from k) and dst in (select id from k)""")
def edges_semi_both(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    e = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(
        F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    ids = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return J.both_ends_in(e, ids, "src", "dst", "id")


@query("anti_join_ids", """
  select row_key, entity_id from panel where entity_id not in (select entity_id from exits)""", "panel exits")
def anti_join_ids(spark, sf):
    return Q.drop_ids(V.panel(spark, sf).select("row_key", "entity_id"), V.exits(spark, sf), "entity_id")


# exits on the panel with their checkpoint; used by the next queries
def labelled_panel(spark, sf):
    default = F.lit(V.DEFAULT_CHECKPOINT).cast("date")
    return J.left_join_keep_left(V.panel(spark, sf), V.exits(spark, sf), "entity_id").withColumn(
        "checkpoint", S.range_case("term_date", V.checkpoint_ranges(), default))


NEAREST_SQL = """
  with j as (
    select p.*, e.term_date, e.reason, coalesce(c.checkpoint, date '2001-07-01') as checkpoint
    from panel p left join exits e on p.entity_id = e.entity_id
    left join checkpoints c on e.term_date between c.lo and c.hi),
  g as (select *, abs(date_diff('day', checkpoint, snap_date)) as gap from j),
  nearest as (select * from (
    select *, min(gap) over (partition by entity_id) as m from g) x where gap = m and gap <= 31)"""


@query("nearest_snapshot", NEAREST_SQL + """
  select entity_id, row_key, snap_date, checkpoint, cast(gap as int) as gap from nearest""",
       "panel exits checkpoints", "snap_date checkpoint")
def nearest_snapshot(spark, sf):
    near = H.nearest_snapshot(labelled_panel(spark, sf), "entity_id", "snap_date", "checkpoint", 31)
    return near.select("entity_id", "row_key", "snap_date", "checkpoint", "gap")


@query("history_until_cutoff", """
  select p.row_key, p.entity_id, p.snap_date from panel p join exits e
  on p.entity_id = e.entity_id and p.snap_date <= e.term_date - interval '30' day""", "panel exits", "snap_date")
def history_until_cutoff(spark, sf):
    cut = V.exits(spark, sf).select("entity_id", F.date_sub("term_date", 30).alias("cutoff"))
    p = V.panel(spark, sf).select("row_key", "entity_id", "snap_date")
    return H.history_until(p, cut, "entity_id", "snap_date", "cutoff").drop("cutoff")


@query("join_feature_blocks", """
  select c.c_custkey as id, c.c_acctbal, count(o_orderkey) as n_orders, max(o_orderkey) as last_order
  from customer c join orders o on o.o_custkey = c.c_custkey group by c.c_custkey, c.c_acctbal""")
def join_feature_blocks(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("o_orderkey").alias("n_orders"), F.max("o_orderkey").alias("last_order"))
    return J.join_blocks([c, o], "id")


@query("aggregate_lookup", """
  select p.row_key, n.n_levels from panel p
  join (select entity_id, count(distinct level) as n_levels from panel group by entity_id) n
  on p.entity_id = n.entity_id""", "panel")
def aggregate_lookup(spark, sf):
    p = V.panel(spark, sf).select("row_key", "entity_id", "level")
    return A.lookup_aggregate(p, "entity_id", F.count_distinct("level"), "n_levels").select("row_key", "n_levels")


# --- aggregations -----------------------------------------------------------------------


@query("distinct_rows", "select distinct o_orderstatus, o_orderpriority, o_custkey from orders")
def distinct_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey").distinct()


@query("conflicting_ids", """
  select distinct entity_id from (
    select entity_id, snap_date from panel group by entity_id, snap_date having count(function) > 1) x""", "panel")
def conflicting_ids(spark, sf):
    return A.conflicting_ids(V.panel(spark, sf), "entity_id", "snap_date", "function")


HISTORY_COUNTS = {"n_level": "level", "n_function": "function", "n_band": "band", "n_unit": "unit",
                  "n_manager": "manager_id"}


@query("history_counts", """
  select entity_id, count(distinct level) as n_level, count(distinct function) as n_function,
    count(distinct band) as n_band, count(distinct unit) as n_unit, count(distinct manager_id) as n_manager
  from panel group by entity_id""", "panel")
def history_counts(spark, sf):
    return A.distinct_counts(V.panel(spark, sf), "entity_id", HISTORY_COUNTS)


@query("monthly_mean", _MONTHLY_SQL, "series")
def monthly_mean(spark, sf):
    return _monthly(spark, sf)


@query("value_counts", "select unit, count(*) as n from gaps where unit is not null group by unit", "gaps")
def value_counts(spark, sf):
    return A.value_counts(V.gaps(spark, sf), "unit")


@query("history_string", """
  select entity_id, (rn - 1) // 1000 as part, string_agg(level, ',' order by rn) as history
  from (select entity_id, level, row_number() over (partition by entity_id order by snap_date, row_key) as rn
        from panel) x
  group by entity_id, (rn - 1) // 1000""", "panel")
def history_string(spark, sf):
    p = V.panel(spark, sf)
    return H.history_string(p, "entity_id", ["snap_date", "row_key"], "level", S.month_index("snap_date"))


@query("crosstab", """
  select unit, count(*) filter (where function = 'F') as "F", count(*) filter (where function = 'O') as "O",
    count(*) filter (where function = 'P') as "P" from panel group by unit""", "panel")
def crosstab(spark, sf):
    return A.crosstab(V.panel(spark, sf), "unit", "function", ["F", "O", "P"])


@query("quantiles", """
  select 0.25 :: double as prob, round(quantile_cont(x, 0.25), 6) as value from gaps
  union all select 0.5, round(quantile_cont(x, 0.5), 6) from gaps
  union all select 0.75, round(quantile_cont(x, 0.75), 6) from gaps""", "gaps")
def quantiles(spark, sf):
    q = A.exact_quantiles(V.gaps(spark, sf), "x", [0.25, 0.5, 0.75])
    return q.select("prob", F.round("value", 6).alias("value"))


@query("class_share", "select count(*) as n, round(avg(y), 6) as share from preds", "preds")
def class_share(spark, sf):
    return V.preds(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("share"))


@query("table_shape", "select count(*) as n_rows, cast(10 as bigint) as n_columns from panel", "panel")
def table_shape(spark, sf):
    return SEL.table_shape(V.panel(spark, sf))


# --- windows ----------------------------------------------------------------------------


@query("latest_snapshot", """
  select entity_id, snap_date, row_key, level, function from (
    select *, row_number() over (partition by entity_id order by snap_date desc, row_key desc) as rn from panel) x
  where rn = 1""", "panel", "snap_date")
def latest_snapshot(spark, sf):
    p = V.panel(spark, sf).select("entity_id", "snap_date", "row_key", "level", "function")
    return A.latest_per_key(p, ["entity_id"], [F.desc("snap_date"), F.desc("row_key")])


@query("keep_last_null_wins", """
  select unit, id, place from (
    select *, row_number() over (partition by unit order by place desc nulls first, id desc) as rn from gaps) x
  where rn = 1""", "gaps")
def keep_last_null_wins(spark, sf):
    return A.latest_per_key(V.gaps(spark, sf), ["unit"], [F.desc_nulls_first("place"), F.desc("id")]).select(
        "unit", "id", "place")


@query("keep_last_by_key", """
  select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey""")
def keep_last_by_key(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return A.latest_per_key(o, ["o_custkey"], [F.desc("o_orderkey")])


@query("shift_rows_back", "select day, lag(v, 7) over (order by day) as v_shifted from series", "series", "day")
def shift_rows_back(spark, sf):
    s = V.series(spark, sf).select("day", "v")
    return P.shift_rows(s, "day", S.month_index("day"), {"v_shifted": "v"}, {"v_shifted": 7}).drop("v")


@query("shift_rows_forward", "select day, lead(v, 7) over (order by day) as v_shifted from series", "series", "day")
def shift_rows_forward(spark, sf):
    s = V.series(spark, sf).select("day", "v")
    return P.shift_rows(s, "day", S.month_index("day"), {"v_shifted": "v"}, {"v_shifted": -7}).drop("v")


@query("level_transitions", """
  with d as (select entity_id, cast(replace(level, 'L', '') as int) as v,
      lag(cast(replace(level, 'L', '') as int)) over (partition by entity_id order by snap_date, row_key) as p
    from panel)
  select entity_id, count(*) filter (where v > p) as rises, count(*) filter (where v < p) as falls
  from d group by entity_id""", "panel")
def level_transitions(spark, sf):
    return H.level_transitions(
        V.panel(spark, sf), "entity_id", ["snap_date", "row_key"], V.level_number(), S.month_index("snap_date"))


# --- sort, limit, sampling --------------------------------------------------------------


@query("order_by", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey")
def order_by(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("top_n", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5")
def top_n(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey").limit(5)


@query("seeded_shuffle_rank", """
  select o_orderkey, row_number() over (order by md5(concat(cast(o_orderkey as varchar), ':7')), o_orderkey) as rank
  from orders""")
def seeded_shuffle_rank(spark, sf):
    return P.with_hash_rank(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("sample_n", """
  select entity_id from (select distinct entity_id from panel
    where entity_id not in (select entity_id from exits)) a
  order by md5(concat(cast(entity_id as varchar), ':9003')), entity_id limit 250""", "panel exits")
def sample_n(spark, sf):
    actives = Q.drop_ids(V.panel(spark, sf).select("entity_id").distinct(), V.exits(spark, sf), "entity_id")
    return actives.orderBy(S.hash_order("entity_id", 9003), "entity_id").limit(250)


# --- unions -----------------------------------------------------------------------------


def _five_lists(spark, sf):
    c = table(spark, sf, "customer")
    parts = [
        c.filter(F.col("c_acctbal") > 5000), c.filter(F.col("c_mktsegment") == "BUILDING"),
        c.filter(F.col("c_mktsegment") == "MACHINERY"), c.filter(F.col("c_nationkey") < 5),
        c.filter(F.col("c_acctbal") < 0)]
    return [p.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("rating")) for p in parts]


@query("union_distinct", """
  select c_custkey as id, c_mktsegment as rating from customer where c_acctbal > 5000 or c_acctbal < 0
    or c_nationkey < 5 or c_mktsegment in ('BUILDING', 'MACHINERY')""")
def union_distinct(spark, sf):
    return reduce(lambda a, b: a.unionByName(b), _five_lists(spark, sf)).distinct()


@query("union_lookups", """
  select distinct id, distance from (
    select s_suppkey as id, s_acctbal as distance from supplier where s_nationkey < 12
    union all select s_suppkey, s_acctbal from supplier where s_nationkey >= 12
    union all select c_custkey, c_acctbal from customer where c_nationkey < 12
    union all select c_custkey, c_acctbal from customer where c_nationkey >= 12) x""")
def union_lookups(spark, sf):
    parts = []
    for name, p in (("supplier", "s_suppkey s_acctbal s_nationkey"), ("customer", "c_custkey c_acctbal c_nationkey")):
        k, d, n = p.split()
        df = table(spark, sf, name)
        for part in (df.filter(F.col(n) < 12), df.filter(F.col(n) >= 12)):
            parts.append(part.select(F.col(k).alias("id"), F.col(d).alias("distance")))
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()
