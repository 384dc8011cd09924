"""Queries: scalar functions and feature shaping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelworks.functions import scalars as S
from panelworks.operators import features as FE
from panelworks.operators import history as H
from panelworks.operators import select as SEL
from panelworks.workload import views as V
from panelworks.workload.registry import query
from panelworks.workload.relational import NEAREST_SQL, labelled_panel
from panelworks.workload.views import table

# --- scalar functions -------------------------------------------------------------------


@query("extract_reason", """
  select entity_id, array_to_string(regexp_extract_all(coalesce(reason, ''), '> (.*?) >', 1), '') as term_reason
  from exits""", "exits")
def extract_reason(spark, sf):
    return V.exits(spark, sf).select("entity_id", S.captures_joined("reason", "> (.*?) >").alias("term_reason"))


_NAME_PATTERNS = ["ring", "r.d", "blue", "bolt", "gear$"]


@query("label_by_patterns", """
  select p_partkey, case when regexp_matches(p_name, 'gear$') then 'gear$'
    when regexp_matches(p_name, 'bolt') then 'bolt' when regexp_matches(p_name, 'blue') then 'blue'
    when regexp_matches(p_name, 'r.d') then 'r.d' when regexp_matches(p_name, 'ring') then 'ring'
    else '' end as label from part""")
def label_by_patterns(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.label_by_patterns("p_name", _NAME_PATTERNS).alias("label"))


@query("replace_text", "select row_key, replace(level, 'L', '') as level from panel", "panel")
def replace_text(spark, sf):
    return V.panel(spark, sf).select("row_key", S.replace_text("level", "L").alias("level"))


@query("strip_spaces_all_text", """
  select p_partkey, replace(p_name, ' ', '') as p_name, replace(p_brand, ' ', '') as p_brand,
    replace(p_type, ' ', '') as p_type, p_size, p_retailprice from part""")
def strip_spaces_all_text(spark, sf):
    return SEL.strip_spaces(table(spark, sf, "part"))


@query("strip_digits_dots", """
  select doc_id, replace(regexp_replace(text, '[0-9]+', '', 'g'), '.', '') as text from documents""")
def strip_digits_dots(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.strip_digits_dots("text").alias("text"))


@query("currency_to_double", "select day, cast(replace(px, '$', '') as double) as px from series", "series", "day")
def currency_to_double(spark, sf):
    return V.series(spark, sf).select("day", S.currency_to_double("px").alias("px"))


@query("bag_of_words", """
  select id, concat_ws(' ', coalesce(unit, 'nan'), coalesce(place, 'nan'), cast(id as varchar)) as words
  from gaps""", "gaps")
def bag_of_words(spark, sf):
    return V.gaps(spark, sf).select("id", S.bag_of_words(["unit", "place", "id"]).alias("words"))


@query("calendar_parts", """
  select entity_id, cast(month(term_date) as int) as term_month, cast(year(term_date) as int) as term_year
  from exits""", "exits")
def calendar_parts(spark, sf):
    return V.exits(spark, sf).select(
        "entity_id", F.month("term_date").alias("term_month"), F.year("term_date").alias("term_year"))


@query("days_between", """
  select entity_id, cast(date_diff('day', date '2000-01-01', term_date) as int) as days,
    cast(abs(date_diff('day', date '2000-01-01', term_date)) as int) as gap from exits""", "exits")
def days_between(spark, sf):
    base = F.lit(dt.date(2000, 1, 1))
    return V.exits(spark, sf).select(
        "entity_id", F.datediff("term_date", base).alias("days"), S.gap_days("term_date", base).alias("gap"))


@query("parse_types", """
  select o_orderkey, cast(cast(o_orderdate as date) as varchar) as d_text, cast(o_orderdate as date) as d,
    o_totalprice as amount from orders""", dates="d")
def parse_types(spark, sf):
    text = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d_text"),
        F.col("o_totalprice").cast("string").alias("a_text"))
    return text.select(
        "o_orderkey", "d_text", F.to_date("d_text").alias("d"), F.col("a_text").cast("double").alias("amount"))


# The service-time bins of the workload.
SERVICE_EDGES = [0, 1, 2, 5, 10, 50]
SERVICE_LABELS = ["First year", "1-2 years", "2-5 years", "5-10 years", "10+ years"]


@query("bin_right_closed", """
  select p_partkey, case when p_size < 0 then null when p_size <= 1 then 'First year' when p_size <= 2 then '1-2 years'
    when p_size <= 5 then '2-5 years' when p_size <= 10 then '5-10 years' when p_size <= 50 then '10+ years' end as bin
  from part""")
def bin_right_closed(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", S.bin_right_closed("p_size", SERVICE_EDGES, SERVICE_LABELS).alias("bin"))


@query("month_series", """
  select strftime(m, '%Y-%m-%d') as snap from (
    select unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
      interval 1 month)) as m from orders) x""")
def month_series(spark, sf):
    span = table(spark, sf, "orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    first = [F.trunc(F.col(c).cast("date"), "month") for c in ("lo", "hi")]
    months = span.select(F.explode(F.sequence(*first, F.expr("interval 1 month"))).alias("m"))
    return months.select(F.date_format("m", "yyyy-MM-dd").alias("snap"))


# --- grouping and encoding --------------------------------------------------------------


@query("group_rare", """
  with k as (select p_partkey, concat(p_type, cast(p_size as varchar)) as kind from part),
  n as (select kind, count(*) as n from k group by kind)
  select p_partkey, case when n.n <= 10 then 'Other' else k.kind end as grouped from k join n on k.kind = n.kind""")
def group_rare(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_type", F.col("p_size").cast("string")).alias("kind"))
    return FE.group_rare(p, "kind", "grouped").select("p_partkey", "grouped")


@query("one_hot", """
  select id, x, case when unit = 'AUTOMOBILE' then 1 else 0 end as "unit_AUTOMOBILE",
    case when unit = 'BUILDING' then 1 else 0 end as "unit_BUILDING",
    case when unit = 'FURNITURE' then 1 else 0 end as "unit_FURNITURE",
    case when unit = 'HOUSEHOLD' then 1 else 0 end as "unit_HOUSEHOLD",
    case when unit = 'MACHINERY' then 1 else 0 end as "unit_MACHINERY" from gaps""", "gaps")
def one_hot(spark, sf):
    units = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return FE.one_hot(V.gaps(spark, sf).drop("place"), {"unit": units})


LEVELS = ["L1", "L2", "L3", "L4", "L5"]
FUNCTIONS = ["F", "O", "P"]


@query("history_multi_hot", NEAREST_SQL + ", cut as (select distinct entity_id, snap_date as cutoff from nearest)"
       + " select h.entity_id, " + ", ".join(
           f"max(case when {c} = '{v}' then 1 else 0 end) as \"{c}_{v}\"" for c, vs in
           (("level", LEVELS), ("function", FUNCTIONS)) for v in vs)
       + " from panel h join cut c on h.entity_id = c.entity_id and h.snap_date <= c.cutoff group by h.entity_id",
       "panel exits checkpoints")
def history_multi_hot(spark, sf):
    near = H.nearest_snapshot(labelled_panel(spark, sf), "entity_id", "snap_date", "checkpoint", 31)
    cut = near.select("entity_id", F.col("snap_date").alias("cutoff")).distinct()
    hist = H.history_until(V.panel(spark, sf), cut, "entity_id", "snap_date", "cutoff")
    return H.multi_hot(hist, "entity_id", {"level": LEVELS, "function": FUNCTIONS})


@query("label_encode", """
  select c_custkey, cast(dense_rank() over (order by c_mktsegment) - 1 as int) as code from customer""")
def label_encode(spark, sf):
    return FE.label_encode(table(spark, sf, "customer"), "c_mktsegment", "code").select("c_custkey", "code")


@query("minmax_scale", """
  select c_custkey, round((c_acctbal - lo) / (hi - lo), 6) as c_acctbal, cast(0 as double) as one
  from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer) b""")
def minmax_scale(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(1.0).alias("one"))
    return FE.minmax_scale(c, ["c_acctbal", "one"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


_YJ_SQL = """
  with t as (select c_custkey as id, case when c_acctbal >= 0 then (pow(c_acctbal / 1000 + 1, 0.5) - 1) / 0.5
      else -(pow(1 - c_acctbal / 1000, 1.5) - 1) / 1.5 end as z from customer)
  select id, round((z - (select avg(z) from t)) / (select stddev_pop(z) from t), 5) as z from t"""


@query("yeo_johnson_fixed_lambda", _YJ_SQL)
def yeo_johnson_fixed_lambda(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("z"))
    return FE.power_transform(c, {"z": 0.5}).withColumn("z", F.round("z", 5))


@query("yeo_johnson_fit")
def yeo_johnson_fit(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("balance"))
    return FE.power_transform(c, FE.yeo_johnson_fit(c, ["balance"]))


@query("unpivot", """
  select id, 'unit' as attribute, unit as value from gaps where unit is not null
  union all select id, 'place', place from gaps where place is not null""", "gaps")
def unpivot(spark, sf):
    return SEL.unpivot(V.gaps(spark, sf).drop("x"), ["id"], "attribute", "value")


# --- imputing ---------------------------------------------------------------------------


@query("impute_median", "select id, round(coalesce(x, (select median(x) from gaps)), 6) as x from gaps", "gaps")
def impute_median(spark, sf):
    g = V.gaps(spark, sf).select("id", "x")
    return FE.impute_median(g, "x").withColumn("x", F.round("x", 6))


@query("impute_group_median", """
  select g.id, g.unit, round(coalesce(g.x, m.x), 6) as x from gaps g
  left join (select unit, median(x) as x from gaps where unit is not null group by unit) m on g.unit = m.unit""",
       "gaps")
def impute_group_median(spark, sf):
    g = V.gaps(spark, sf).select("id", "unit", "x")
    return FE.impute_group_median(g, "x", "unit").withColumn("x", F.round("x", 6))


_MODE_SQL = """(select {v} from gaps where {v} is not null group by {v} order by count(*) desc, {v} limit 1)"""


@query("impute_mode", f"select id, coalesce(unit, {_MODE_SQL.format(v='unit')}) as unit from gaps", "gaps")
def impute_mode(spark, sf):
    return FE.impute_mode(V.gaps(spark, sf).select("id", "unit"), "unit")


_GROUP_MODE_SQL = """
  gm as (select unit, place from (
    select unit, place, row_number() over (partition by unit order by count(*) desc, place) as rn from gaps
    where unit is not null and place is not null group by unit, place) x where rn = 1)"""


@query("impute_group_mode", f"with {_GROUP_MODE_SQL.strip()}" + """
  select g.id, g.unit, coalesce(g.place, gm.place) as place from gaps g left join gm on g.unit = gm.unit""", "gaps")
def impute_group_mode(spark, sf):
    return FE.impute_group_mode(V.gaps(spark, sf).select("id", "unit", "place"), "place", "unit")


TWO_LEVEL_SQL = f"""
  with {_GROUP_MODE_SQL.strip()},
  gx as (select unit, median(x) as x from gaps where unit is not null group by unit),
  filled as (select g.id, g.unit, coalesce(g.x, gx.x) as x, coalesce(g.place, gm.place) as place
    from gaps g left join gm on g.unit = gm.unit left join gx on g.unit = gx.unit),
  imputed as (select id, unit, coalesce(x, (select median(x) from filled)) as x,
    coalesce(place, (select place from filled where place is not null group by place
      order by count(*) desc, place limit 1)) as place from filled)"""


@query("impute_two_level", TWO_LEVEL_SQL + " select id, unit, round(x, 6) as x, place from imputed", "gaps")
def impute_two_level(spark, sf):
    g = FE.impute_two_level(V.gaps(spark, sf), "x", "unit", "median")
    return FE.impute_two_level(g, "place", "unit", "mode").withColumn("x", F.round("x", 6))
