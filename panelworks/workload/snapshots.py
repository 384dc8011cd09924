"""Queries: similarity per month, the similarity frame and the ML-ready frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.functions import scalars as S
from panelworks.operators import features as FE
from panelworks.operators import history as H
from panelworks.operators import select as SEL
from panelworks.operators import sparse as SX
from panelworks.operators import text as TX
from panelworks.operators.topk import sparse_topk
from panelworks.plans import frames
from panelworks.plans import recommend as REC
from panelworks.plans import snapshots as SN
from panelworks.session import fresh_path, materialize
from panelworks.sources import files
from panelworks.workload import tables as TB
from panelworks.workload import views as V
from panelworks.workload.features import FUNCTIONS, LEVELS
from panelworks.workload.registry import query
from panelworks.workload.views import table

FIRST, LAST = "2001-01-01", "2001-08-01"

_MONTH_SQL = r"""
  with m as (select cast(unnest(generate_series(date '2001-01-01', date '2001-08-01', interval 1 month)) as date) as snap_date),
  lt as (select * from (select m.snap_date, p.entity_id, p.unit, p.level,
      row_number() over (partition by m.snap_date, p.entity_id order by p.snap_date desc, p.row_key desc) as rn
    from m join panel p on p.snap_date <= m.snap_date) x where rn = 1),
  hs as (select m.snap_date, o.o_custkey as entity_id, concat('p', cast(l.l_partkey as varchar)) as term, count(*) as tf
    from m join orders o on cast(o.o_orderdate as date) < m.snap_date join lineitem l on l.l_orderkey = o.o_orderkey
    group by all),
  pf as (select snap_date, entity_id,
      unnest(regexp_extract_all(lower(concat_ws(' ', unit, level)), '[\p{L}\p{N}_]{2,}')) as term from lt),
  ct as (select snap_date, entity_id, term, cast(sum(tf) as bigint) as tf from (
      select snap_date, entity_id, term, 1 as tf from pf union all select * from hs) u group by all),
  nd as (select snap_date, cast(count(distinct entity_id) as double) as n from ct group by snap_date),
  vc as (select snap_date, term, count(*) as df from ct group by all),
  rw as (select ct.snap_date, ct.entity_id, ct.term, tf * (ln((1 + n) / (1 + df)) + 1) as w from ct
    join vc on vc.snap_date = ct.snap_date and vc.term = ct.term join nd on nd.snap_date = ct.snap_date),
  nr as (select snap_date, entity_id, sqrt(sum(w * w)) as l from rw group by all),
  vec as (select rw.snap_date, rw.entity_id, rw.term, w / l as w from rw join nr
    on nr.snap_date = rw.snap_date and nr.entity_id = rw.entity_id)
  select a.snap_date, a.entity_id as src, b.entity_id as dst, round(sum(a.w * b.w), 6) as sim
  from vec a join vec b on a.snap_date = b.snap_date and a.term = b.term and a.entity_id < b.entity_id
  group by a.snap_date, a.entity_id, b.entity_id having sum(a.w * b.w) > 0.2"""


def _bought(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").cast("date").alias("day"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("term"))


@query("similarity_by_month", _MONTH_SQL, "panel", "snap_date")
def similarity_by_month(spark, sf):
    p = V.panel(spark, sf).withColumn("words", S.bag_of_words(["unit", "level"]))
    latest = SN.latest_by_month(p, "entity_id", "snap_date", "row_key", ["words"], FIRST, LAST)
    history = SN.history_by_month(_bought(spark, sf), "entity_id", "day", "term", FIRST, LAST)
    pairs = SN.similarity_by_month(latest, history, "entity_id", "words", [], 0.2)
    return pairs.withColumn("sim", F.round("sim", 6))


_AMOUNTS, _VALUES = ["band", "amount", "balance"], ["level", "function", "band", "unit", "manager_id"]
MONTH_NUMBERS = [*_AMOUNTS, *[f"n_{c}" for c in _VALUES], "service_days"]


MONTH_BEST = 5


def month_vectors(spark, sf):
    """(snap_date, entity_id, term, w) of every month that the panel spans, from words, history and scaled numbers."""
    p = V.panel(spark, sf).withColumn("words", S.bag_of_words(["unit", "level"]))
    ends = p.agg(F.trunc(F.min("snap_date"), "month"), F.trunc(F.max("snap_date"), "month")).first()
    latest = SN.latest_by_month(p, "entity_id", "snap_date", "row_key", ["words", *_AMOUNTS], *ends)
    counts = SN.distinct_by_month(p, "entity_id", "snap_date", _VALUES, *ends)
    since = p.groupBy("entity_id").agg(F.min("snap_date").alias("_since"))
    latest = latest.join(counts, ["snap_date", "entity_id"]).join(since, "entity_id").withColumn(
        "service_days", F.datediff("snap_date", "_since"))
    history = SN.history_by_month(_bought(spark, sf), "entity_id", "day", "term", *ends)
    return materialize(SN.month_vectors(materialize(latest, "latest"), history, "entity_id", "words", MONTH_NUMBERS), "vectors")


# no SQL: the matrices of all months of whole tables; tests compare with plain products
@query("similarity_all_months")
def similarity_all_months(spark, sf):
    """The MONTH_BEST most similar entities of each one, for every month of the panel, in a sink by month."""
    best = sparse_topk(month_vectors(spark, sf), "entity_id", MONTH_BEST, ["snap_date"])
    best = materialize(best.withColumn("sim", F.round("sim", 6)), "best")
    path = files.write_partitioned(best, fresh_path(spark, "similarity"), ["snap_date"])
    return files.read_partitioned(spark, path, best.schema)


# --- similarity frame -------------------------------------------------------------------

_DIST_EDGES = [-1000, 0, 2000, 6000, 12000]
_DIST_LABELS = ["here", "near", "far", "remote"]

_GROUP_FILL = """
  {p}1 as (select e.* replace (coalesce(e.{c}, s.m) as {c}) from {src} e left join
    (select unit, {stat} as m from {src} where unit is not null group by unit) s on s.unit = e.unit),
  {p}2 as (select * replace (coalesce({c}, (select {stat} from {p}1)) as {c}) from {p}1)"""


def _median_fill(p: str, c: str, src: str) -> str:
    return _GROUP_FILL.format(p=p, c=c, src=src, stat=f"median({c})").strip()


_MODE_FILL = """
  md as (select unit, recent_rating from (select unit, recent_rating, row_number() over (partition by unit
      order by count(*) desc, recent_rating) as rn from {src} where recent_rating is not null group by unit, recent_rating) x
    where rn = 1),
  mo1 as (select e.* replace (coalesce(e.recent_rating, md.recent_rating) as recent_rating) from {src} e
    left join md on md.unit = e.unit),
  mo2 as (select * replace (coalesce(recent_rating, (select recent_rating from mo1 where recent_rating is not null
    group by recent_rating order by count(*) desc, recent_rating limit 1)) as recent_rating) from mo1)"""

_WORDS_RE = r"[\p{L}\p{N}_]{2,}"

_SIMFRAME_SQL = TB.ENTITY_SQL + rf""",
  nn as (select n_name as nm, count(*) as k from entity group by n_name),
  gp as (select e.*, case when nn.k <= 20 then 'Other' else e.n_name end as place from entity e left join nn on nn.nm = e.n_name),
  {_median_fill('ds', 'distance', 'gp')}, {_median_fill('rs', 'recent_score', 'ds2')},
  {_MODE_FILL.format(src='rs2').strip()},
  kept as (select *, case when distance < -1000 then null when distance <= 0 then 'here' when distance <= 2000 then 'near'
      when distance <= 6000 then 'far' when distance <= 12000 then 'remote' end as dist_bin
    from mo2 where term_reason is distinct from 'Involuntary'),
  words as (select entity_id, unnest(regexp_extract_all(lower(concat_ws(' ', replace(unit, ' ', ''), replace(place, ' ', ''),
      replace(recent_rating, ' ', ''), coalesce(dist_bin, 'nan'))), '{_WORDS_RE}')) as term from kept),
  past as (select h.entity_id, unnest([lower(h.level), lower(concat('fn_', h.function)), lower(concat('band_', cast(h.band as varchar)))]) as term
    from hist h where h.snap_date < date '2001-06-30' and h.entity_id in (select entity_id from kept))
  select entity_id, term, count(*) as tf from (select * from words union all select * from past) z group by entity_id, term"""


def _similarity_entities(spark, sf, snap="2001-06-30"):
    """Entities that did not leave involuntarily, with filled columns and the distance in bins."""
    e = materialize(TB.entity_table(spark, sf, snap), "entity")
    e = FE.group_rare(e, "n_name", "place", 20)
    e = SEL.prune_columns(e, ["snap_date", "manager_id", "level", "band", "n_name"])
    e = FE.impute_two_level(e, "distance", "unit", "median")
    e = FE.impute_two_level(materialize(e, "distance"), "recent_score", "unit", "median")
    e = FE.impute_two_level(materialize(e, "score"), "recent_rating", "unit", "mode")
    e = e.withColumn("dist_bin", S.bin_right_closed("distance", _DIST_EDGES, _DIST_LABELS))
    return SEL.strip_spaces(e.filter(S.ne_keep_null("term_reason", "Involuntary")))


def _similarity_terms(spark, sf, kept, snap="2001-06-30"):
    """(entity_id, term, tf) of profile words and of the history before the snapshot."""
    words = kept.select("entity_id", S.bag_of_words(["unit", "place", "recent_rating", "dist_bin"]).alias("w"))
    words = words.select("entity_id", F.explode(S.tokens("w")).alias("term"))
    hist = frames.clean_panel(V.panel(spark, sf), TB.spec(), snap).filter(S.asof("snap_date", snap, inclusive=False))
    # the history text of an entity, one token per value, so no text grows with the history
    past = hist.join(kept.select("entity_id"), "entity_id", "left_semi").select("entity_id", F.explode(F.array(
        F.lower("level"), F.lower(F.concat(F.lit("fn_"), "function")),
        F.concat(F.lit("band_"), F.col("band").cast("string")))).alias("term"))
    return words.unionByName(past).groupBy("entity_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query("similarity_frame", _SIMFRAME_SQL, TB.ENTITY_VIEWS)
def similarity_frame(spark, sf):
    return _similarity_terms(spark, sf, _similarity_entities(spark, sf))


# --- recommendations from entity rows ---------------------------------------------------

ENTITY_BEST = 10
ENTITY_NUMBERS = ["n_level", "n_function", "n_band", "n_unit", "n_manager", "downward_levels", "upward_levels",
                  "recent_score", "distance"]

_FRAME_SQL, _COUNT_SQL = _SIMFRAME_SQL.rsplit("\n  select entity_id, term, count(*)", 1)
_LIMITS = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in ENTITY_NUMBERS)
_SCALED = " union all ".join(
    f"select entity_id, '#{c}' as term, cast(case when hi_{c} > lo_{c} then ({c} - lo_{c}) / cast(hi_{c} - lo_{c} as double) "
    f"else 0 end as double) as w from kept, s_lim" for c in ENTITY_NUMBERS)
BEST_SQL = f"""{_FRAME_SQL},
  s_ct as (select entity_id, term, count(*){_COUNT_SQL}),
  s_nd as (select cast(count(distinct entity_id) as double) as n from s_ct),
  s_vc as (select term, count(*) as df from s_ct group by term),
  s_rw as (select entity_id, s_ct.term, tf * (ln((1 + n) / (1 + df)) + 1) as w from s_ct join s_vc on s_vc.term = s_ct.term cross join s_nd),
  s_tl as (select entity_id, sqrt(sum(w * w)) as l from s_rw group by entity_id),
  s_lim as (select {_LIMITS} from kept),
  s_mx as (select s_rw.entity_id, term, w / l as w from s_rw join s_tl on s_tl.entity_id = s_rw.entity_id
    union all select entity_id, term, w from ({_SCALED}) x where w <> 0),
  s_ml as (select entity_id, sqrt(sum(w * w)) as l from s_mx group by entity_id),
  s_vec as (select s_mx.entity_id, term, w / l as w from s_mx join s_ml on s_ml.entity_id = s_mx.entity_id),
  s_pr as (select a.entity_id as src, b.entity_id as dst, sum(a.w * b.w) as sim from s_vec a join s_vec b
    on a.term = b.term and a.entity_id <> b.entity_id group by a.entity_id, b.entity_id),
  best as (select src, dst, round(sim, 6) as sim, cast(row_number() over (
    partition by src order by round(sim, 9) desc, dst) as int) as rank from s_pr qualify rank <= {ENTITY_BEST})"""


def entity_neighbours(spark, sf):
    """The ENTITY_BEST most similar entities of each one, from terms and scaled numbers."""
    kept = materialize(_similarity_entities(spark, sf), "kept")
    vectors = TX.tfidf(materialize(_similarity_terms(spark, sf, kept), "terms"), "entity_id")
    vectors = TX.append_numbers(vectors, kept.select("entity_id", *ENTITY_NUMBERS), "entity_id", ENTITY_NUMBERS)
    return sparse_topk(vectors, "entity_id", ENTITY_BEST).withColumn("sim", F.round("sim", 6)), kept


@query("similar_entities", f"{BEST_SQL} select * from best", TB.ENTITY_VIEWS)
def similar_entities(spark, sf):
    return entity_neighbours(spark, sf)[0]


@query("recommend_entities", f"""{BEST_SQL}
  select best.src, best.rank, best.dst, best.sim, k.unit, k.function, k.recent_rating, k.n_level
  from best join kept k on k.entity_id = best.dst where k.churn = 0""", TB.ENTITY_VIEWS)
def recommend_entities(spark, sf):
    """Profiles of the most similar entities of each one; exits go after the cut, so at most ENTITY_BEST rows."""
    best, kept = entity_neighbours(spark, sf)
    return REC.active_profiles(best, kept, "entity_id", "churn", ["unit", "function", "recent_rating", "n_level"])


# --- ML-ready frame ---------------------------------------------------------------------

UNITS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_HOT = ", ".join(
    f"max(case when {c} = '{v}' then 1 else 0 end) as \"{c}_{v}\""
    for c, vs in (("level", LEVELS), ("function", FUNCTIONS)) for v in vs)

_ML_SQL = TB.CHECKPOINT_SQL + f""",
  mh as (select entity_id, {_HOT} from hcut group by entity_id),
  {_median_fill('im', 'recent_score', 'cf')}
  select i.entity_id, i.churn, i.days_to_exit, i.band, i.n_level, i.n_function, i.n_band, i.n_unit, i.n_manager,
    i.downward_levels, i.upward_levels, coalesce(i.n_reports, 0) as n_reports, round(i.recent_score, 6) as recent_score,
    mh.* exclude (entity_id), {', '.join(f"case when i.unit = '{u}' then 1 else 0 end as unit_{u}" for u in UNITS)}
  from im2 i join mh on mh.entity_id = i.entity_id"""


@query("ml_frame", _ML_SQL, TB.CHECKPOINT_VIEWS)
def ml_frame(spark, sf):
    clean = frames.clean_panel(V.panel(spark, sf), TB.spec())
    f = materialize(TB.checkpoint_table(spark, sf, clean), "checkpoint")
    hot = H.multi_hot(frames.history_at(clean, f, TB.spec()), "entity_id", {"level": LEVELS, "function": FUNCTIONS})
    f = SEL.prune_columns(f, [
        "snap_date", "manager_id", "level", "function", "recent_rating", "distance", "n_name", "cal_v"],
        ["term_date", "term_reason", "checkpoint"])
    f = FE.impute_two_level(f.join(hot, "entity_id"), "recent_score", "unit", "median")
    return FE.one_hot(f.fillna({"n_reports": 0}), {"unit": UNITS}).withColumn("recent_score", F.round("recent_score", 6))


# --- the whole ML frame as sparse features ----------------------------------------------

ML_TEXTS = ["unit", "place", "recent_rating"]
ML_NUMBERS = ["band", "n_level", "n_function", "n_band", "n_unit", "n_manager", "downward_levels", "upward_levels",
              "n_reports", "recent_score", "distance", "cal_v"]
ML_HISTORY = ["level", "function", "band", "unit", "manager_id", "volume"]
_VOLUME_EDGES = [0, 25000, 75000, 150000, 250000]
_VOLUME_LABELS = ["small", "medium", "large", "huge"]

ML_FEATURES_SQL = TB.CHECKPOINT_SQL + f""",
  pn as (select n_name as nm, count(*) as k from cf group by n_name),
  pl as (select cf.*, case when n_name is null or pn.k <= 10 then 'Other' else n_name end as place
    from cf left join pn on pn.nm = cf.n_name),
  {_median_fill('ds', 'distance', 'pl')}, {_median_fill('rs', 'recent_score', 'ds2')},
  {_MODE_FILL.format(src='rs2').strip()},
  past as (select *, case when amount < 0 then null when amount <= 25000 then 'small' when amount <= 75000 then 'medium'
    when amount <= 150000 then 'large' when amount <= 250000 then 'huge' end as volume from hcut),
  feats as (""" + " union all ".join(
    [f"select entity_id, '{c}=' || {c} as feature, cast(1 as double) as value from mo2" for c in ML_TEXTS]
    + [f"select entity_id, '{c}', cast({c} as double) from mo2 where {c} <> 0" for c in ML_NUMBERS]
    + [f"select distinct entity_id, '{c}:' || cast({c} as varchar), cast(1 as double) from past" for c in ML_HISTORY]
) + """),
  codes as (select feature, cast(row_number() over (order by feature) - 1 as int) as code
    from (select distinct feature from feats where feature is not null) d)"""


def ml_entities(spark, sf):
    """(entities at their checkpoints with all fills, their history up to it).

    Nations seen at most 10 times and unknown ones are ``Other``; distance and score take the median of
    the unit, the rating its mode, then those of the whole frame; a manager without reports has 0.
    """
    clean = frames.clean_panel(V.panel(spark, sf), TB.spec())
    f = materialize(TB.checkpoint_table(spark, sf, clean), "checkpoint")
    e = FE.group_rare(f, "n_name", "place", 10).fillna({"place": "Other", "n_reports": 0})
    e = FE.impute_two_level(e, "distance", "unit", "median")
    e = FE.impute_two_level(materialize(e, "distance"), "recent_score", "unit", "median")
    e = FE.impute_two_level(materialize(e, "score"), "recent_rating", "unit", "mode")
    past = frames.history_at(clean, f, TB.spec()).withColumn(
        "volume", S.bin_right_closed("amount", _VOLUME_EDGES, _VOLUME_LABELS))
    return materialize(e, "filled"), past


def ml_long(entities, past):
    """(entity_id, feature, value) of texts, numbers and six histories; exit columns are no features."""
    rows = SX.row_features(entities, "entity_id", ML_TEXTS, ML_NUMBERS)
    return materialize(rows.unionByName(SX.history_features(past, "entity_id", ML_HISTORY)), "features")


@query("ml_features", ML_FEATURES_SQL + """
  select f.entity_id, f.feature, c.code, round(f.value, 6) as value from feats f join codes c on c.feature = f.feature""",
       TB.CHECKPOINT_VIEWS)
def ml_features(spark, sf):
    long = ml_long(*ml_entities(spark, sf))
    return SX.encode(long, SX.feature_dictionary(long)).withColumn("value", F.round("value", 6))
