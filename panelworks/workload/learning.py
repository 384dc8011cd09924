"""Queries: splits, resampling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.functions.scalars import above
from panelworks.operators import evaluate as E
from panelworks.operators import joins as J
from panelworks.operators import split as SP
from panelworks.workload import views as V
from panelworks.workload.registry import query
from panelworks.workload.views import table


def _md5(key: str, seed: int) -> str:
    return f"md5(concat(cast({key} as varchar), ':{seed}')), {key}"


@query("split_stratified", f"""
  select id, y, case when rn <= round(0.2 * n) then 'test' else 'train' end as split from (
    select id, y, row_number() over (partition by y order by {_md5('id', 9001)}) as rn,
      count(*) over (partition by y) as n from preds) x""", "preds")
def split_stratified(spark, sf):
    return SP.split_stratified(V.preds(spark, sf).drop("p"), "id", "y", 9001)


@query("split_random", f"""
  select id, case when rn <= round(0.2 * n) then 'test' else 'train' end as split from (
    select id, row_number() over (order by {_md5('id', 9002)}) as rn, count(*) over () as n from preds) x""", "preds")
def split_random(spark, sf):
    return SP.split_random(V.preds(spark, sf).select("id"), "id", 9002)


@query("split_future_holdout", f"""
  with e as (select c.c_custkey as id, x.term_date from customer c left join exits x on x.entity_id = c.c_custkey),
  late as (select id from e where term_date > date '2001-06-30'),
  act as (select id from (select id, row_number() over (order by {_md5('id', 9003)}) as rn from e where term_date is null) q
    where rn <= (select count(*) from late))
  select id, term_date, case when id in (select id from late) or id in (select id from act) then 'test' else 'train' end
    as split from e""", "exits", "term_date")
def split_future_holdout(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    e = c.join(V.exits(spark, sf).select(F.col("entity_id").alias("id"), "term_date"), "id", "left")
    return SP.split_future_holdout(e, "id", "term_date", "2001-06-30", 9003)


@query("split_by_ids", """
  select id, case when id in (select doc_id from labels where toxic = 1) then 'test' else 'train' end as split
  from preds""", "preds")
def split_by_ids(spark, sf):
    ids = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    train, test = SP.split_by_ids(V.preds(spark, sf).select("id"), ids, "id")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("kfold_assign", f"""
  select id, y, cast((row_number() over (partition by y order by {_md5('id', 5)}) - 1) % 5 as int) as fold from preds""",
       "preds")
def kfold_assign(spark, sf):
    return SP.kfold_assign(V.preds(spark, sf).drop("p"), "id", "y", 5)


@query("class_weights", """
  select y, count(*) as n, round((select count(*) from preds) / (2.0 * count(*)), 6) as weight from preds group by y""",
       "preds")
def class_weights(spark, sf):
    return SP.class_weights(V.preds(spark, sf), "y").withColumn("weight", F.round("weight", 6))


@query("undersample", f"""
  with m as (select id, y, row_number() over (partition by y order by {_md5('id', 9004)}) as rn from preds)
  select id, y from m where y = 0 or rn <= (select floor(count(*) / 0.8) from preds where y = 0)""", "preds")
def undersample(spark, sf):
    return SP.undersample(V.preds(spark, sf).drop("p"), "id", "y", 0, 9004)


def _adasyn_input(spark, sf):
    return V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"),
        (F.col("label") < 3).cast("int").alias("y"))


@query("adasyn_allocation", """
  with d as (select a.id, b.y, row_number() over (partition by a.id order by
      round(-sqrt(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v)), 9) desc,
      b.id) as rn from vectors a join vectors b on a.id <> b.id where a.y = 1),
  r as (select id, avg(case when y = 0 then 1.0 :: double else 0 end) as r from d where rn <= 5 group by id),
  g as (select floor(0.9 * count(*) filter (where y = 0)) - count(*) filter (where y = 1) as g from vectors)
  select id, round(r, 6) as r, cast(round(r / (select sum(r) from r) * greatest((select g from g), 0)) as bigint) as g
  from r""", "vectors")
def adasyn_allocation(spark, sf):
    a = SP.adasyn_allocation(_adasyn_input(spark, sf), "id", "v", "y", 1)
    return a.withColumn("r", F.round("r", 6))


@query("adasyn_rows")
def adasyn_rows(spark, sf):
    return SP.adasyn_rows(_adasyn_input(spark, sf), "id", "v", "y", 1, 9006)


# --- evaluation -------------------------------------------------------------------------


def _classes(spark, sf):
    return V.preds(spark, sf).withColumn("cls", above("p", 0.5))


_CLS = "c as (select id, y, p, case when p > 0.5 then 1 else 0 end as cls from preds)"


@query("confusion_shares", f"""
  with {_CLS} select round(count(*) filter (where y = 0 and cls = 0) / cast(count(*) as double), 6) as tn,
    round(count(*) filter (where y = 0 and cls = 1) / cast(count(*) as double), 6) as fp,
    round(count(*) filter (where y = 1 and cls = 0) / cast(count(*) as double), 6) as fn,
    round(count(*) filter (where y = 1 and cls = 1) / cast(count(*) as double), 6) as tp from c""", "preds")
def confusion_shares(spark, sf):
    s = E.confusion_shares(_classes(spark, sf), "y", "cls")
    return s.withColumns({c: F.round(c, 6) for c in s.columns})


@query("classification_report", f"""
  with {_CLS}, k as (select unnest([0, 1]) as c),
  m as (select k.c, count(*) filter (where y = k.c and cls = k.c) as tp, count(*) filter (where cls = k.c) as pr,
      count(*) filter (where y = k.c) as s from c cross join k group by k.c),
  q as (select c, s, tp, case when pr = 0 then 0 else tp / pr :: double end as p,
      case when s = 0 then 0 else tp / s :: double end as r from m),
  f as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f1 from q)
  select cast(c as varchar) as label, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1,
    cast(s as bigint) as support from f
  union all select 'accuracy', round(sum(tp) / sum(s), 6), round(sum(tp) / sum(s), 6), round(sum(tp) / sum(s), 6),
    cast(sum(s) as bigint) from f
  union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), cast(sum(s) as bigint) from f
  union all select 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6),
    round(sum(f1 * s) / sum(s), 6), cast(sum(s) as bigint) from f""", "preds")
def classification_report(spark, sf):
    r = E.classification_report(_classes(spark, sf), "y", "cls")
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("accuracy", f"with {_CLS} select round(avg(case when y = cls then 1 else 0 end), 6) as accuracy from c", "preds")
def accuracy(spark, sf):
    return E.accuracy(_classes(spark, sf), "y", "cls").withColumn("accuracy", F.round("accuracy", 6))


@query("roc_auc", """
  select round(sum(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0.0 end) :: double / count(*), 6) as auc
  from preds a join preds b on a.y = 1 and b.y = 0""", "preds")
def roc_auc(spark, sf):
    return E.roc_auc(V.preds(spark, sf), "y", "p").withColumn("auc", F.round("auc", 6))


@query("rmse", "select round(sqrt(avg((y - p) * (y - p))), 6) as rmse from preds", "preds")
def rmse(spark, sf):
    return E.rmse(V.preds(spark, sf), "y", "p").withColumn("rmse", F.round("rmse", 6))


@query("threshold_sweep", """
  with t as (select i / 100.0 :: double as threshold from (select unnest(generate_series(20, 79)) as i) g),
  m as (select threshold, count(*) filter (where p >= threshold and y = 1) as tp,
      count(*) filter (where p >= threshold and y = 0) as fp, count(*) filter (where p < threshold and y = 0) as tn,
      count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg, cast(count(*) as double) as n
    from t cross join preds group by threshold)
  select threshold, round((tp + tn) / n, 6) as accuracy, round(tp / cast(pos as double), 6) as recall_1,
    round(tn / cast(neg as double), 6) as recall_0,
    case when tp + fp > 0 then round(tp / cast(tp + fp as double), 6) end as precision_1 from m""", "preds")
def threshold_sweep(spark, sf):
    s = E.threshold_sweep(V.preds(spark, sf), "y", "p")
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c != "threshold"})


@query("prediction_table", """
  select id, p, case when p > 0.5 then 1 else 0 end as cls, y as truth from preds
  where id in (select doc_id from labels where toxic = 1)""", "preds")
def prediction_table(spark, sf):
    p = V.preds(spark, sf)
    ids = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return E.prediction_table(p.select("id", "p"), p.select("id", "y"), ids, "id", "p", "y")


def _bucket_sql(cols: str) -> str:
    parts = []
    for c in cols.split():
        qs = ", ".join(f"quantile_cont({c}, {i}/9.0 :: double)" for i in range(10))
        parts.append(f"g_{c} as (select list_sort(list_distinct([{qs}])) as g from t)")
    sel = ", ".join(
        f"cast(least(len(list_filter(g_{c}.g, lambda e: e <= t.{c})) - 1, len(g_{c}.g) - 2) as int) as bucket_{c}"
        for c in cols.split())
    grp = ", ".join(f"bucket_{c}" for c in cols.split())
    src = ", ".join(["t", *[f"g_{c}" for c in cols.split()]])
    return f"""
  with t as (select y, p, cast(id as double) as x from preds), {', '.join(parts)},
  b as (select {sel}, y from {src})
  select {grp}, count(*) as n, round(avg(y), 6) as rate from b group by {grp}"""


@query("target_by_bucket", _bucket_sql("p"), "preds")
def target_by_bucket(spark, sf):
    return E.target_by_bucket(V.preds(spark, sf), ["p"], "y").withColumn("rate", F.round("rate", 6))


@query("target_by_bucket_2d", _bucket_sql("p x"), "preds")
def target_by_bucket_2d(spark, sf):
    t = V.preds(spark, sf).withColumn("x", F.col("id").cast("double"))
    return E.target_by_bucket(t, ["p", "x"], "y").withColumn("rate", F.round("rate", 6))
