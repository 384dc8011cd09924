"""Queries: tokens, TF-IDF and sparse cosine pairs over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.functions.scalars import has_token
from panelworks.operators import similarity as SIM
from panelworks.operators import text as TX
from panelworks.session import discard, materialize
from panelworks.workload.registry import query
from panelworks.workload.views import table

_PATTERN = r"[\p{L}\p{N}_]{2,}"

TFIDF_SQL = rf"""
  with tok as (select doc_id as id, unnest(regexp_extract_all(lower(text), '{_PATTERN}')) as term from documents),
  tf as (select id, term, count(*) as tf from tok group by id, term),
  voc as (select term, count(*) as df from tf group by term),
  nd as (select cast(count(distinct id) as double) as n from tf),
  raw as (select tf.id, tf.term, tf.tf * (ln((1 + nd.n) / (1 + voc.df)) + 1) as w
    from tf join voc on tf.term = voc.term, nd),
  nrm as (select id, sqrt(sum(w * w)) as l from raw group by id),
  tfidf as (select raw.id, raw.term, raw.w / nrm.l as w from raw join nrm on raw.id = nrm.id)"""


@query("tokenize", rf"""
  select doc_id, cast(generate_subscripts(t, 1) - 1 as int) as pos, unnest(t) as term
  from (select doc_id, regexp_extract_all(lower(text), '{_PATTERN}') as t from documents) x""")
def tokenize(spark, sf):
    return TX.token_rows(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def document_vectors(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return TX.tfidf(materialize(TX.term_counts(d, "id", "text"), "counts"), "id")


@query("tfidf", TFIDF_SQL + " select id, term, round(w, 6) as w from tfidf")
def tfidf(spark, sf):
    return document_vectors(spark, sf).withColumn("w", F.round("w", 6))


@query("vocabulary", TFIDF_SQL + " select term, df from voc")
def vocabulary(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return TX.vocabulary(TX.term_counts(d, "doc_id", "text"))


def _sparse_sql(threshold: float) -> str:
    return TFIDF_SQL + f""",
  lim as (select min(n_chars) as lo, max(n_chars) as hi from documents where doc_id in (select id from tf)),
  mixed as (select * from tfidf union all
    select doc_id, '#n_chars', cast(n_chars - lo as double) / (hi - lo) from documents, lim
    where doc_id in (select id from tf) and n_chars > lo),
  mn as (select id, sqrt(sum(w * w)) as l from mixed group by id),
  vec as (select m.id, m.term, m.w / mn.l as w from mixed m join mn on m.id = mn.id),
  sig as (select id, string_agg(concat(term, ':', cast(round(w, 9) as varchar)), ' ' order by term) as s
    from vec group by id),
  rep as (select id, min(id) over (partition by s) as rep from sig),
  one as (select vec.* from vec join rep on vec.id = rep.id and rep.id = rep.rep),
  hit as (select a.id as src, b.id as dst, sum(a.w * b.w) as sim from one a join one b
    on a.term = b.term and a.id < b.id group by a.id, b.id having sum(a.w * b.w) > {threshold})
  select src, dst, round(sim, 6) as sim from hit
  union all select rep, id, 1.0 :: double from rep where id <> rep"""


def _sparse_pairs(spark, sf, threshold: float):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    counts = materialize(TX.term_counts(d, "id", "text"), "counts")
    n = table(spark, sf, "documents").filter(has_token("text")).select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("n_chars"))
    packed = SIM.packed_rows(TX.tfidf_weights(counts, "id"), TX.number_terms(n, "id", ["n_chars"]), "id")
    discard(counts)
    return SIM.packed_pairs(packed, threshold).withColumn("sim", F.round("sim", 6))


@query("cosine_sparse_pairs", _sparse_sql(0.8))
def cosine_sparse_pairs(spark, sf):
    return _sparse_pairs(spark, sf, 0.8)


# the threshold at which the workload cuts its similarity edges
@query("cosine_sparse_edges", _sparse_sql(0.5))
def cosine_sparse_edges(spark, sf):
    return _sparse_pairs(spark, sf, 0.5)
