"""Queries: dense similarity search and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import joins as J
from panelworks.operators import nearest as N
from panelworks.plans import recommend as REC
from panelworks.session import fresh_path
from panelworks.sources import files
from panelworks.workload import views as V
from panelworks.workload.registry import query

_SIM_SQL = """
  u as (select id, v, y, sqrt(list_dot_product(v, v)) as l from vectors),
  sim as (select a.id as src, b.id as dst, list_dot_product(a.v, b.v) / (a.l * b.l) as sim
    from u a join u b on a.id <> b.id)"""


@query("cosine_dense_pairs", f"with {_SIM_SQL.strip()} select src, dst, round(sim, 6) as sim from sim "
       "where src < dst and sim > 0.3", "vectors")
def cosine_dense_pairs(spark, sf):
    return N.dense_pairs(V.vectors(spark, sf), "id", "v", 0.3).withColumn("sim", F.round("sim", 6))


@query("topk_similar", f"with {_SIM_SQL.strip()} select dst as id, round(sim, 6) as sim from sim "
       "where src = 17 order by sim desc, dst limit 5", "vectors")
def topk_similar(spark, sf):
    return REC.topk_similar(V.vectors(spark, sf), "id", "v", 17, 5).withColumn("sim", F.round("sim", 6))


@query("topk_all", f"""with {_SIM_SQL.strip()}
  select src, dst, round(sim, 6) as sim, rank from (select *, cast(row_number() over (
    partition by src order by round(sim, 9) desc, dst) as int) as rank from sim) x where rank <= 5""", "vectors")
def topk_all(spark, sf):
    near = N.nearest_neighbours(V.vectors(spark, sf), "id", "v", 5)
    return near.select("src", "dst", F.round("score", 6).alias("sim"), "rank")


def _info(spark, sf):
    return V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("T"), F.col("label").cast("string")).alias("title"),
        (F.col("label") < 3).cast("int").alias("churn"))


@query("recommend_active", f"""with {_SIM_SQL.strip()},
  best as (select dst as id, sim from sim where src = 17 order by round(sim, 9) desc, dst limit 10)
  select best.id, round(best.sim, 6) as sim, concat('T', cast(e.label as varchar)) as title
  from best join embeddings e on e.vec_id = best.id where e.label >= 3""", "vectors")
def recommend_active(spark, sf):
    return REC.recommend_active(
        V.vectors(spark, sf), _info(spark, sf), "id", "v", 17, 10, "churn", ["title"]
    ).withColumn("sim", F.round("sim", 6))


@query("entity_profile", """
  select vec_id as id, concat('T', cast(label as varchar)) as title, case when label < 3 then 1 else 0 end as churn
  from embeddings where vec_id = 17""")
def entity_profile(spark, sf):
    return REC.entity_profile(_info(spark, sf), "id", 17, ["id", "title", "churn"])


def vector_edges(spark, sf):
    """Edge list of the similarity graph, found as it is read: write it before reading it twice."""
    return N.dense_pairs(V.vectors(spark, sf), "id", "v", 0.3).select("src", "dst")


def vector_near(spark, sf):
    """(neighbours per representative, members) of the same graph, without a list of its edges."""
    return N.near_counts(V.vectors(spark, sf), "id", "v", 0.3)


def vector_samples(spark, sf):
    """Sampled neighbours (src, dst) of every node for the first and the second hop."""
    return N.near_samples(V.vectors(spark, sf), "id", "v", 0.3, [(20, 1), (10, 2)])


EDGES_SQL = f"{_SIM_SQL.strip()}, edges as (select src, dst from sim where src < dst and sim > 0.3)"


@query("similarity_edges", f"with {EDGES_SQL} select src, dst from edges", "vectors")
def similarity_edges(spark, sf):
    return vector_edges(spark, sf)


@query("pair_attributes", f"""with {EDGES_SQL}
  select e.src, e.dst, a.y as y_src, b.y as y_dst from edges e left join vectors a on a.id = e.src
  left join vectors b on b.id = e.dst""", "vectors")
def pair_attributes(spark, sf):
    return J.pair_attributes(vector_edges(spark, sf), V.vectors(spark, sf), "src", "dst", "id", ["y"])


@query("similarity_sink", f"""with {_SIM_SQL.strip()}
  select src, dst, round(sim, 6) as sim, '2001-01-01' as snap_date from sim where src < dst and sim > 0.3""", "vectors")
def similarity_sink(spark, sf):
    pairs = N.dense_pairs(V.vectors(spark, sf), "id", "v", 0.3).withColumns(
        {"sim": F.round("sim", 6), "snap_date": F.lit("2001-01-01")})
    path = files.write_partitioned(pairs, fresh_path(spark, "similarity"), ["snap_date"])
    return files.read_partitioned(spark, path, pairs.schema)
