"""Views that give the driver tables the shape of a panel workload, as DataFrames and as CTEs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions.scalars import label_by_patterns


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    SQL[name] = (needs, sql)


def with_views(names: Sequence[str], body: str) -> str:
    """``body`` preceded by the CTEs it names; ``body`` may start with its own WITH."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in SQL[n][0]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return body
    ctes = ", ".join(f"{n} AS ({SQL[n][1]})" for n in ordered)
    body = body.strip()
    if body[:5].lower() == "with ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


# --- panel: one row per entity and report date ------------------------------------------

_cte("panel", """
  select o_custkey as entity_id, cast(o_orderdate as date) as snap_date, o_orderkey as row_key,
    concat('L', substr(o_orderpriority, 1, 1)) as level, o_orderstatus as function,
    cast(floor(o_totalprice / 100000) as int) as band, c_mktsegment as unit, c_nationkey as manager_id,
    o_totalprice as amount, c_acctbal as balance
  from orders join customer on o_custkey = c_custkey""")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderdate").cast("date").alias("snap_date"),
        F.col("o_orderkey").alias("row_key"),
        F.concat(F.lit("L"), F.substring("o_orderpriority", 1, 1)).alias("level"),
        F.col("o_orderstatus").alias("function"),
        F.floor(F.col("o_totalprice") / 100000).cast("int").alias("band"),
        F.col("c_mktsegment").alias("unit"),
        F.col("c_nationkey").alias("manager_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("balance"),
    )


def level_number(c: str = "level"):
    return F.replace(F.col(c), F.lit("L"), F.lit("")).cast("int")


# --- exits: one row per exit ------------------------------------------------------------

_cte("exits", """
  select entity_id, cast(last_date + (entity_id % 90) * interval '1' day as date) as term_date,
    concat('Exit > ', case entity_id % 5 when 0 then 'Involuntary' when 1 then 'Retirement' else 'Voluntary' end,
      ' > ', unit) as reason
  from (select entity_id, unit, max(snap_date) as last_date from panel where balance < 0
        group by entity_id, unit) x""", ("panel",))


def exits(spark: SparkSession, sf: str) -> DataFrame:
    last = (
        panel(spark, sf)
        .filter(F.col("balance") < 0)
        .groupBy("entity_id", "unit")
        .agg(F.max("snap_date").alias("last_date"))
    )
    kind = F.col("entity_id") % 5
    why = F.when(kind == 0, "Involuntary").when(kind == 1, "Retirement").otherwise("Voluntary")
    return last.select(
        "entity_id",
        F.date_add("last_date", (F.col("entity_id") % 90).cast("int")).alias("term_date"),
        F.concat(F.lit("Exit > "), why, F.lit(" > "), F.col("unit")).alias("reason"),
    )


# --- scores: long (entity, year, type) --------------------------------------------------

_cte("scores", """
  select l_partkey as entity_id, cast(year(l_shipdate) as int) as yr,
    case when l_linestatus = 'F' then 'Self' else 'Team' end as type,
    cast(sum(cast(l_quantity as decimal(10,2))) as double) / count(*) as score
  from lineitem where year(l_shipdate) in (2000, 2001)
  group by l_partkey, year(l_shipdate), l_linestatus""")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    yr = F.year("l_shipdate")
    return (
        table(spark, sf, "lineitem")
        .filter((F.col("l_shipdate") >= "2000-01-01") & (F.col("l_shipdate") < "2002-01-01"))
        .groupBy(F.col("l_partkey").alias("entity_id"), yr.alias("yr"), "l_linestatus")
        .agg(
            (F.sum(F.col("l_quantity").cast("decimal(10,2)")).cast("double") / F.count(F.lit(1))).alias("score")
        )
        .select(
            "entity_id",
            "yr",
            F.when(F.col("l_linestatus") == "F", "Self").otherwise("Team").alias("type"),
            "score",
        )
    )


# --- series: one row per day ------------------------------------------------------------

_cte("series", """
  select cast(o_orderdate as date) as day, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v,
    concat('$', cast(max(cast(o_totalprice as decimal(18,2))) as varchar(20))) as px
  from orders group by cast(o_orderdate as date)""")


def series(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"))
        .agg(
            F.sum(price).cast("double").alias("v"),
            F.concat(F.lit("$"), F.max(price).cast("string")).alias("px"),
        )
    )


# --- gaps: an entity table with holes ---------------------------------------------------

_cte("gaps", """
  select c_custkey as id, case when c_custkey % 11 = 0 then null else c_mktsegment end as unit,
    case when c_custkey % 7 = 0 then null else c_acctbal end as x,
    case when c_custkey % 5 = 0 then null else concat('N', cast(c_nationkey as varchar(4))) end as place
  from customer""")


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("id"),
        F.when(k % 11 != 0, F.col("c_mktsegment")).alias("unit"),
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("x"),
        F.when(k % 5 != 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("place"),
    )


# --- nodes: entities with six categorical attributes ------------------------------------

_cte("nodes", """
  select c_custkey as id, c_mktsegment as a1, c_nationkey as a2, c_custkey % 4 as a3,
    case when c_acctbal < 0 then null when c_acctbal < 5000 then 'lo' else 'hi' end as a4,
    c_custkey % 9 as a5, c_custkey % 13 as a6
  from customer""")

NODE_ATTRIBUTES = ["a1", "a2", "a3", "a4", "a5", "a6"]


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        k.alias("id"),
        F.col("c_mktsegment").alias("a1"),
        F.col("c_nationkey").alias("a2"),
        (k % 4).alias("a3"),
        F.when(b < 0, F.lit(None)).when(b < 5000, "lo").otherwise("hi").alias("a4"),
        (k % 9).alias("a5"),
        (k % 13).alias("a6"),
    )


# --- preds: a deterministic score and a 0/1 label ---------------------------------------

_cte("preds", """
  select l.doc_id as id, l.quality as y, cast((d.n_chars * 37 + l.doc_id * 11) % 1000 as double) / 1000 as p
  from labels l join documents d on l.doc_id = d.doc_id""")


def preds(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return (
        table(spark, sf, "labels")
        .join(d, "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            F.col("quality").alias("y"),
            (((F.col("n_chars") * 37 + F.col("doc_id") * 11) % 1000).cast("double") / 1000).alias("p"),
        )
    )


# --- checkpoints: (lo, hi, checkpoint) ranges and the default ---------------------------

_RANGES = [
    ("1999-01-01", "1999-12-31", "1999-01-01"),
    ("2000-01-01", "2000-06-30", "2000-01-01"),
    ("2000-07-01", "2000-12-31", "2000-07-01"),
    ("2001-01-01", "2001-06-30", "2001-01-01"),
    ("2001-07-01", "2001-12-31", "2001-07-01"),
]
DEFAULT_CHECKPOINT = "2001-07-01"

_cte("checkpoints", " union all ".join(
    f"select date '{a}' as lo, date '{b}' as hi, date '{c}' as checkpoint" for a, b, c in _RANGES))


def checkpoint_ranges() -> list[tuple]:
    import datetime as dt

    return [tuple(dt.date.fromisoformat(x) for x in r) for r in _RANGES]


# --- vectors: unit-length embeddings with a 0/1 label -----------------------------------

_cte("vectors", """
  select vec_id as id, cast(embedding as double[]) as v, case when label < 3 then 1 else 0 end as y
  from embeddings""")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("v"),
        (F.col("label") < 3).cast("int").alias("y"),
    )


# --- titles: part names labelled by ordered patterns ------------------------------------

# The sixteen title patterns of the workload, in their order of precedence.
TITLE_PATTERNS = [
    "Analyst", "Assoc. Analyst", "Manager", "Assoc. Manager", "Sr. Manager", "Group Lead",
    "Director", "Assoc. Director", "Sr. Director", "Coordinator", "VP", "Assoc. VP", "Sr. VP",
    "Global Non Banded", "Others", "Global - Hourly Others",
]


def title_group(c):
    return label_by_patterns(c, TITLE_PATTERNS)


# --- ratings: a long list by year, and department lists in wide form --------------------

_cte("ratings_main", """
  select o_custkey as entity_id, cast(year(o_orderdate) as int) as yr,
    case min(substr(o_orderpriority, 1, 1)) when '1' then 'joined' when '2' then null
      else concat(min(substr(o_orderpriority, 1, 1)), 'A') end as rating
  from orders group by o_custkey, year(o_orderdate)""")


def ratings_main(spark: SparkSession, sf: str) -> DataFrame:
    best = F.min(F.substring("o_orderpriority", 1, 1))
    g = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("yr")).agg(best.alias("b"))
    rating = F.when(F.col("b") == "1", "joined").when(F.col("b") != "2", F.concat("b", F.lit("A")))
    return g.select("entity_id", "yr", rating.alias("rating"))


_cte("ratings_wide", """
  select c_custkey as entity_id, c_mktsegment as dept,
    case c_nationkey when 0 then 'late' when 1 then '0' when 2 then 'split' when 3 then 'open'
      when 4 then 'k2' when 5 then 'k3' when 6 then null else 'G2' end as r_2000,
    case when c_acctbal < 0 then 'late' when c_acctbal < 1000 then null
      when c_acctbal < 2000 then 'early' else 'G1' end as r_2001
  from customer""")


def ratings_wide(spark: SparkSession, sf: str) -> DataFrame:
    n, b = F.col("c_nationkey"), F.col("c_acctbal")
    r_2000 = (
        F.when(n == 0, "late").when(n == 1, "0").when(n == 2, "split").when(n == 3, "open")
        .when(n == 4, "k2").when(n == 5, "k3").when(n == 6, F.lit(None)).otherwise("G2"))
    r_2001 = (
        F.when(b < 0, "late").when(b < 1000, F.lit(None))
        .when(b < 2000, "early").otherwise("G1"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("dept"),
        r_2000.alias("r_2000"), r_2001.alias("r_2001"))


# --- distances: two lists stacked, so some ids repeat -----------------------------------

_cte("distances", """
  select distinct entity_id, distance from (
    select s_suppkey as entity_id, s_acctbal as distance from supplier
    union all select c_custkey, c_acctbal from customer where c_acctbal > 1000) x""")


def distances(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entity_id"), F.col("s_acctbal").alias("distance"))
    c = table(spark, sf, "customer").filter("c_acctbal > 1000").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_acctbal").alias("distance"))
    return s.unionByName(c).distinct()
