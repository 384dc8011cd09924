"""Seeded splits, class weights and resampling; the same rows are chosen on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators.nearest import nearest_neighbours
from panelworks.operators.position import with_hash_rank
from panelworks.session import materialize

#: Synthetic rows are numbered in blocks of this many, so no array grows with the data.
DRAWS = 1000


def _with_class_size(df: DataFrame, label: str) -> DataFrame:
    """A null label is a class of its own, here and in all splits."""
    sizes = df.groupBy(F.col(label).alias("_cl")).agg(F.count(F.lit(1)).alias("_nl"))  # one row per class
    return df.join(sizes, F.col(label).eqNullSafe(F.col("_cl"))).drop("_cl")


def split_stratified(df: DataFrame, key: str, label: str, seed: int, share: float = 0.2) -> DataFrame:
    """``split`` = test for the first round(share * n) rows of each class in hash order."""
    ranked = _with_class_size(with_hash_rank(df, key, seed, [label], "_r"), label)
    return ranked.withColumn(
        "split", F.when(F.col("_r") <= F.round(F.lit(share) * F.col("_nl")), "test").otherwise("train")
    ).drop("_r", "_nl")


def split_random(df: DataFrame, key: str, seed: int, share: float = 0.2) -> DataFrame:
    n = df.agg(F.count(F.lit(1))).scalar()
    return with_hash_rank(df, key, seed, name="_r").withColumn(
        "split", F.when(F.col("_r") <= F.round(F.lit(share) * n), "test").otherwise("train")
    ).drop("_r")


def split_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): test holds the listed ids."""
    ids = ids.select(key)
    return df.join(ids, key, "left_anti"), df.join(ids, key, "left_semi")


def split_future_holdout(df: DataFrame, key: str, exit_date: str, after, seed: int) -> DataFrame:
    """Test: all exits after a date and as many rows without an exit; the rest trains."""
    late = df.filter(F.col(exit_date) > F.lit(after).cast("date")).select(key)
    n = late.agg(F.count(F.lit(1))).scalar()
    actives = df.filter(F.col(exit_date).isNull()).select(key)
    some = with_hash_rank(actives, key, seed, name="_r").filter(F.col("_r") <= n).select(key)
    test = late.unionByName(some).withColumn("_t", F.lit(1))
    return df.join(test, key, "left").withColumn(
        "split", F.when(F.col("_t") == 1, "test").otherwise("train")).drop("_t")


def kfold_assign(df: DataFrame, key: str, label: str, seed: int, k: int = 5) -> DataFrame:
    """Stratified folds 0 ... k - 1."""
    ranked = with_hash_rank(df, key, seed, [label], "_r")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = n_rows / (n_classes * n)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return sizes.withColumn("_t", total).select(
        label, "n", (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    weights = class_weights(df, label).select(F.col(label).alias("_cl"), "weight")
    return df.join(weights, F.col(label).eqNullSafe(F.col("_cl"))).drop("_cl")


def undersample(df: DataFrame, key: str, label: str, minority: int, seed: int, ratio: float = 0.8) -> DataFrame:
    """All minority rows and the first floor(n_min / ratio) others in hash order; a null label is another."""
    small = df.filter(F.col(label) == minority)
    n = small.agg(F.floor(F.count(F.lit(1)) / ratio)).scalar()
    rest = df.filter(~F.col(label).eqNullSafe(F.lit(minority)))
    kept = with_hash_rank(rest, key, seed, name="_r").filter(F.col("_r") <= n).drop("_r")
    return small.unionByName(kept)


def adasyn_allocation(
    df: DataFrame, key: str, v: str, label: str, minority: int, ratio: float = 0.9, k: int = 5
) -> DataFrame:
    """Synthetic rows per minority row (key, r, g): more where neighbours are of the majority."""
    small = df.filter(F.col(label) == minority).select(key)
    near = nearest_neighbours(df, key, v, k, "euclidean", queries=small)
    of = df.select(F.col(key).alias("dst"), F.col(label).alias("_y"))
    r = near.join(of, "dst").groupBy(F.col("src").alias(key)).agg(
        F.avg((F.col("_y") != minority).cast("double")).alias("r"))
    n = df.agg(F.struct(
        F.count_if(F.col(label) == minority).alias("small"),
        F.count_if(F.col(label) != minority).alias("large"))).scalar()
    total = r.agg(F.sum("r")).scalar()
    want = F.floor(F.lit(ratio) * F.col("_n.large")) - F.col("_n.small")
    return r.withColumn("_n", n).select(
        key, "r",
        F.coalesce(F.round(F.try_divide("r", total) * F.greatest(want, F.lit(0))), F.lit(0)).cast("long").alias("g"))


def adasyn_rows(
    df: DataFrame, key: str, v: str, label: str, minority: int, seed: int, ratio: float = 0.9, k: int = 5
) -> DataFrame:
    """Synthetic minority rows (parent, j, v): points between a row and one of its minority neighbours.

    Neighbour and place are taken from a hash of (parent, j), so a rerun makes the same rows.
    """
    small = df.filter(F.col(label) == minority)
    plan = adasyn_allocation(df, key, v, label, minority, ratio, k).filter("g > 0")
    near = materialize(nearest_neighbours(small, key, v, k, "euclidean"), "mates")
    mates = near.groupBy(F.col("src").alias("_p")).agg(F.count(F.lit(1)).alias("_m"))
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("j").cast("string"), F.lit(seed)).cast("binary"))
    hexnum = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("long")
    drawn = (
        plan.select(key, "g", F.explode(F.sequence(F.lit(0), F.floor((F.col("g") - 1) / DRAWS))).alias("_b"))
        .select(key, F.explode(F.sequence(F.col("_b") * DRAWS + 1, F.least(F.col("g"), (F.col("_b") + 1) * DRAWS))).alias("j"))
        .join(mates, F.col(key) == F.col("_p"))
        .withColumns({"rank": (F.pmod(hexnum(1, 6), F.col("_m")) + 1).cast("int"),
                      "u": hexnum(9, 8).cast("double") / F.lit(float(16**8))})
        .drop("_p", "_m")
    )
    mate = near.select(F.col("src").alias(key), "rank", F.col("dst").alias("_z"))
    a = small.select(key, F.col(v).alias("_a"))
    b = small.select(F.col(key).alias("_z"), F.col(v).alias("_b"))
    return (
        drawn.join(mate, [key, "rank"]).join(a, key).join(b, "_z")
        .select(F.col(key).alias("parent"), "j",
                F.zip_with("_a", "_b", lambda x, z: x + F.col("u") * (z - x)).alias("v"))
    )
