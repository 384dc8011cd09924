"""Queries: models and their interpretation (rows-only: learned figures have no SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import evaluate as EV
from panelworks.operators import graph as G
from panelworks.operators import interpret as I
from panelworks.operators import models as M
from panelworks.operators import sparse as SX
from panelworks.operators import split as SP
from panelworks.session import materialize
from panelworks.workload import views as V
from panelworks.workload.graphs import NODE_FEATURES, node_table
from panelworks.workload.registry import query
from panelworks.workload.snapshots import ML_FEATURES_SQL, ml_entities, ml_long
from panelworks.workload.tables import CHECKPOINT_VIEWS, checkpoint_table
from panelworks.workload.vectors import vector_samples

WIDTH = 64


def _forest(df):
    return M.fit_forest(df, "v", "y")


def _held_out(spark, sf):
    """(model of the training rows, held-out rows)."""
    parts = materialize(SP.split_stratified(V.vectors(spark, sf), "id", "y", 9001), "split")
    return _forest(parts.filter("split = 'train'")), parts.filter("split = 'test'")


@query("rf_classifier")
def rf_classifier(spark, sf):
    parts = materialize(SP.split_stratified(V.vectors(spark, sf), "id", "y", 9001), "split")
    model = _forest(parts.filter("split = 'train'"))
    return M.score(model, parts, "v").select("id", "split", "y", "p", "cls")


@query("cross_validate")
def cross_validate(spark, sf):
    folds = materialize(SP.kfold_assign(V.vectors(spark, sf), "id", "y", 5), "folds")
    return M.cross_validate(folds, "fold", 5, _forest, "v").select("id", "fold", "y", "p", "cls")


@query("days_to_exit_regression")
def days_to_exit_regression(spark, sf):
    cols = ["band", "n_level", "n_function", "n_band", "downward_levels", "upward_levels"]
    f = checkpoint_table(spark, sf).filter("churn = 1").withColumn("v", M.feature_array(cols))
    parts = SP.split_random(f.select("entity_id", "days_to_exit", "v"), "entity_id", 9007)
    parts = materialize(parts, "exits")
    model = M.fit_boosted(parts.filter("split = 'train'"), "v", "days_to_exit")
    return M.predict(model, parts, "v").select("entity_id", "days_to_exit", "split", "prediction")


@query("node_classifier")
def node_classifier(spark, sf):
    nodes = node_table(spark, sf)
    m = G.sampled_means(nodes, *vector_samples(spark, sf), "id", NODE_FEATURES)
    cols = [c for c in m.columns if c != "id"]
    full = materialize(m.join(nodes.select("id", "y"), "id").withColumn("v", M.feature_array(cols)), "nodes")
    train = SP.split_random(full.select("id", "y", "v"), "id", 9002).filter("split = 'train'")
    return M.score(M.fit_logistic(train, "v", "y"), full.select("id", "y", "v"), "v").drop("v")


@query("tree_importance")
def tree_importance(spark, sf):
    df = V.vectors(spark, sf)
    return I.tree_importance(_forest(df), df, [f"x{i}" for i in range(WIDTH)])


@query("permutation_importance")
def permutation_importance(spark, sf):
    df = V.vectors(spark, sf)
    return I.permutation_importance(_forest(df), df, "id", "v", "y", range(WIDTH), 11)


@query("row_contributions")
def row_contributions(spark, sf):
    """Two pairs of orders, four background rows: what each coordinate adds to the score of every vector."""
    df = V.vectors(spark, sf)
    model, orders = _forest(df), I.feature_orders(WIDTH, 2, 21)
    background = I.background_rows(df, "id", "v", len(orders), 22)
    return I.row_contributions(model, df, "id", "v", background, orders)


@query("partial_dependence")
def partial_dependence(spark, sf):
    return I.partial_dependence(*_held_out(spark, sf), "id", "v", [0])


@query("partial_dependence_2d")
def partial_dependence_2d(spark, sf):
    return I.partial_dependence(*_held_out(spark, sf), "id", "v", [0, 1])


# --- models on the whole ML frame, tested on the exits of the future ---------------------

LAST_TRAINED = "2001-06-30"


def holdout_frame(spark, sf):
    """(entity_id, churn, days_to_exit, split, features): exits after LAST_TRAINED and as many actives test.

    The dictionary of features is fitted on the training rows alone; what only test rows have is no feature.
    """
    entities, past = ml_entities(spark, sf)
    rows = entities.select("entity_id", "churn", "days_to_exit", "term_date")
    rows = materialize(SP.split_future_holdout(rows, "entity_id", "term_date", LAST_TRAINED, 9011), "holdout")
    rows = rows.drop("term_date")
    long = ml_long(entities, past)
    train = rows.filter("split = 'train'").select("entity_id")
    known = materialize(SX.feature_dictionary(long.join(train, "entity_id", "left_semi")), "dictionary")
    return SX.sparse_vectors(rows, "entity_id", SX.encode(long, known), known.count())


def exit_scores(spark, sf):
    """The holdout frame's rows with the score and class of a forest of its training rows."""
    df = holdout_frame(spark, sf)
    model = M.stored(M.fit_forest(df.filter("split = 'train'"), "features", "churn"), spark)
    return materialize(M.score(model, df, "features").select("entity_id", "split", "churn", "p", "cls"), "scores")


@query("exit_model_scores")
def exit_model_scores(spark, sf):
    return exit_scores(spark, sf)


@query("exit_model_coverage", f"""{ML_FEATURES_SQL},
  late as (select entity_id from mo2 where term_date > date '{LAST_TRAINED}'),
  act as (select entity_id from (select entity_id, row_number() over (
      order by md5(concat(cast(entity_id as varchar), ':9011')), entity_id) as rn from mo2 where term_date is null) q
    where rn <= (select count(*) from late)),
  parts as (select churn, case when entity_id in (select entity_id from late) or entity_id in (select entity_id from act)
    then 'test' else 'train' end as split from mo2)
  select split, churn, count(*) as n, count(*) as n_scored from parts group by split, churn""", CHECKPOINT_VIEWS)
def exit_model_coverage(spark, sf):
    """Rows and validly scored rows per split and class: every row has a score from 0 to 1 and the class it implies."""
    valid = F.col("p").between(0, 1) & (F.col("cls") == (F.col("p") > 0.5).cast("int"))
    return exit_scores(spark, sf).groupBy("split", "churn").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_scored"))


@query("exit_model_report")
def exit_model_report(spark, sf):
    """Classification report and area under the curve of both splits."""
    scores = exit_scores(spark, sf)

    def report(split):
        part = scores.filter(F.col("split") == split)
        return EV.classification_report(part, "churn", "cls").withColumns({
            "split": F.lit(split), "auc": EV.roc_auc(part, "churn", "p").scalar()})

    return report("train").unionByName(report("test"))


@query("exit_model_days")
def exit_model_days(spark, sf):
    """Days until exit of the rows with one, predicted by boosted trees of the training rows."""
    df = holdout_frame(spark, sf).filter("churn = 1")
    model = M.stored(M.fit_boosted(df.filter("split = 'train'"), "features", "days_to_exit"), spark)
    return M.predict(model, df, "features").select("entity_id", "split", "days_to_exit", "prediction")
