"""Sparse features and the models on the ML frame."""

import math

import numpy as np
import pytest

from panelworks.operators import models as M
from panelworks.operators import sparse as SX
from panelworks.session import materialize

ROWS = "id long, unit string, place string, n double, m int"


def long_rows(spark, rows, past):
    df = spark.createDataFrame(rows, ROWS)
    history = spark.createDataFrame(past, "id long, level string, band int")
    both = SX.row_features(df, "id", ["unit", "place"], ["n", "m"]).unionByName(
        SX.history_features(history, "id", ["level", "band"]))
    return df, both


def test_long_rows_equal_brute_force(spark):
    rows = [(1, "a", "x", 2.5, 0), (2, None, "x=y", math.nan, 3), (3, "", None, None, None), (None, "a", "x", 1.0, 1)]
    past = [(1, "L1", 2), (1, "L1", 2), (1, "L2", None), (2, None, -1), (None, "L9", 9)] + [(3, "L1", 7)] * 50
    _, both = long_rows(spark, rows, past)
    want = []
    for key, unit, place, n, m in rows:
        if key is None:
            continue
        want += [(key, f"{c}={v}", 1.0) for c, v in (("unit", unit), ("place", place)) if v is not None]
        want += [(key, c, float(v)) for c, v in (("n", n), ("m", m)) if v is not None and v == v and v != 0]
    want += sorted({(k, f"{c}:{v}", 1.0) for k, lv, b in past if k is not None
                    for c, v in (("level", lv), ("band", b)) if v is not None})
    assert sorted(map(tuple, both.collect())) == sorted(want)


def test_vectors_hold_the_codes_of_known_features(spark):
    rows = [(1, "a", "x", 2.5, 4), (2, "b", "zz", -1.0, 0), (3, None, None, None, None), (None, "a", None, 1.0, 1)]
    df, both = long_rows(spark, rows, [(1, "L1", 2), (2, "L2", 2)])
    known = SX.feature_dictionary(both.filter("id = 1"))
    codes = {r["feature"]: r["code"] for r in known.collect()}
    assert codes == {f: i for i, f in enumerate(sorted(["unit=a", "place=x", "n", "m", "level:L1", "band:2"]))}
    out = SX.sparse_vectors(df.withColumnRenamed("m", "code"), "id", SX.encode(both, known), len(codes))
    assert out.columns == ["id", "unit", "place", "n", "code", "features"]
    got = {r["id"]: r["features"] for r in out.collect()}
    assert set(got) == {1, 2, 3, None}
    want = np.zeros(len(codes))
    for f, v in (("unit=a", 1), ("place=x", 1), ("n", 2.5), ("m", 4), ("level:L1", 1), ("band:2", 1)):
        want[codes[f]] = v
    assert np.array_equal(got[1].toArray(), want)
    # of row 2 the training rows know the number and the band only
    assert {i: v for i, v in zip(got[2].indices, got[2].values)} == {codes["n"]: -1.0, codes["band:2"]: 1.0}
    assert got[3].size == len(codes) and not len(got[3].indices) and not len(got[None].indices)


def test_empty_tables(spark):
    df, both = long_rows(spark, [], [])
    known = SX.feature_dictionary(both)
    assert known.count() == 0
    out = SX.sparse_vectors(df, "id", SX.encode(both, known), 0)
    assert out.columns == ["id", "unit", "place", "n", "m", "features"] and out.count() == 0


def test_stored_model_scores_alike(spark):
    rows = [(i, "a" if i % 3 else "b", f"p{i % 5}", float(i % 7), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, ROWS)
    long = SX.row_features(df, "id", ["unit", "place"], ["n"])
    known = SX.feature_dictionary(long)
    ready = SX.sparse_vectors(df.selectExpr("id", "cast(unit = 'b' or n > 4 as int) as y"), "id", SX.encode(long, known), known.count())
    model = M.fit_forest(ready, "features", "y", trees=10)
    first = {r["id"]: r["p"] for r in M.score(model, ready, "features").collect()}
    again = {r["id"]: r["p"] for r in M.score(M.stored(model, spark), ready, "features").collect()}
    assert first == again
    truth = {r["id"]: r["y"] for r in ready.collect()}
    assert sum((first[i] > 0.5) == (truth[i] == 1) for i in truth) >= 190


@pytest.fixture(scope="module")
def frame(spark):
    from panelworks.workload.modelling import holdout_frame

    return materialize(holdout_frame(spark, "/root/testdata/sf0.01"), "frame")


def test_holdout_frame_leaves_no_exit_column_in_the_features(spark, frame):
    from panelworks.workload import snapshots as S

    assert frame.columns == ["entity_id", "churn", "days_to_exit", "split", "features"]
    assert not {"churn", "days_to_exit", "term_date", "checkpoint"} & set(S.ML_TEXTS + S.ML_NUMBERS + S.ML_HISTORY)
    rows = frame.collect()
    tested = [r for r in rows if r["split"] == "test"]
    assert 2 * sum(r["churn"] for r in tested) == len(tested) > 0
    used = {i for r in rows if r["split"] == "train" for i in r["features"].indices}
    # every feature of the dictionary occurs in a training row, so none was learned from the test rows
    assert used == set(range(rows[0]["features"].size))


def test_report_equals_the_scores(spark):
    from panelworks.workload.catalog import load

    scores = load()["exit_model_scores"].run(spark, "/root/testdata/sf0.01").collect()
    report = {(r["split"], r["label"]): r for r in load()["exit_model_report"].run(spark, "/root/testdata/sf0.01").collect()}
    for split in ("train", "test"):
        part = [r for r in scores if r["split"] == split]
        right = sum(r["cls"] == r["churn"] for r in part) / len(part)
        assert report[split, "accuracy"]["precision"] == pytest.approx(right)
        pos, neg = ([r["p"] for r in part if r["churn"] == y] for y in (1, 0))
        wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert report[split, "accuracy"]["auc"] == pytest.approx(wins)
