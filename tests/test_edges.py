"""Null rules, ties and boundaries on small literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelworks.functions import scalars as S
from panelworks.operators import aggregate as A
from panelworks.operators import evaluate as E
from panelworks.operators import features as FE
from panelworks.operators import history as H
from panelworks.operators import joins as J
from panelworks.operators import position as P
from panelworks.operators import quality as Q
from panelworks.operators import select as SEL
from panelworks.operators import split as SP
from panelworks.plans import lookups
from panelworks.session import shared_dir
from panelworks.sources import files as FILES
from panelworks.workload.views import title_group


def d(text):
    return dt.date.fromisoformat(text)


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_not_in_and_ne_keep_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    assert values(df.filter(S.not_in_keep_null("c", ["a"])), "id") == [(2,), (3,)]
    assert values(df.filter(S.ne_keep_null("c", "a")), "id") == [(2,), (3,)]


def test_null_keys_never_match_and_form_no_group(spark):
    df = spark.createDataFrame([(1, "m"), (2, "m"), (3, None)], "id int, mgr string")
    assert values(J.span_of_control(df, "id", "mgr"), "id", "n_reports") == [(1, 2), (2, 2), (3, None)]
    right = spark.createDataFrame([(None, 9), ("m", 7)], "mgr string, x int")
    assert values(J.left_join_keep_left(df, right, "mgr"), "id", "x") == [(1, 7), (2, 7), (3, None)]


def test_transitions_follow_date_order(spark):
    rows = [(1, d("2020-03-01"), 3, 6), (1, d("2020-01-01"), 1, 5), (1, d("2020-02-01"), 2, 6), (1, d("2020-04-01"), 4, 4),
            (1, d("2020-02-15"), 5, None), (2, d("2020-01-01"), 6, 1)]
    df = spark.createDataFrame(rows, "id int, day date, k int, lv int")
    got = H.level_transitions(df, "id", ["day", "k"], F.col("lv"), S.month_index("day"))
    assert values(got, "id", "rises", "falls") == [(1, 1, 1), (2, 0, 0)]


def test_history_string_parts(spark):
    rows = [(1, d("2020-01-01") + dt.timedelta(days=i), i, f"v{i}") for i in range(7)] + [(2, d("2020-01-01"), 0, None)]
    df = spark.createDataFrame(rows, "id int, day date, k int, v string").repartition(3)
    got = H.history_string(df, "id", ["day", "k"], "v", S.month_index("day"), part_rows=3)
    assert values(got, "id", "part", "history") == [
        (1, 0, "v0,v1,v2"), (1, 1, "v3,v4,v5"), (1, 2, "v6"), (2, 0, "nan")]


def test_conflicts_count_known_values_only(spark):
    rows = [(1, "m1", "A"), (1, "m1", "B"), (2, "m1", "A"), (2, "m1", None)]
    df = spark.createDataFrame(rows, "id int, m string, s string")
    assert values(A.conflicting_ids(df, "id", "m", "s"), "id") == [(1,)]


def test_null_rating_wins(spark):
    df = spark.createDataFrame([(1, "3A"), (1, None), (2, "1A"), (2, "2A")], "id int, r string")
    got = A.latest_per_key(df, ["id"], [F.desc_nulls_first("r")])
    assert values(got, "id", "r") == [(1, None), (2, "2A")]


def test_modes_ties_empty_groups_and_two_levels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string")
    assert A.modes(df, "c").first()[0] == "a"
    rows = [(1, "g", "x"), (2, "g", None), (3, "h", None), (4, None, None), (5, "g", "x")]
    got = FE.impute_two_level(spark.createDataFrame(rows, "id int, g string, v string"), "v", "g", "mode")
    assert values(got, "id", "v") == [(i, "x") for i in range(1, 6)]


def test_bag_of_words_and_unmapped_recode(spark):
    df = spark.createDataFrame([("a", None), (None, 1)], "c string, n int")
    assert values(df.select(S.bag_of_words(["c", "n"]).alias("w")), "w") == [("a nan",), ("nan 1",)]
    assert values(df.select(S.recode("c", {"b": "B"}).alias("r")), "r") == [(None,), (None,)]


def test_asof_both_flags_and_clamp(spark):
    df = spark.createDataFrame([(d("2020-01-01"),), (d("2020-01-02"),), (None,)], "x date")
    assert df.filter(S.asof("x", "2020-01-01")).count() == 1
    assert df.filter(S.asof("x", "2020-01-01", inclusive=False)).count() == 0
    assert df.filter(S.asof("x", None)).count() == 3
    got = values(df.select(S.clamp_low("x", F.lit(d("2020-01-02"))).alias("y")), "y")
    assert got == [(None,), (d("2020-01-02"),), (d("2020-01-02"),)]


def test_checkpoint_ranges_edges_and_default(spark):
    ranges = [(d("2017-01-01"), d("2017-06-30"), d("2017-01-01")), (d("2017-07-01"), d("2017-12-31"), d("2017-07-01"))]
    df = spark.createDataFrame([(d("2016-05-01"),), (d("2017-06-30"),), (d("2017-07-01"),), (None,)], "x date")
    got = [r[0] for r in df.select(S.range_case("x", ranges, F.lit(d("2019-10-01")))).collect()]
    assert got == [d("2019-10-01"), d("2017-01-01"), d("2017-07-01"), d("2019-10-01")]


def test_nearest_snapshot_ties_and_tolerance(spark):
    rows = [(1, d("2020-01-09")), (1, d("2020-01-11")), (2, d("2020-02-10")), (3, d("2020-02-11")), (1, d("2020-03-01"))]
    df = spark.createDataFrame(rows, "id int, s date").withColumn("cp", F.lit(d("2020-01-10")))
    got = H.nearest_snapshot(df, "id", "s", "cp", 31)
    assert values(got, "id", "gap") == [(1, 1), (1, 1), (2, 31)]


def test_exit_window_and_stale_actives(spark):
    base = d("2020-01-01")
    rows = [(i, base, base + dt.timedelta(days=n)) for i, n in enumerate([-1, 0, 62, 63])] + [(9, base, None)]
    df = spark.createDataFrame(rows, "id int, s date, t date")
    assert values(Q.drop_inconsistent_exits(df, "id", "s", "t"), "id") == [(1,), (2,), (9,)]
    rows = [(1, d("2020-01-31"), 0), (2, d("2020-01-30"), 0), (3, d("2019-01-01"), 1)]
    act = spark.createDataFrame(rows, "id int, s date, churn int")
    assert values(Q.drop_stale_actives(act, "id", "s", "churn"), "id") == [(1,), (3,)]
    assert values(Q.drop_stale_actives(act, "id", "s", "churn", 1), "id") == [(1,), (2,), (3,)]


def test_duplicate_exits_multiply_rows(spark):
    p = spark.createDataFrame([(1, "a")], "id int, c string")
    e = spark.createDataFrame([(1, "x", "z"), (1, "y", "z")], "id int, r string, c string")
    got = J.left_join_keep_left(p, e, "id")
    assert got.columns == ["id", "c", "r"] and values(got, "r", "c") == [("x", "a"), ("y", "a")]


def test_patterns_are_regexes_and_the_last_wins(spark):
    df = spark.createDataFrame([("AssocX Analyst",), ("Analyst",), ("clerk",), (None,)], "t string")
    got = [r[0] for r in df.select(title_group("t")).collect()]
    assert got == ["Assoc. Analyst", "Analyst", "", ""]


def test_text_cleaning(spark):
    df = spark.createDataFrame([("3. B.A. $9",)], "t string")
    assert df.select(S.strip_digits_dots("t")).first()[0] == " BA $"
    assert spark.createDataFrame([("$12.5",)], "t string").select(S.currency_to_double("t")).first()[0] == 12.5
    df = spark.createDataFrame([("Exit > A > x",), (None,), ("none",)], "t string")
    assert [r[0] for r in df.select(S.captures_joined("t", "> (.*?) >")).collect()] == ["A", "", ""]
    df = spark.createDataFrame([("Élan a b2 x_y, C3!",), ("",)], "t string")
    assert [r[0] for r in df.select(S.tokens("t")).collect()] == [["élan", "b2", "x_y", "c3"], []]


def test_bins_and_scaling_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (50.0,), (-1.0,), (51.0,), (None,)], "x double")
    got = [r[0] for r in df.select(S.bin_right_closed("x", [0, 1, 2, 50], ["a", "b", "c"])).collect()]
    assert got == ["a", "a", "b", "c", None, None, None]
    const = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    assert values(FE.minmax_scale(const, ["x"]), "x") == [(0.0,), (0.0,)]
    assert values(FE.power_transform(const, {"x": 0.5}), "x") == [(0.0,), (0.0,)]


def test_rare_values_and_null(spark):
    df = spark.createDataFrame([(i, "big") for i in range(11)] + [(20, "tiny"), (21, None)], "id int, c string")
    got = dict(values(FE.group_rare(df, "c", "g"), "id", "g"))
    assert got[0] == "big" and got[20] == "Other" and got[21] is None


def test_one_hot_of_stated_values_and_of_any_width(spark):
    df = spark.createDataFrame([(i, f"v{i:04}") for i in range(1500)] + [(1500, None)], "id int, c string")
    flags = FE.one_hot(df, {"c": ["v0001", "v0002"]})
    assert values(flags.filter("id in (0, 1, 1500)"), "id", "c_v0001", "c_v0002") == [(0, 0, 0), (1, 1, 0), (1500, 0, 0)]
    long = values(FE.one_hot_long(df, "id", "c"), "id", "code", "flag")
    assert sorted(long) == [(i, i, 1) for i in range(1500)]


def test_quantiles_of_crowded_values_and_nan(spark):
    base = 1_700_000_000
    df = spark.range(20_000).select(
        (F.col("id") % 3).alias("g"), (F.lit(base) + F.col("id")).cast("double").alias("epoch"),
        (F.col("id") / 2e7).alias("small"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id")).alias("odd"))
    got = A.exact_quantiles(df, "epoch", [0.0, 0.5, 1.0]).collect()
    assert sorted((r["prob"], r["value"]) for r in got) == [(0.0, base), (0.5, base + 9999.5), (1.0, base + 19999.0)]
    assert A.exact_medians(df, "odd").first()[0] == 10_000.0
    assert A.exact_medians(df, "small", ["g"]).count() == 3
    counted = df.select("epoch").distinct()
    sizes = [r["count"] for r in P.range_segments(counted, "epoch", name="s").groupBy("s").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    hot = P.range_segments(df.select("g", "epoch"), "g", "epoch", name="s").groupBy("s").count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) <= 2 * 20_000 / len(hot)


def test_auc_leaves_out_unknown_scores(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.85), (1, float("nan")), (0, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert E.roc_auc(df, "y", "s").first()["auc"] == 0.75


def test_unknown_feature_values_have_a_null_bucket(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)] + [(None, 0.0), (float("nan"), 0.0)], "x double, t double")
    got = {r["bucket_x"]: r["n"] for r in E.target_by_bucket(df, ["x"], "t", 5).collect()}
    assert got[None] == 2 and -1 not in got


def test_null_labels_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "id int, y int")
    assert SP.split_stratified(df, "id", "y", 5).count() == 40
    assert SP.with_class_weights(df, "y").count() == 40
    assert SP.undersample(df, "id", "y", 1, 5, 0.8).filter("y is null or y = 0").count() == 20


def test_hot_partition_value_is_written_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(FILES, "FILE_ROWS", 100)
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small slices share a task
    FILES.write_partitioned(df, str(tmp_path / "t"), ["p"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "t" / "p=hot").glob("part-*"))) > 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000


def test_hash_digits_follow_the_rows():
    assert [P.hash_digits(n) for n in (0, 50_000, 800_001, 10**12)] == [1, 1, 2, 7]


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        get = lambda self, k, d=None: dict.get(self, k, d)

    class Context:
        master, folder = "spark://host:7077", None
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: self.folder

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session)
    Session.sparkContext.folder = "hdfs://store/shared/"
    assert shared_dir(Session) == "hdfs://store/shared"


def test_shift_by_zero_and_label_codes(spark):
    df = spark.createDataFrame([(d("2020-01-01"), 1.0), (d("2020-02-01"), 2.0), (d("2020-03-05"), 3.0)], "day date, v double")
    got = P.shift_rows(df, "day", S.month_index("day"), {"a": "v", "b": "v", "c": "v"}, {"a": 0, "b": 1, "c": -1})
    assert values(got, "day", "a", "b", "c") == [
        (d("2020-01-01"), 1.0, None, 2.0), (d("2020-02-01"), 2.0, 1.0, 3.0), (d("2020-03-05"), 3.0, 2.0, None)]
    lab = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert values(FE.label_encode(lab, "c", "k"), "c", "k") == [("a", 0), ("b", 1), ("b", 1), (None, None)]


def test_sentinels_and_fills(spark):
    df = spark.createDataFrame([(1, "0", None), (2, None, 1), (3, "x", 2)], "id int, c string, n int")
    assert values(SEL.drop_sentinels(df, {"c": ["0"]}), "id") == [(2,), (3,)]
    assert values(SEL.fill_all_zero(df), "c", "n") == [("0", 0), ("0", 1), ("x", 2)]


def test_rating_lists(spark):
    main = spark.createDataFrame([("a", 2017, "1A"), ("b", 2017, "joined"), ("c", 2017, None)], "id string, y int, r string")
    w = lookups.WideRatings(
        spark.createDataFrame([("d", "2a", "1B"), ("e", None, "1B"), ("f", "0", "1B")], "k string, y7 string, y8 string"),
        "k", {2017: "y7", 2018: "y8"}, drop_rows={"y7": ["0"]}, fixes={"y7": [("2a", "2A")]})
    got = lookups.ratings_of_year(main, [w], "id", "y", "r", 2017)
    assert values(got, "id", "rating") == [("a", "1A"), ("c", None), ("d", "2A")]


def test_sweep_without_predictions_and_auc_of_one_class(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.29), (0, 0.29)], "y int, p double")
    got = {round(r["threshold"], 2): r for r in E.threshold_sweep(df, "y", "p").collect()}
    assert len(got) == 60 and got[0.3]["precision_1"] is None and got[0.29]["precision_1"] == 0.5
    assert got[0.29]["recall_1"] == 1.0 and got[0.79]["recall_0"] == 1.0
    assert E.roc_auc(df.filter("y = 0"), "y", "p").first()[0] is None
