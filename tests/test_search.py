"""Search, graph, resampling and models against brute force and invariants."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.functions import scalars as S
from panelworks.operators import aggregate as A
from panelworks.operators import blocks, evaluate, features, graph, interpret, models, nearest, position, similarity, split
from panelworks.operators import text as TX
from panelworks.plans import recommend, snapshots


@pytest.fixture()
def tiny_cells(monkeypatch):
    """Many pivots and cells even on small data."""
    monkeypatch.setattr(nearest, "ROWS_PER_PIVOT", 10)
    monkeypatch.setattr(nearest, "CELL_ROWS", 7)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 4)


def cloud(n, width, copies=0, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    v = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, width))
    for i in range(copies):
        v[n - 1 - i] = v[0]
    return v


def frame(spark, v, extra=None):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(4)


def cosines(v):
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    return u @ u.T


def with_copies(pairs, rows_equal, ids):
    """Brute-force pairs reduced to representatives plus links, as the operators define them."""
    rep = {i: min(j for j in ids if rows_equal(i, j)) for i in ids}
    kept = {(a, b) for a, b in pairs if rep[a] == a and rep[b] == b}
    return kept | {(rep[i], i) for i in ids if rep[i] != i}


def test_dense_pairs(spark, tiny_cells):
    v = cloud(90, 5, copies=30)
    v[3] = 0
    s = cosines(v)
    ids = [i for i in range(90) if i != 3]
    want = {(a, b) for a, b in itertools.combinations(ids, 2) if s[a, b] > 0.9}
    want = with_copies(want, lambda a, b: np.array_equal(v[a], v[b]), ids)
    got = nearest.dense_pairs(frame(spark, v), "id", "v", 0.9).collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want)
    assert all(abs(r.sim - s[r.src, r.dst]) < 1e-9 for r in got)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_neighbours_with_copies(spark, tiny_cells, metric):
    v = cloud(80, 4, copies=27, seed=2)
    if metric == "cosine":
        v[5] = 0
        score = cosines(v)
    else:
        score = -np.linalg.norm(v[:, None, :] - v[None, :, :], axis=2)
    k = 4
    got = {}
    for r in nearest.nearest_neighbours(frame(spark, v), "id", "v", k, metric).collect():
        got.setdefault(r.src, {})[r["rank"]] = (r.dst, r.score)
    assert set(got) == set(range(80))
    for i in range(80):
        order = sorted((j for j in range(80) if j != i), key=lambda j: (-round(score[i, j], 7), j))
        mine = [round(got[i][r][1], 6) for r in sorted(got[i])]
        assert mine == pytest.approx([round(score[i, j], 6) for j in order[:k]], abs=2e-6)
        assert len({d for d, _ in got[i].values()}) == k and i not in {d for d, _ in got[i].values()}
    assert [got[79][r][0] for r in (1, 2, 3, 4)] == [0, 53, 54, 55]  # copies: smallest ids first


def bags(n, seed, copies=0):
    rng = random.Random(seed)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 60:02d}" for _ in range(rng.randint(3, 14))) for _ in range(n)]
    near = texts[0] + " zz"
    return texts + [texts[0]] * copies + [f"{near}{i}" for i in range(copies)]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85])
def test_sparse_pairs_equal_brute_force(spark, tiny_cells, threshold):
    texts = bags(50, 3, copies=8)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    vec = TX.tfidf(TX.term_counts(docs, "id", "t"), "id")
    dense = {}
    for r in vec.collect():
        dense.setdefault(r.id, {})[r.term] = r.w
    ids = sorted(dense)
    for i in ids:
        assert sum(x * x for x in dense[i].values()) == pytest.approx(1.0)
    dot = lambda a, b: sum(x * dense[b].get(t, 0.0) for t, x in dense[a].items())
    same = lambda a, b: sorted(texts[a].split()) == sorted(texts[b].split())
    want = with_copies({p for p in itertools.combinations(ids, 2) if dot(*p) > threshold}, same, ids)
    got = similarity.sparse_pairs(vec, "id", threshold).collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want)


def test_numbers_join_the_text_rows(spark):
    docs = spark.createDataFrame([(1, "aa bb", 0.0), (2, "aa bb", 10.0), (3, "cc dd", 10.0)], "id long, t string, n double")
    vec = TX.append_numbers(TX.tfidf(TX.term_counts(docs, "id", "t"), "id"), docs, "id", ["n"])
    got = {(r.src, r.dst): r.sim for r in similarity.sparse_pairs(vec, "id", 0.4).collect()}
    assert set(got) == {(1, 2), (2, 3)}
    assert got[(1, 2)] == pytest.approx(1 / math.sqrt(2)) and got[(2, 3)] == pytest.approx(0.5)


def test_month_snapshots_match_single_cuts(spark):
    import datetime as dt

    rng = random.Random(5)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 150))
    panel = [(e, day(), k, rng.choice(["red", "blue"]), rng.random()) for k, e in enumerate(list(range(12)) * 3)]
    events = [(rng.randrange(12), day(), f"t{rng.randrange(9)}") for _ in range(150)]
    p = spark.createDataFrame(panel, "id long, day date, k long, w string, x double")
    ev = spark.createDataFrame(events, "id long, day date, term string")
    lo, hi = "2020-02-01", "2020-05-01"
    latest = snapshots.latest_by_month(p, "id", "day", "k", ["w", "x"], lo, hi)
    hist = snapshots.history_by_month(ev, "id", "day", "term", lo, hi)
    for m in range(2, 6):
        snap = dt.date(2020, m, 1)
        last = {}
        for e, d_, k, w, x in sorted(panel, key=lambda r: (r[1], r[2])):
            if d_ <= snap:
                last[e] = (w, x)
        got = {r.id: (r.w, r.x) for r in latest.filter(F.col("snap_date") == snap).collect()}
        assert got == last
        seen = {}
        for e, d_, t in events:
            if d_ < snap:
                seen[(e, t)] = seen.get((e, t), 0) + 1
        assert {(r.id, r.term): r.tf for r in hist.filter(F.col("snap_date") == snap).collect()} == seen
    both = snapshots.similarity_by_month(latest, hist, "id", "w", ["x"], 0.6)
    cut = F.col("snap_date") == dt.date(2020, 4, 1)
    one = snapshots.similarity_by_month(latest.filter(cut), hist.filter(cut), "id", "w", ["x"], 0.6)
    as_set = lambda df: {(r.src, r.dst, round(r.sim, 9)) for r in df.collect()}
    assert as_set(both.filter(cut)) == as_set(one) != set()


def test_overlap_graph_equals_plain_pairs(spark, tiny_cells):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice(["x", None]), rng.randrange(3)) for i in range(60)]
    names = ["p", "q", "r"]
    df = spark.createDataFrame(rows, "id long, p string, q string, r int")
    plain, rep = {}, {}
    for i, *attrs in rows:
        rep.setdefault(tuple(attrs), i)
    hist = {}
    for a, b in itertools.combinations(rows, 2):
        flags = tuple(int(x == y) for x, y in zip(a[1:], b[1:]))
        hist[sum(flags)] = hist.get(sum(flags), 0) + 1
        if sum(flags) >= 2:
            e = tuple(sorted((rep[tuple(a[1:])], rep[tuple(b[1:])]))) + flags
            plain[e] = plain.get(e, 0) + 1
    got = graph.overlap_edges(df, "id", names, 2).collect()
    assert {(r.src, r.dst, r.same_p, r.same_q, r.same_r): r.n_pairs for r in got} == plain
    assert {r.weight: r.n for r in graph.edge_weight_histogram(df, "id", names).collect()} == hist


def test_pair_ranges_stand_for_all_pairs(spark):
    df = spark.createDataFrame([(i,) for i in (3, 1, 9, 4, 4)], "id long")
    got = {r.id: (r.pos, r.n_partners) for r in graph.pair_ranges(df, "id").collect()}
    assert got == {1: (1, 3), 3: (2, 2), 4: (3, 1), 9: (4, 0)}


def test_graph_keeps_isolated_nodes_and_limits_samples(spark):
    nodes = spark.createDataFrame([(i, float(i)) for i in range(30)], "id long, x double")
    edges = spark.createDataFrame([(0, i) for i in range(1, 28)] + [(5, 0)], "src long, dst long")
    assert graph.graph_counts(nodes, edges, "id").first().asDict() == {"n_nodes": 30, "n_edges": 27}
    deg = {r.id: r.degree for r in graph.node_degree(nodes, edges, "id").collect()}
    assert deg[0] == 27 and deg[29] == 0
    hub = graph.sample_neighbours(edges, 20, 1).filter("src = 0").collect()
    assert len({r.dst for r in hub}) == 20
    m = {r.id: r for r in graph.neighbour_means(nodes, edges, "id", ["x"]).collect()}
    assert m[29].x_hop1 == 0.0 and m[1].x_hop1 == 0.0 and m[0].x_hop1 > 0


def test_quantiles_exact_under_skew_and_by_group(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([np.full(400, 3.0), rng.normal(0, 1e4, 300), rng.random(300) * 1e-3, [-5.0, 0.0]])
    g = np.where(np.arange(len(v)) % 3 == 0, "a", "b")
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, v)], "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["value"] for r in A.exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(v, p), abs=1e-9)
    med = {r.g: r.median for r in A.exact_medians(df, "v", ["g"]).collect()}
    for k in "ab":
        assert med[k] == pytest.approx(np.median(v[g == k]), abs=1e-9)


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    a = position.with_hash_rank(df, "id", 9, ["g"]).collect()
    b = position.with_hash_rank(df.repartition(7), "id", 9, ["g"]).collect()
    assert {(r.id, r["rank"]) for r in a} == {(r.id, r["rank"]) for r in b}
    assert sorted(r["rank"] for r in a if r.g == 1) == list(range(1, 168))


def test_yeo_johnson_fit_finds_the_likelihood_maximum(spark):
    x = np.random.default_rng(3).gamma(2.0, 2.0, 800) - 1.0
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = features.yeo_johnson_fit(df, ["x"])["x"]

    def loglik(l):
        up, down = x >= 0, x < 0
        y = np.empty_like(x)
        y[up] = ((x[up] + 1) ** l - 1) / l if l else np.log1p(x[up])
        y[down] = -((1 - x[down]) ** (2 - l) - 1) / (2 - l) if l != 2 else -np.log1p(-x[down])
        return -len(x) / 2 * np.log(y.var()) + (l - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

    grid = np.arange(-2, 4, 0.001)
    best = grid[np.argmax([loglik(l) for l in grid])]
    assert lam == pytest.approx(best, abs=0.002)
    z = [r.x for r in features.power_transform(df, {"x": lam}).collect()]
    assert np.mean(z) == pytest.approx(0, abs=1e-9) and np.std(z) == pytest.approx(1)


def test_recommendations_filter_after_the_cut(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.1], [1.0, 0.3], [0.0, 1.0], [0.0, 0.0]]
    df = frame(spark, v)
    top = recommend.topk_similar(df, "id", "v", 0, 3).collect()
    assert [r.id for r in top] == [1, 2, 3] and top[0].sim == pytest.approx(1.0)
    info = df.select("id", (F.col("id") == 2).cast("int").alias("churn"))
    got = recommend.recommend_active(df, info, "id", "v", 0, 3, "churn", []).collect()
    assert [r.id for r in got] == [1, 3]
    assert recommend.topk_similar(df, "id", "v", 99, 3).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    v = cloud(160, 3, seed=11)
    y = (v[:, 0] > np.quantile(v[:, 0], 0.7)).astype(int)
    rows = [(i, [float(a) for a in x], int(l)) for i, (x, l) in enumerate(zip(v, y))]
    return spark.createDataFrame(rows, "id long, v array<double>, y int")


def test_splits_are_disjoint_complete_and_sized(labelled):
    s = split.split_stratified(labelled, "id", "y", 1).groupBy("y", "split").count().collect()
    n = {(r.y, r.split): r["count"] for r in s}
    for y in (0, 1):
        assert n[(y, "test")] == round(0.2 * (n[(y, "test")] + n[(y, "train")]))
    f = split.kfold_assign(labelled, "id", "y", 1)
    assert f.count() == 160 and f.select("fold").distinct().count() == 5
    u = {r.y: r["count"] for r in split.undersample(labelled, "id", "y", 1, 3).groupBy("y").count().collect()}
    assert u[1] == 48 and u[0] == 60
    w = {r.y: r.weight for r in split.class_weights(labelled, "y").collect()}
    assert w[1] == pytest.approx(160 / (2 * 48))


def test_adasyn_rows_lie_between_minority_rows(labelled):
    plan = {r.id: r.g for r in split.adasyn_allocation(labelled, "id", "v", "y", 1).collect()}
    rows = split.adasyn_rows(labelled, "id", "v", "y", 1, 5).collect()
    assert len(rows) == sum(plan.values()) > 0
    small = np.array([r.v for r in labelled.filter("y = 1").collect()])
    made = np.array([r.v for r in rows])
    assert (made >= small.min(0) - 1e-9).all() and (made <= small.max(0) + 1e-9).all()
    again = split.adasyn_rows(labelled.repartition(5), "id", "v", "y", 1, 5).collect()
    assert {(r.parent, r.j, tuple(r.v)) for r in rows} == {(r.parent, r.j, tuple(r.v)) for r in again}


def test_models_reach_a_floor_and_explain_the_right_feature(labelled):
    model = models.fit_forest(labelled, "v", "y", trees=15, depth=4, per_split="all")
    out = models.score(model, labelled, "v")
    assert out.filter("p < 0 or p > 1").count() == 0 and out.count() == 160
    assert evaluate.accuracy(out, "y", "cls").first()[0] > 0.95
    assert evaluate.roc_auc(out, "y", "p").first()[0] > 0.97
    drops = {r.feature: r["drop"] for r in interpret.permutation_importance(model, labelled, "id", "v", "y", [0, 1, 2], 3).collect()}
    assert max(drops, key=drops.get) == 0 and drops[0] > 0.1
    imp = {r.feature: r.importance for r in interpret.tree_importance(model, labelled, ["a", "b", "c"]).collect()}
    assert max(imp, key=imp.get) == "a" and sum(imp.values()) == pytest.approx(1)
    pd_ = interpret.partial_dependence(model, labelled, "id", "v", [0]).orderBy("value_0").collect()
    assert len(pd_) == 10 and pd_[0].p < 0.3 < 0.6 < pd_[-1].p and {r.n for r in pd_} == {160}
    assert interpret.partial_dependence(model, labelled, "id", "v", [0, 1], points=4).count() == 16
    folds = split.kfold_assign(labelled, "id", "y", 2)
    cv = models.cross_validate(folds, "fold", 5, lambda t: models.fit_logistic(t, "v", "y"), "v")
    assert cv.count() == 160 and evaluate.accuracy(cv, "y", "cls").first()[0] > 0.85


def test_boosted_regression(labelled):
    df = labelled.withColumn("t", F.get("v", F.lit(0)) * 3)
    out = models.predict(models.fit_boosted(df, "v", "t"), df, "v")
    assert evaluate.rmse(out, "t", "prediction").first()[0] < 1.0


def test_token_vocabulary(spark):
    d = spark.createDataFrame([(1, "Ab ab c cd"), (2, "cd"), (3, "")], "id long, t string")
    c = TX.term_counts(d, "id", "t")
    assert {(r.term, r.df) for r in TX.vocabulary(c).collect()} == {("ab", 1), ("cd", 2)}
    n = 2  # documents with tokens
    w = {(r.id, r.term): r.w for r in TX.tfidf(c, "id").collect()}
    raw = {"ab": 2 * (math.log((1 + n) / 2) + 1), "cd": math.log((1 + n) / 3) + 1}
    assert w[(1, "ab")] == pytest.approx(raw["ab"] / math.hypot(*raw.values())) and w[(2, "cd")] == pytest.approx(1)
    assert S.has_token("t") is not None


def test_degrees_count_every_copy(spark):
    """Against all pairs: groups of 1, 3 and 50 equal vectors, some near another, one zero vector."""
    base = [([1.0, 0.0, 0.0], 3), ([1.0, 0.1, 0.0], 1), ([0.0, 1.0, 0.0], 50), ([0.1, 1.0, 0.2], 2), ([0.0, 0.0, 2.0], 1), ([0.0, 0.0, 0.0], 2)]
    rows = [(i, v) for i, v in enumerate(v for v, n in base for _ in range(n))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    edges, members = nearest.dense_pairs(df, "id", "v", 0.8, links=False), nearest.vector_members(df, "id", "v")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = {i: 0 for i, _ in rows}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if cosine(a, b) > 0.8:
            want[i] += 1
            want[j] += 1
    assert {r["id"]: r["degree"] for r in graph.grouped_degree(df, edges, members, "id").collect()} == want
    assert graph.grouped_counts(df, edges, members, "id").first().asDict() == {"n_nodes": len(rows), "n_edges": sum(want.values()) // 2}


@pytest.mark.parametrize("cells", [(1024, 256), (4, 3)])
def test_samples_take_every_copy(spark, monkeypatch, cells):
    """Against all pairs: groups of 1 to 50 equal vectors, some near another, in one list and in many."""
    monkeypatch.setattr(graph, "LIST_IDS", cells[0])
    monkeypatch.setattr(graph, "SOURCE_ROWS", cells[1])
    base = [([1.0, 0.0, 0.0], 3), ([1.0, 0.1, 0.0], 1), ([0.0, 1.0, 0.0], 50), ([0.1, 1.0, 0.2], 7), ([0.1, 1.0, 0.3], 1),
            ([0.0, 0.0, 2.0], 1), ([0.0, 0.0, 0.0], 2)]
    rows = [(i, v) for i, v in enumerate(v for v, n in base for _ in range(n))]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    edges, members = nearest.dense_pairs(df, "id", "v", 0.8, links=False), nearest.vector_members(df, "id", "v")
    s = cosines(np.array([v for _, v in sorted(rows)]))
    near = {i: [j for j in range(len(rows)) if j != i and s[i, j] > 0.8] for i in range(len(rows))}

    def sample(k, seed):
        def rank(i, j):
            return hashlib.md5(f"{i}-{j}:{seed}".encode()).hexdigest(), j

        return {i: sorted(n, key=lambda j: rank(i, j))[:k] for i, n in near.items()}

    one, two = sample(20, 1), sample(10, 2)
    got = sorted(map(tuple, graph.two_hop_sample(edges, members=members).collect()))
    assert got == sorted((i, j, k) for i in one for j in one[i] for k in two[j])
    nodes = df.select("id", F.col("id").cast("double").alias("x"))
    for m in graph.neighbour_means(nodes, edges, "id", ["x"], members=members).collect():
        mean = [sum(two[j]) / len(two[j]) for j in one[m.id]]
        assert m.x_hop1 == pytest.approx(np.mean(one[m.id]) if one[m.id] else 0)
        assert m.x_hop2 == pytest.approx(np.mean(mean) if mean else 0)
