"""The k best of sparse rows against plain dot products, and the queries on top of them."""

import math
import random
from collections import defaultdict

import pytest

from panelworks.operators.topk import sparse_topk
from panelworks.workload.catalog import load

SCHEMA = "month string, id long, term string, w double"


def unit(row):
    n = math.sqrt(sum(w * w for w in row.values()))
    return {t: w / n for t, w in row.items()}


def brute(rows, k):
    groups = defaultdict(dict)
    for m, i, row in rows:
        groups[m][i] = row
    out = {}
    for m, members in groups.items():
        for i, a in members.items():
            sims = [(round(sum(w * b.get(t, 0.0) for t, w in a.items()), 9), j) for j, b in members.items() if j != i]
            for rank, (s, j) in enumerate(sorted((x for x in sims if x[0] > 0), key=lambda x: (-x[0], x[1]))[:k], 1):
                out[m, i, rank] = (j, round(s, 6))
    return out


def found(spark, rows, k, **sizes):
    flat = [(m, i, t, w) for m, i, row in rows for t, w in row.items()]
    got = sparse_topk(spark.createDataFrame(flat, SCHEMA), "id", k, ["month"], **sizes)
    return {(r["month"], r["src"], r["rank"]): (r["dst"], round(r["sim"], 6)) for r in got.collect()}


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "cell_blocks": 2}])
def test_equals_plain_products(spark, sizes):
    draw, rows = random.Random(3), []
    for m in ("a", "b"):
        for i in range(120):
            row = {f"t{draw.randrange(30)}": draw.choice([0.5, 1.0, 2.0]) for _ in range(draw.randint(1, 6))}
            rows.append((m, i, unit(row | {"#n": draw.random() + 0.1} if i % 10 else row)))
        rows += [(m, 1000 + i, unit({"same": 1.0, "t1": 1.0})) for i in range(60)]  # a group of copies
        rows += [(m, 2000 + i, unit({"t2": 1.0})) for i in range(3)] + [(m, 3000, {"alone": 1.0})]
    for k in (1, 5):
        assert found(spark, rows, k, **sizes) == brute(rows, k)


def test_more_than_there_are_and_empty(spark):
    rows = [("a", i, unit({"x": 1.0, f"y{i}": float(i + 1)})) for i in range(4)]
    assert found(spark, rows, 10) == brute(rows, 10)
    empty = spark.createDataFrame([(None, None, None, None), ("a", 1, "x", None)], SCHEMA)
    assert sparse_topk(empty, "id", 3, ["month"]).collect() == []


def test_months_equal_plain_products(spark):
    """Every month of the smallest tables, from its own vectors."""
    from panelworks.workload import snapshots

    sf = "/root/testdata/sf0.001"
    rows = defaultdict(dict)
    for r in snapshots.month_vectors(spark, sf).collect():
        rows[str(r["snap_date"]), r["entity_id"]][r["term"]] = r["w"]
    months = sorted({m for m, _ in rows})
    some = {months[0], months[len(months) // 2], months[-1]}
    want = brute([(m, i, row) for (m, i), row in rows.items() if m in some], snapshots.MONTH_BEST)
    got = {(r["snap_date"], r["src"], r["rank"]): (r["dst"], r["sim"]) for r in load()["similarity_all_months"].run(spark, sf).collect()}
    assert {m for m, _, _ in got} == {m for m in months if sum(x == m for x, _ in rows) > 1}
    assert {x: v for x, v in got.items() if x[0] in some} == want


def test_mutual_edges_need_both_sides(spark):
    from panelworks.operators.graph import graph_counts, mutual_edges, node_degree

    rng = random.Random(3)
    near = [(i, j, 0.4 + 0.6 * ((i * j) % 7) / 7) for i in range(40) for j in rng.sample([x for x in range(40) if x != i], 5)]
    odd = [(None, 1, 0.9), (1, None, 0.9), (2, 2, 0.9), (50, 51, None), (51, 50, 0.9)]
    listed = {(a, b) for a, b, s in near if s > 0.5}
    want = {(a, b) for a, b in listed if a < b and (b, a) in listed}
    assert want
    edges = mutual_edges(spark.createDataFrame(near + odd, "src long, dst long, sim double"), 0.5)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == want
    nodes = spark.range(40)
    degree = {r["id"]: r["degree"] for r in node_degree(nodes, edges, "id").collect()}
    assert degree == {i: sum(i in e for e in want) for i in range(40)}
    assert graph_counts(nodes, edges, "id").first()["n_edges"] == len(want)
    none = spark.createDataFrame([], "src long, dst long, sim double")
    assert mutual_edges(none, 0.5).collect() == []
