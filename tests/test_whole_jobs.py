"""Queries that hold the whole job where an older one holds a part of it."""

import datetime as dt
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.workload import views as V
from panelworks.workload.catalog import load

SF = "/root/testdata/sf0.001"


def test_sparse_edges_hold_pairs_between_the_thresholds(spark):
    edges = load()["cosine_sparse_edges"].run(spark, SF).cache()
    low = {r["sim"] for r in edges.filter("sim <= 0.8").collect()}
    assert low and min(low) > 0.5
    high = {(r["src"], r["dst"], r["sim"]) for r in edges.filter("sim > 0.8").collect()}
    assert high == set(map(tuple, load()["cosine_sparse_pairs"].run(spark, SF).select("src", "dst", "sim").collect()))


def month_pairs(panel, bought, snap):
    """Brute force: {(src, dst): cosine} above 0.2."""
    past = defaultdict(list)
    for r in sorted(panel, key=lambda r: (r["snap_date"], r["row_key"])):
        if r["snap_date"] <= snap:
            past[r["entity_id"]].append(r)
    terms = {e: Counter([rs[-1]["unit"].lower(), rs[-1]["level"].lower()]) for e, rs in past.items()}
    for e, day, term in bought:
        if day < snap and e in terms:
            terms[e][term] += 1
    ids = sorted(past)
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in terms.values() for t in c}))}
    df = Counter(t for c in terms.values() for t in c)
    x = np.zeros((len(ids), len(vocabulary)))
    for i, e in enumerate(ids):
        for t, n in terms[e].items():
            x[i, vocabulary[t]] = n * (math.log((1 + len(ids)) / (1 + df[t])) + 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    columns = ["level", "function", "band", "unit", "manager_id"]
    n = np.array([[float(past[e][-1][c]) for c in ("band", "amount", "balance")] + [len({r[c] for r in past[e]}) for c in columns]
                  + [(snap - past[e][0]["snap_date"]).days] for e in ids])
    span = n.max(axis=0) - n.min(axis=0)
    x = np.hstack([x, (n - n.min(axis=0)) / np.where(span > 0, span, 1)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return {(ids[i], ids[j]): s[i, j] for i in range(len(ids)) for j in range(i + 1, len(ids)) if s[i, j] > 0.2}


def test_similarity_of_all_months(spark):
    panel = V.panel(spark, SF).collect()
    months = {r["snap_date"].replace(day=1) for r in panel}
    from panelworks.workload.snapshots import _bought

    bought = list(map(tuple, _bought(spark, SF).collect()))
    pairs = load()["similarity_all_months"].run(spark, SF)
    found = {r[0] for r in pairs.select("snap_date").distinct().collect()}
    assert len(months) > 70 and {str(m) for m in months} - found <= {str(m) for m in sorted(months)[:2]}
    for snap in (sorted(months)[3], sorted(months)[40], max(months)):
        got = {(r["src"], r["dst"]): r["sim"] for r in pairs.filter(F.col("snap_date") == str(snap)).collect()}
        want = month_pairs(panel, bought, snap)
        assert got.keys() == want.keys() and isinstance(snap, dt.date)
        assert max(abs(got[k] - want[k]) for k in want) == pytest.approx(0, abs=1e-5)
