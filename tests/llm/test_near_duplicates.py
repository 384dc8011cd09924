"""Parity join, line runs and containment search against brute force and SQL."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import LONG, empty_documents, odd_documents, prose

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

from panelworks.llm import decontaminate, line_dedup, parity_join  # noqa: E402
from panelworks.llm.components import components  # noqa: E402
from panelworks.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from panelworks.workload.registry import Query  # noqa: E402

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    inverted = {}
    for i, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverted[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(parent, i), root(parent, j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(parent, i)) for i, s in sets.items()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    assert oracle.compare(spark, oracle.duck(SF), SF, Query(name, QUERIES[name], ORACLE_SQL[name])) is None


def crowded_rows():
    """A large group of near copies, a passage in many short texts, tiny sets, pairs at the limit."""
    draw, vocabulary = random.Random(4), [f"w{i}" for i in range(3000)]
    base, passage = draw.choices(vocabulary, k=120), draw.choices(vocabulary, k=50)
    texts = []
    for _ in range(120):
        copy = list(base)
        for k in draw.choices(range(120), k=draw.randrange(5)):
            copy[k] = draw.choice(vocabulary)
        texts.append(copy)
    texts += [passage + draw.choices(vocabulary, k=draw.randrange(40)) for _ in range(120)]
    texts += [draw.choices(vocabulary[:3], k=draw.randrange(14)) for _ in range(120)]
    for _ in range(100):
        one = draw.choices(vocabulary[:40], k=draw.randrange(4, 20))
        texts += [one, one[:-1] + ["zz"]]
    long = draw.choices(vocabulary, k=6000)
    texts += [long, long[:5600], long[300:], long[:3000] + draw.choices(vocabulary, k=3000)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_parity_join_loses_no_link(spark):
    rows = crowded_rows()
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_components(rows)


def test_long_near_copies_without_a_common_hub(spark, monkeypatch):
    """A ring of long texts, each near its neighbours only, with one passage in all; small buckets and cells."""
    draw, vocabulary = random.Random(6), [f"w{i}" for i in range(5000)]
    passage, ring = draw.choices(vocabulary, k=60), draw.choices(vocabulary, k=4000)
    rows = [(1000 + i, " ".join(passage + [ring[(40 * i + k) % 4000] for k in range(900)])) for i in range(100)]
    rows += [(i, " ".join(draw.choices(vocabulary, k=900) + passage)) for i in range(40)]
    draw.shuffle(rows)
    monkeypatch.setattr(parity_join, "HELD", 500)
    monkeypatch.setattr(parity_join, "CELL_BYTES", 1 << 17)
    monkeypatch.setattr(parity_join, "CELL_ROWS", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r[0]: (r[1], r[2]) for r in parity_join.jaccard_components(df).collect()}
    assert found == brute_components(rows)
    assert {c for i, (_, c) in found.items() if i >= 1000} == {1000}
    # as a spanning forest: cells alone link them all, with fewer links than rows
    sets = [np.unique(np.fromiter((hash(x) & (2**63 - 1) for x in shingles(t)), np.uint64)) for _, t in rows]
    ids, n = np.array([i for i, _ in rows]), len(rows)
    both = {"rep": np.tile(ids, 2), "component": np.tile(ids, 2), "left": np.repeat([True, False], n), "top": np.zeros(2 * n, bool), "members": [x.tobytes() for x in sets] * 2}
    links = list(parity_join._Cell([both], 75).links())
    assert len(links) == 99 and components(spark.createDataFrame(links, "src long, dst long")).select("component").distinct().count() == 1


def test_low_limits_use_all_bands(spark):
    draw, vocabulary = random.Random(9), [f"w{i}" for i in range(400)]
    base = draw.choices(vocabulary, k=60)
    rows = [(i, " ".join(base[: 30 + i] + draw.choices(vocabulary, k=draw.randrange(40)))) for i in range(30)]
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=25).collect()
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i, j in ((i, j) for i, _ in rows for j, _ in rows if j < i):
        if 100 * len(sets[i] & sets[j]) >= 25 * len(sets[i] | sets[j]):
            a, b = root(parent, i), root(parent, j)
            parent[max(a, b)] = min(a, b)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: root(parent, i) for i, _ in rows}


def test_parity_join_of_odd_rows(spark):
    docs = odd_documents(spark, clashing=True)
    got = sorted(map(tuple, parity_join.jaccard_components(docs).collect()), key=repr)
    n_long = len(shingles(LONG))
    assert got == sorted([
        (None, 6, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 4, 5), (5, 4, 5), (6, 1, 6), (7, n_long, 7),
        (8, 11, 8), (9, 11, 8), (10, 2, 10)], key=repr)
    assert parity_join.jaccard_components(empty_documents(spark)).count() == 0
    # a repeated id with two texts is one document, so it joins their classes
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (2, a), (2, b), (3, b)]
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_sketch_distance_never_exceeds_the_difference():
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 2**63, 5000, dtype=np.uint64)
    for n, m in [(5, 9), (300, 320), (3000, 200), (0, 4)]:
        a, b = np.unique(draw.choice(pool, n)), np.unique(draw.choice(pool, m))
        x, y = (parity_join._sketches(s, np.array([0, len(s)]))[0] for s in (a, b))
        assert parity_join.sketch_distance(x, y) <= len(np.setxor1d(a, b))


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = chain + star + [(200, 200), (None, 5), (159, 158)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def brute_runs(rows, least):
    """Lines of windows of at least ``least`` words that occur earlier."""
    seen, gone = set(), set()
    for i, text in rows:
        lines = text.split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(lines[a : b + 1])
                if sum(len(words(x)) for x in run) >= least:
                    if run in seen:
                        gone |= {(i, k) for k in range(a, b + 1)}
                    seen.add(run)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_line_runs_equal_brute_force(spark):
    draw = random.Random(8)
    lines = [prose(i, draw.randrange(0, 9)) for i in range(12)] + [""]
    rows = [(i, "\n".join(draw.choices(lines, k=draw.randrange(1, 14)))) for i in range(60)]
    block = [prose(900 + i, 3) for i in range(40)]  # a long run, several doublings deep
    rows += [(60, "\n".join(block)), (61, "\n".join(["x", *block[5:38], "y"])), (62, "\n".join(block[::-1]))]
    got = line_dedup.delete_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_words=12)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_runs(rows, 12)


def test_line_runs_of_odd_rows(spark):
    docs = odd_documents(spark, clashing=True)
    got = line_dedup.delete_repeated_runs(docs, min_words=10)
    assert set(got.columns) == set(docs.columns)
    rows = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert got.count() == docs.count()
    assert rows[9]["text"] == "" and rows[9]["n_deleted"] == rows[9]["n_lines"] == 2 and rows[8]["n_deleted"] == 0
    assert rows[1]["text"] is None and rows[1]["n_lines"] == 0 and rows[2]["n_lines"] == 1
    assert got.filter("doc_id = 5 and n_deleted = 0").count() == 2  # rows that repeat id and text are one document
    assert line_dedup.delete_repeated_runs(empty_documents(spark)).count() == 0


def brute_leaks(docs, items):
    out = set()
    for i, text in docs:
        s = shingles(text)
        for k, item in items:
            q = shingles(item)
            if q and 100 * len(q & s) >= 75 * len(q):
                out.add((i, k, len(q), len(q & s)))
    return out


def test_containment_equals_brute_force(spark):
    draw = random.Random(6)
    items = [(i, prose(50 + i, n)) for i, n in enumerate([3, 5, 6, 9, 12, 20, 33, 40, 64, 150, 400])] + [(90, None), (91, ""), (92, "a b")]
    items += [(93, items[5][1]), (93, items[5][1])]
    docs = [(1000, None), (1001, ""), (1002, "A  B"), (1003, LONG)]
    for d in range(150):
        _, item = draw.choice(items[:11])
        w = item.split()
        for k in draw.sample(range(len(w)), k=min(len(w), draw.randrange(3))):
            w[k] = "changed"
        around = prose(500 + d, draw.choice([0, 3, 30, 2000])).split()
        at = draw.randrange(len(around) + 1)
        docs.append((d, " ".join(around[:at] + w + around[at:])))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("mine"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit("mine"))
    got = [(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.find_items(d, b).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items)
    clean = {r["doc_id"] for r in decontaminate.clean_documents(d, b).collect()}
    assert clean == {i for i, _ in docs} - {g[0] for g in got}


def test_containment_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = odd_documents(spark, clashing=True)
    assert decontaminate.find_items(docs, none).count() == 0
    assert decontaminate.clean_documents(docs, none).count() == docs.count()
    assert decontaminate.find_items(empty_documents(spark), spark.createDataFrame([(1, "a b c d e f")], none.schema)).count() == 0
