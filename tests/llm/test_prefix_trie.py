"""The prefix trie against a plain one over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import oracle
import pytest

from panelworks.llm import prefix_trie as pt
from panelworks.llm.queries import ORACLE_SQL, QUERIES
from panelworks.llm.radix import LARGE, MEDIUM, SMALL, RadixTree

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), sum(q not in kids or not kids[q] for q in below), saved, digest))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_layouts_grow_and_paths_split():
    draw = random.Random(1)
    keys = [bytes([draw.randrange(256) for _ in range(4 * draw.randint(1, 3))]) for _ in range(600)]
    keys += [k[:4] for k in keys[:50]] + [k[:7] + b"x" + k for k in keys[:50] if len(k) > 7]
    keys = [k[: len(k) // 4 * 4] for k in keys]
    tree = RadixTree(1)
    for row, k in enumerate(keys):
        tree.insert(k, [1], row, row)
    want = defaultdict(list)
    for row, k in enumerate(keys):
        for d in range(1, len(k) // 4 + 1):
            want[k[: 4 * d]].append(row)
    found = {keys[n.row][: 4 * d]: (n.sums[0], n.least) for d, n in tree.aligned(4, 0)}
    assert found == {k: (len(v), min(v)) for k, v in want.items()}
    limits, stack = set(), [tree.root]
    while stack:
        node = stack.pop()
        limits.add(node.limit)
        stack += node.children()
    assert {SMALL, MEDIUM, 256} <= limits
    for n in (SMALL, MEDIUM, LARGE, 200):
        tree = RadixTree(1)
        for b in range(n):
            tree.insert(bytes([b]), [1], b, b)
        assert tree.root.limit == next(x for x in (SMALL, MEDIUM, LARGE, 256) if x >= n)
        assert all(tree.root.find(b).path == bytes([b]) for b in range(n)) and tree.root.find(255) is None


@pytest.mark.parametrize("stretch, tree_bytes", [(256, 32 << 20), (2, 64)])
def test_random_conversations(spark, monkeypatch, stretch, tree_bytes):
    monkeypatch.setattr(pt, "STRETCH", stretch)
    draw = random.Random(stretch)
    rows = []
    for c in [*range(30), 40, 41, 43, 63, 64, -7, -20, 10**12 + 5]:
        for t in range(draw.choice([1, 2, 2, 3, 5, 9])):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a b", "a b c", "", None])))
    rows += [(c, t, "user", f"the same {t}") for c in range(100, 140) for t in range(4)]
    rows += [(7, 1, "user", "a b"), (7, 1, "user", "a b"), (8, None, None, "first"), (None, 0, "user", "nobody"), (9, 3, "", " x y")]
    rows += [(200, t, "user", f"{t % 3}") for t in range(60)] + [(201, t, "user", f"{t % 3}") for t in range(61)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(pt.prefix_trie(df, tree_bytes)) == brute(rows)


def test_clashing_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, "user", "x y"), (1, 0, "user", "x y"), (2, 5, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("place", "tid", "words", "depth", "n", "part", "weights")})
    assert got(pt.prefix_trie(df)) == brute(rows)
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pt.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_only_turnless_conversations(spark):
    c = next(c for c in range(21, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_query_whole(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_prefix_trie"](spark, sf)) == brute(rows)
    con = oracle.duck(sf)
    assert sorted(con.sql(f"select {', '.join(COLUMNS)} from ({ORACLE_SQL['op13_prefix_trie']})").fetchall(), key=repr) == brute(rows)
