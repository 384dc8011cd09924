"""Packing: dominance keeps the optimum, whole plans against plain ones, rows against the library."""

import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import empty_documents, odd_documents
from tokenizers import Tokenizer

from panelworks.llm import packing
from panelworks.llm.queries import QUERIES, WORD_BPE

SF = "/root/testdata/sf0.001"


def fewest(lengths, capacity):
    """The least number of sequences, by trying everything."""
    @lru_cache(None)
    def pack(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        seen = set()

        def fill(room, start, others, gone):
            nonlocal best
            kept = tuple(x for k, x in enumerate(others) if k not in gone)
            if kept not in seen:
                seen.add(kept)
                best = min(best, 1 + pack(kept))
            last = None
            for k in range(start, len(others)):
                if others[k] <= room and others[k] != last:
                    last = others[k]
                    fill(room - others[k], k + 1, others, gone | {k})

        fill(capacity - first, 0, rest, frozenset())
        return best

    return pack(tuple(sorted(lengths, reverse=True)))


def plain_best_fit(lengths, capacity):
    rooms = []
    for w in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= w]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - w)
        else:
            rooms.append(capacity - w)
    return sorted(rooms)


def spelled(bins):
    return Counter(w for b in bins for w, each in b.held for _ in range(b.count * each))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_dominance_loses_no_optimum(lengths):
    left = packing._Lengths(Counter(lengths), 20)
    fixed = packing.reduce_by_dominance(left, 20)
    rest = [w for w, n in enumerate(left.n.tolist()) for _ in range(n)]
    assert spelled(fixed) + Counter(rest) == Counter(lengths)
    assert all(sum(w * e for w, e in b.held) + b.room == 20 and b.room >= 0 for b in fixed)
    assert sum(b.count for b in fixed) + fewest(rest, 20) == fewest(lengths, 20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_by_counts_equals_best_fit_one_by_one(lengths):
    bins = packing.best_fit(packing._Lengths(Counter(lengths), 50), 50)
    assert spelled(bins) == Counter(lengths)
    assert sorted(b.room for b in bins for _ in range(b.count)) == plain_best_fit(lengths, 50)


def test_large_plan_is_near_the_bound():
    draw = random.Random(8)
    counts = Counter(min(2048, int(draw.lognormvariate(5.5, 1.2)) + 1) for _ in range(200_000))
    bins, fixed = packing.plan(counts)
    assert spelled(bins) == counts and fixed > 0
    assert packing.lower_bound(counts) <= sum(b.count for b in bins) <= packing.lower_bound(counts) * 1.005
    assert sum(len(b.held) for b in bins) < 30_000
    assert packing.plan({}) == ([], 0)


def check_rows(rows, docs):
    library = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            cut = ids[s : s + 2048]
            want[doc_id, p, s, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    counts = Counter(r["length"] for r in rows)
    assert len(sequences) == sum(b.count for b in packing.plan(counts)[0])


def test_query_whole(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_rows(QUERIES["op12_dominance_packing"](spark, SF).collect(), docs)


def test_odd_documents(spark):
    df = odd_documents(spark, clashing=True)
    rows = packing.pack_documents(df.repartition(3), WORD_BPE).collect()
    check_rows(rows, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert packing.pack_documents(empty_documents(spark), WORD_BPE).collect() == []


def test_many_equal_documents_in_many_tasks(spark):
    df = spark.createDataFrame([(k, "one two three") for k in range(5000)], "doc_id bigint, text string").repartition(7)
    rows = packing.pack_documents(df, WORD_BPE).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 5000
    assert len({r["sequence_id"] for r in rows}) == -(-5000 // (2048 // rows[0]["length"]))
