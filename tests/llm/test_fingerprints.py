"""Order MinHash against a direct version."""

import hashlib

import numpy as np
from tables import LONG, empty_documents, odd_documents, prose

from panelworks.llm.order_minhash import edited_text, fingerprints, neighbour_fingerprints
from panelworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    following = texts[1:] + texts[:1]
    edited = [edited_text(a, b) for a, b in zip(texts, following)]
    f, e, n = fingerprints(texts), fingerprints(edited), fingerprints(following)
    return sorted(((r[0], len(t), hashlib.sha256(x.encode()).hexdigest(), a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(),
                    float((a == b).mean()), float((a == c).mean())) for r, t, x, a, b, c in zip(rows, texts, edited, f, e, n)), key=repr)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op10_order_minhash"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
    assert np.mean([r["near_edited"] for r in got]) > 10 * np.mean([r["near_next"] for r in got])


def test_odd_rows(spark):
    docs = odd_documents(spark, clashing=True)
    assert sorted(map(tuple, neighbour_fingerprints(docs).collect()), key=repr) == expected(docs.select("doc_id", "text").collect())
    assert neighbour_fingerprints(empty_documents(spark)).count() == 0
    one = neighbour_fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0  # after the last comes the first: itself


def test_edit():
    assert edited_text("abcde", "xyz") == "abcxy"
    assert edited_text("abcdefgh", "x") == "abcdx"
    assert edited_text("", "x") == "" and edited_text("a", "x") == "a"


def test_order_and_repetition_count():
    base = prose(1, 300).split()
    halves = " ".join(base[150:] + base[:150])
    doubled = " ".join(base + base)
    shuffled = prose(2, 300)
    f = fingerprints([" ".join(base), " ".join(base), halves, doubled, shuffled, " ".join(reversed(base))])
    near = (f[0] == f).mean(axis=1)
    assert near[1] == 1 and 0.2 < near[2] < 0.95 and near[3] < 0.6 and near[4] < 0.05 and near[5] < 0.05


def test_slots_follow_the_definition():
    """Every slot hashes the l smallest (k-mer, occurrence), in text order: equal sets in equal order agree."""
    words = prose(3, 200).split()
    words[100:110] = words[0:10]
    a, b = " ".join(words), " ".join(words[:-1] + ["other"])
    near = (fingerprints([a])[0] == fingerprints([b])[0]).mean()
    assert near > 0.9
    alone, among = fingerprints([a])[0], fingerprints([LONG, a, "x", a])
    assert (among[1] == alone).all() and (among[3] == alone).all()  # companions do not matter


def test_a_repeated_id_over_several_ranges(spark):
    rows = [(7, f"{i} of {i % 13} words in row {i * i}") for i in range(600)] + [(None, "a b c")] * 40 + [(9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, neighbour_fingerprints(docs).collect()), key=repr) == expected(rows)
