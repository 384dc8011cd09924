"""The corpus pipeline against a brute-force version, stage by stage and as a whole."""

import numpy as np
from pyspark.sql import functions as F
from tables import CLASHING, empty_documents, odd_documents, prose
from test_learned import direct_posterior
from test_near_duplicates import brute_components, brute_leaks, brute_runs
from test_tokens import brute_bpe

import corpus_pipeline
from panelworks.llm import decontaminate, language_id
from panelworks.session import fresh_path

SF = "/root/testdata/sf0.001"


def brute_language(rows, model):
    """Ids of documents that the first stage keeps."""
    kept = set()
    for i, text in rows:
        for _, e, at in language_id._emissions([text or ""], model):
            if at[-1]:
                p = direct_posterior(e, np.exp(model.switch - model.switch.max()))
                if p.mean(axis=0).max() >= corpus_pipeline.MIN_SCORE:
                    kept.add(i)
    return kept


def brute_pipeline(docs, items, model):
    rows = sorted((r["doc_id"], r["text"]) for r in docs)
    kept = brute_language(rows, model)
    rows = [(i, t) for i, t in rows if i in kept]
    cleaned = brute_runs(rows, 50)
    before = dict(rows)
    rows = [(i, t) for i, t in cleaned.items() if t or not before[i]]
    classes = brute_components(rows)
    rows = [(i, t) for i, t in rows if classes[i][1] == i]
    leaking = {x[0] for x in brute_leaks(rows, items)}
    return brute_bpe([(i, t) for i, t in rows if i not in leaking])


def test_pipeline_equals_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    top = source.agg(F.max("doc_id")).first()[0]
    more = [(top + 1, "1234 !!", "en", "s", 7), (top + 2, "", "en", "s", 0), (top + 3, prose(1, 40) + "\n" + prose(2, 70), "en", "s", 0),
            (top + 4, prose(3, 30) + "\n" + prose(2, 70), "en", "s", 0), (top + 5, prose(2, 70), "en", "s", 0)]
    folder = fresh_path(spark, "test-tables")
    docs = source.unionByName(spark.createDataFrame(more, source.schema))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_pipeline(docs.collect(), items, language_id.fit(docs))
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr)
    assert got == want
    ids = {r[0] for r in got}
    assert top + 1 not in ids and top + 2 not in ids and top + 5 not in ids and {top + 3, top + 4} <= ids


def test_stages_take_odd_rows_and_keep_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    docs = odd_documents(spark, clashing=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {r["score"] for r in out.collect()} <= {"mine"} and "n_lines" in CLASHING
    once = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in once if r["doc_id"]) == [1, 2, 3, 4, 5, 6, 7, 8, 10]
    assert sum(r["doc_id"] is None for r in once) == 1
    assert corpus_pipeline.known_language(spark, docs, SF).filter("doc_id in (1, 2, 3, 4)").count() == 0


def test_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_documents(spark), SF).count() == 0


def test_texts_of_a_repeated_or_null_id_stand_alone(spark):
    """A leak or a near duplicate takes its own text only, whatever other rows have its id."""
    item = prose(1, 40)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, prose(2, 40)), (7, prose(3, 40)), (7, item), (8, prose(4, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = decontaminate.clean_documents(docs, items)
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted((r for r in rows if r[1] != item), key=repr)

    a, b, c = prose(5, 60), prose(6, 60), prose(7, 60)
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "z"), (2, b, "y"), (2, c, "x"), (3, b, "x"), (4, c + " more", "x"), (None, a, "x"), (None, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    kept = sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, docs, SF).collect()), key=repr)
    assert kept == sorted([(1, a, "x"), (2, b, "y"), (2, c, "x"), (None, a, "x"), (None, b, "x")], key=repr)
