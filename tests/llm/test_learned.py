"""Language, quality and URL rules: direct versions, held-out accuracy, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from tables import empty_documents, odd_documents

from panelworks.llm import language_id, quality, url_rules
from panelworks.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"


def direct_posterior(e, a):
    k, forward, out = e.shape[1], [], []
    state = np.full(k, 1 / k)
    for x in e:
        state = (state @ a) * x
        state = state / state.sum()
        forward.append(state)
    back = np.ones(k)
    for x, s in zip(e[::-1], forward[::-1]):
        out.append(s * back)
        back = a @ (x * back)
        back = back / back.sum()
    p = np.array(out[::-1])
    return p / p.sum(axis=1, keepdims=True)


def test_forward_backward_in_segments():
    draw = np.random.default_rng(0)
    sizes = [0, 1, 5, 31, 32, 33, 64, 65, 1000, 0, 97]
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k in (1, 2, 6):
        e, a = draw.uniform(0.01, 1, (at[-1], k)), draw.uniform(0.1, 1, (k, k))
        got = language_id.forward_backward(e, at, a)
        for i, j in zip(at[:-1], at[1:]):
            if j > i:
                assert np.allclose(got[i:j], direct_posterior(e[i:j], a))


def test_expected_counts_equal_enumeration():
    """Likelihood and counts of every labelling of a short sequence, one by one."""
    from itertools import product

    draw = np.random.default_rng(2)
    scores, switch = draw.normal(size=(3, 2)), draw.normal(size=(2, 2))
    kinds, label = np.array([[0, 2, 1, 0]]), np.array([[1, 0, 0, 1]])

    def total(y):
        return sum(scores[w, c] for w, c in zip(kinds[0], y)) + sum(switch[a, b] for a, b in zip(y, y[1:]))

    every = list(product(range(2), repeat=4))
    z = sum(np.exp(total(y)) for y in every)
    words, pairs = np.zeros((3, 2)), np.zeros((2, 2))
    for y, share in [(y, np.exp(total(y)) / z) for y in every] + [(tuple(label[0]), -1)]:
        for w, c in zip(kinds[0], y):
            words[w, c] += share
        for a, b in zip(y, y[1:]):
            pairs[a, b] += share
    got = language_id.expectations(kinds, label, scores, switch)
    assert np.isclose(got[0], total(label[0]) - np.log(z))
    assert np.allclose(got[1], words) and np.allclose(got[2], pairs)


def test_gradient_equals_finite_differences(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", 1 << 8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 400 and doc_id < 150")
    blocks, langs = language_id.training_blocks(docs)
    draw, k = np.random.default_rng(5), len(langs)
    weights, switch = draw.normal(size=(1 << language_id.BITS, k)).astype(np.float32), draw.normal(size=(k, k))
    _, grad, pairs = language_id.objective(blocks, weights, switch)
    top = np.unravel_index(np.argsort(-np.abs(grad), axis=None)[:2], grad.shape)
    for i, c in zip(*top):
        ends = []
        for move in (0.05, -0.05):
            moved = weights.copy()
            moved[i, c] += move
            ends.append(language_id.objective(blocks, moved, switch)[0])
        assert np.isclose((ends[0] - ends[1]) / 0.1, grad[i, c], rtol=0.01, atol=1e-5)
    ends = [language_id.objective(blocks, weights, switch + np.eye(1, k * k, 1).reshape(k, k) * m)[0] for m in (1e-3, -1e-3)]
    assert np.isclose((ends[0] - ends[1]) / 2e-3, pairs.ravel()[1], rtol=0.01, atol=1e-6)


def test_one_language_and_character_bound(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").limit(40)
    rows = language_id.identify(docs).collect()
    assert {r["lang_pred"] for r in rows} <= {"en", "und"} and all(r["score"] in (0, 1) for r in rows)
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [sum(len(r["kinds"]) for r in language_id.training_blocks(whole, 1000, n)[0].collect()) for n in (10**9, 10**5)]
    assert sizes[1] < sizes[0] / 3


def test_language_query_on_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_crf_language"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97


def test_switches_inside_a_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    one = {x: [r["text"].split() for r in docs.filter((F.col("lang") == x) & language_id.held_out()).limit(12).collect()] for x in ("en", "de")}
    texts = [" ".join(a[:25] + b[:25] + a[25:50]) for a, b in zip(one["en"], one["de"]) if min(len(a), len(b)) > 50]
    mixed = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.predict(mixed, model, with_spans=True).collect():
        long = [s["lang"] for s in r["spans"] if s["words"] >= 12]
        assert long == ["en", "de", "en"]
        assert sum(s["words"] for s in r["spans"]) == r["n_words"] and len(r["spans"]) == r["n_switches"] + 1


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark, clashing=True)
    rows = language_id.identify(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r for r in rows}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert got[6]["lang_pred"] in ("en", "fr") and got[None]["held_out"] is False
    assert language_id.identify(empty_documents(spark)).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_quality_query_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op8_fourier_quality"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_quality_of_odd_rows(spark):
    docs = odd_documents(spark, clashing=True)
    labels = spark.createDataFrame([(2, 0, 0), (6, 1, 0), (6, 0, 0), (8, None, 0), (9, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.quality_scores(docs, labels.filter("false")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    assert quality.quality_scores(empty_documents(spark), labels).count() == 0


def test_statistics_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    texts = ["One TWO two! 3 | é\nè two two. ", None, "x " * 50, ""]
    whole = quality.statistics(texts)
    plain = quality.pieces
    monkeypatch.setattr(quality, "pieces", lambda t: plain(t, 8))
    assert np.allclose(quality.statistics(texts), whole)


def test_isotonic_fit():
    got = quality.isotonic(np.array([1.0, 1, 1, 2, 1]), np.array([0.1, 0.5, 0.3, 0.35, 0.9]))
    assert np.allclose(got, [0.1, 0.375, 0.375, 0.375, 0.9])
    assert len(quality.isotonic(np.zeros(0), np.zeros(0))) == 0


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(len(t), t, v) for t, v in URL_RULES
            if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fits)[1:] if fits else None


def test_url_query_and_odd_urls(spark):
    odd = ["http://ORG/x", "http://a.Example.org/es/1?q#f", "http://example.org/en/12", "http://borg/", "http://x.com", "http://com/fr/",
           "a://b://c/d", "no scheme", "", None, "http://user@h.com/de/\n?x", "://org/", "http://org?x", "http://ÄORG.org/en/1"]
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    pages = spark.createDataFrame([*map(tuple, rows), *[(10**6 + i, u) for i, u in enumerate(odd)]], "page_id long, url string")
    pages = pages.withColumns({"rule": F.lit("mine"), "score": F.lit(1)})
    nothing = spark.createDataFrame([], "url string, blocked boolean")
    got = url_rules.judge_urls(pages, nothing, URL_RULES).collect()
    assert len(got) == pages.count()
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in got:
        host, path = brute_host_path(urls[r["page_id"]])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"]) == (host, path), urls[r["page_id"]]
        assert (r["rule"], r["verdict"]) == (rule if rule else (None, "allow")), urls[r["page_id"]]
    query = QUERIES["op6_url_rules"](spark, SF).collect()
    assert {r["page_id"] for r in query} == {r["page_id"] for r in rows}
    assert all((r["rule"] is not None) == (brute_rule(r["host"], r["path"]) is not None) for r in query)
    assert url_rules.judge_urls(pages.filter("false"), nothing, URL_RULES).count() == 0


def test_mined_rules_match_by_their_tokens(spark):
    rows = [(f"http://ads.example.net/{p}/{i}", True) for p in ("buy", "win") for i in range(40)]
    rows += [(f"http://ads.example.net/about/{i}", False) for i in range(60)]
    rows += [(f"http://news.example.org/buy/{i}", False) for i in range(60)] + [("http://x.y/", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = url_rules.mine_rules(labelled, min_confidence=0.9)
    found = {frozenset(r["tokens"]): r["confidence"] for r in rules.collect()}
    assert frozenset(["host=ads.example.net", "first=buy"]) in found and min(found.values()) >= 0.9
    urls = ["http://ads.example.net/buy/999?x=1", "http://ads.example.net/about/7", "http://news.example.org/buy/3", "http://other.net/buy/1", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, labelled, []).collect()}
    fires = {k: any(t <= set(r["t"]) for t in found) for k, r in
             ((r["page_id"], r) for r in pages.select("page_id", url_rules.url_tokens("url").alias("t")).collect())}
    default = url_rules.judge_urls(pages, labelled, [])  # the default confidence keeps more rules
    assert got[0] == "block" and got[2] == "allow" and fires[0] and not fires[1] and not fires[2]
    assert default.filter("page_id = 4").first()["verdict"] == "allow"
