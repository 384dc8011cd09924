"""Encoding, decoding, token files and length histogram against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import zstandard
from tables import empty_documents, odd_documents
from tokenizers import Tokenizer

from panelworks.llm import seekable, token_counts
from panelworks.llm.bpe import encode_decode, word_bpe, word_encoder
from panelworks.llm.pretokens import byte_level_encoder
from panelworks.llm.queries import BYTE_BPE, QUERIES, WORD_BPE
from panelworks.session import fresh_path

SF = "/root/testdata/sf0.001"
ALPHABET = " \n\t' ae1.s tredlvm漢é-́ΣİA "


def odd_strings(n=1500):
    draw = random.Random(5)
    made = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 60))) for _ in range(n)]
    return [*made, "it's 'she 'll we're''s '' 's\n's", "x<|endoftext|>  y  <|endoftext|>z'S", "z" * 3000, "________________", "\x1c a\x1cb"]


@pytest.mark.parametrize("encoder, path", [(byte_level_encoder, BYTE_BPE), (word_encoder, WORD_BPE)])
def test_ids_equal_the_library(encoder, path):
    library, texts = Tokenizer.from_file(path), odd_strings()
    for i, ids in encoder(path).documents(texts):
        assert ids.tolist() == library.encode(texts[i], add_special_tokens=False).ids, texts[i]


def test_pieces_do_not_change_ids(monkeypatch):
    import panelworks.llm.pretokens as p

    texts = [" ".join(odd_strings(200)), None, "a b"]
    want = [ids.tolist() for _, ids in byte_level_encoder(BYTE_BPE).documents(texts)]
    plain = p.pieces
    monkeypatch.setattr(p, "pieces", lambda t: plain(t, 64))
    assert [ids.tolist() for _, ids in byte_level_encoder(BYTE_BPE).documents(texts)] == want


def test_slices_keep_rows_and_long_texts():
    import pyarrow as pa

    from panelworks.llm.textarrays import slices

    texts = ["a" * 40, None, "", "b" * 250, "c" * 99, "é" * 30, "d"]
    batches = [pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "t": pa.array(texts, pa.string())}), pa.RecordBatch.from_pydict(
        {"id": pa.array([], pa.int64()), "t": pa.array([], pa.string())})]
    got = list(slices(iter(batches), "t", 100))
    assert [r for b in got for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
    assert max(sum(len((t or "").encode()) for t in b.column("t").to_pylist()[1:]) for b in got) <= 100
    assert sum(map(len, (b.column("t") for b in got[:-1]))) == len(texts) and len(got) > 3


def test_a_large_batch_is_encoded_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from panelworks.llm import bpe

    draw, word = random.Random(3), "the quick brown fox jumps over lazy dogs it's 12 été".split()
    texts = [" ".join(draw.choices(word, k=400)) for _ in range(6000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "_text": texts})
    encoder = word_encoder(WORD_BPE)
    want = [len(ids) for _, ids in encoder.documents(texts[:300])]
    tracemalloc.start()
    try:
        tracemalloc.reset_peak()
        before, got = tracemalloc.get_traced_memory()[0], []
        for made in bpe._round_trip(iter([batch]), path=WORD_BPE, with_texts=False):
            got += zip(made.column("doc_id").to_pylist(), made.column("n_tokens").to_pylist())
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert [i for i, _ in got] == list(range(len(texts))) and [n for _, n in got[:300]] == want
    assert peak < 40e6, peak


def test_pairs_and_merging():
    bpe, draw = word_bpe(WORD_BPE), random.Random(2)
    tokens = [i for i in np.flatnonzero(bpe.rank >= 0).tolist()]
    inner = [i for i in tokens if not bpe.text[i].endswith(b"</w>")]

    def leaves(t):
        return [t] if bpe.left[t] < 0 else leaves(bpe.left[t]) + leaves(bpe.right[t])

    def merge(ids):
        while True:
            found = [bpe.pair_rank[p] for p in zip(ids, ids[1:]) if p in bpe.pair_rank]
            if not found:
                return ids
            rank, made = min(found)
            k = next(k for k, p in enumerate(zip(ids, ids[1:])) if bpe.pair_rank.get(p) == (rank, made))
            ids = [*ids[:k], made, *ids[k + 2 :]]

    a, b = [draw.choice(inner) for _ in range(3000)], [draw.choice(tokens) for _ in range(3000)]
    got = bpe.compatible(np.array(a), np.array(b))
    assert got.tolist() == [merge(leaves(x) + leaves(y)) == [x, y] for x, y in zip(a, b)]
    assert 0 < got.sum() < len(got)


def brute_bpe(rows):
    library = Tokenizer.from_file(WORD_BPE)
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_round_trip_of_odd_rows(spark):
    docs = odd_documents(spark, clashing=True)
    got = encode_decode(docs, WORD_BPE)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_bpe(docs.select("doc_id", "text").collect())
    full = encode_decode(docs, WORD_BPE, with_texts=True).filter("doc_id = 6").first()
    assert full["decoded"] == "two</w> words</w>" and len(full["ids"]) == full["n_tokens"] == 2
    assert encode_decode(empty_documents(spark), WORD_BPE).count() == 0


def test_bpe_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op5_speculative_bpe"](spark, SF).collect()), key=repr) == brute_bpe(rows)


def brute_files(rows):
    library, start, out = Tokenizer.from_file(BYTE_BPE), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        out.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    return out


def test_token_files_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op3_seekable_frames"](spark, SF)
    assert sorted(map(tuple, got.collect())) == brute_files(rows)


def test_token_files_of_odd_rows(spark):
    docs, folder = odd_documents(spark, clashing=True), fresh_path(spark, "test-files")
    seekable.write_token_files(docs, folder, BYTE_BPE, file_bytes=200)
    got = sorted(map(tuple, seekable.token_starts(spark, folder).collect()), key=lambda r: r[1])
    assert got == brute_files(docs.select("doc_id", "text").collect())
    some = seekable.read_token_files(spark, folder, wanted=[6, 9]).collect()
    library = Tokenizer.from_file(BYTE_BPE)
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["ids"] for r in some} == {i: [*library.encode(texts[i]).ids, 0] for i in (6, 9)}


def test_files_are_zstandard_and_checked(spark):
    folder = fresh_path(spark, "test-files")
    seekable.write_token_files(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").coalesce(1), folder, BYTE_BPE)
    contents = [bytes(r[0]) for r in spark.read.format("binaryFile").load(folder).select("content").collect() if r[0]]
    plain = [zstandard.ZstdDecompressor().stream_reader(c, read_across_frames=True).read() for c in contents]
    assert sum(len(p) for p in plain) == 4 * 5  # other tools see the ids and skip the table
    table, _, _ = seekable.seek_table(contents[0])
    assert table["n"].sum() * 4 == len(plain[0])
    broken = bytearray(contents[0])
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        seekable.seek_table(bytes(broken))


def test_no_documents_make_no_rows(spark):
    folder = fresh_path(spark, "test-files")
    seekable.write_token_files(empty_documents(spark), folder, BYTE_BPE)
    assert seekable.token_starts(spark, folder).count() == 0


def test_histogram_and_limits(spark):
    docs = odd_documents(spark, clashing=True)
    library = Tokenizer.from_file(BYTE_BPE)
    n = [len(library.encode(r[0] or "").ids) for r in docs.select("text").collect()]
    got = token_counts.length_histogram(token_counts.encoded_lengths(docs, BYTE_BPE))
    rows = {r["length"]: r for r in got.collect()}
    assert set(rows) == set(n)
    for k, r in rows.items():
        assert r["n_docs"] == n.count(k)
        assert r["docs_at_least"] == sum(x >= k for x in n)
        assert r["tokens_at_least"] == sum(x for x in n if x >= k)
        assert r["truncated_tokens"] == sum(min(x, k) for x in n)
        assert r["docs_share"] == sum(x <= k for x in n) / len(n)
        assert (r["total_docs"], r["total_tokens"]) == (len(n), sum(n))
    limits = [0, 1, 7, 512, 10**9]
    assert dict(token_counts.truncated_totals(got, limits).collect()) == {k: sum(min(x, k) for x in n) for k in limits}
    assert dict(token_counts.length_quantiles(got, [0.5, 1.0]).collect()) == {0.5: sorted(n)[len(n) // 2 - 1], 1.0: max(n)}
    assert token_counts.length_histogram(token_counts.encoded_lengths(empty_documents(spark), BYTE_BPE)).count() == 0


def test_histogram_query(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    n = [len(library.encode(r[0]).ids) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = {r["length"]: r["truncated_tokens"] for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    assert got == {k: sum(min(x, k) for x in n) for k in n}


def test_a_repeated_id_is_spread_over_files(spark):
    rows = [(None, f"{i} line {i * i}") for i in range(900)] + [(i, "x y") for i in range(100)]
    docs, folder = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), fresh_path(spark, "test-files")
    seekable.write_token_files(docs, folder, BYTE_BPE)
    found = seekable.read_token_files(spark, folder, with_ids=False)
    assert found.filter("doc_id is null").select("part").distinct().count() > 1
    got = sorted(map(tuple, seekable.token_starts(spark, folder).collect()), key=lambda r: r[1])
    assert got == brute_files(rows)
