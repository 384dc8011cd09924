"""Token ids in seekable files: one zstandard frame per document and a trailing seek table.

A file is a row of independent frames, then a skippable frame (which any zstandard tool passes over)
with one entry per document: id, compressed size, number of ids, crc32 of the ids. Readers parse the
tail and decompress the frames they want. Frames hold little-endian unsigned 32-bit ids, each
document's ending in the end id. Files are written and committed by Spark's text writer, one row per
file, whose line separator is the closing magic; so any store that Spark writes to will do, and a
lost executor costs its tasks only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.llm.pretokens import byte_level_encoder
from panelworks.llm.textarrays import HEAD
from panelworks.session import materialize

MAGIC = "PWSK"
SKIPPABLE = 0x184D2A5E
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("size", "<u4"), ("n", "<u4"), ("crc", "<u4")])
TAIL = struct.Struct("<qqI")  # file's partition and number, entries; then the crc32 of entries and tail
FILE_BYTES = 32 << 20


def _image(frames: list[bytes], entries: list[tuple], part: int, number: int) -> bytes:
    """A whole file but for the closing magic."""
    table = np.array(entries, ENTRY).tobytes()
    tail = TAIL.pack(part, number, len(entries))
    tail += struct.pack("<I", zlib.crc32(table + tail))
    head = struct.pack("<II", SKIPPABLE, len(table) + len(tail) + len(MAGIC))
    return b"".join([*frames, head, table, tail])


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    encoder, squeeze = byte_level_encoder(path), zstandard.ZstdCompressor(level=3)
    part, number, held = TaskContext.get().partitionId(), 0, 0
    frames: list[bytes] = []
    entries: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_image(frames, entries, part, number)], pa.binary())], ["image"])

    for batch in batches:
        ids_of = batch.column("doc_id").to_pylist()
        for k, ids in encoder.documents(batch.column("text").to_pylist()):
            raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
            frame = squeeze.compress(raw)
            if frames and held + len(frame) > file_bytes:
                yield made()
                frames, entries, number, held = [], [], number + 1, 0
            frames.append(frame)
            held += len(frame)
            entries.append((ids_of[k] or 0, ids_of[k] is not None, len(frame), len(raw) // 4, zlib.crc32(raw)))
    if frames:
        yield made()


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) into files under ``folder``.

    Documents are in rising order of doc_id (null first; rows of one id in order of text) over the
    files taken by (partition, number). A null text counts as empty: the end id alone. A file holds
    at most ``file_bytes`` of frames, or one larger document. Ranges are cut by doc_id and the head of
    the text, so a repeated or null id is spread where its texts begin unlike.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
    images = dealt.mapInArrow(partial(_pack, path=path, end_id=end_id, file_bytes=file_bytes), "image binary")
    images.select(F.col("image").cast("string")).write.option("lineSep", MAGIC).option("maxRecordsPerFile", 1).text(folder)


def seek_table(content: bytes) -> tuple[np.ndarray, int, int]:
    """Entries, partition and number of a file; raises if the tail is damaged."""
    if content[-len(MAGIC):] != MAGIC.encode():
        raise ValueError("not a token file: the closing magic is missing")
    stop = len(content) - len(MAGIC) - TAIL.size - 4
    part, number, n = TAIL.unpack_from(content, stop)
    table = content[max(0, stop - n * ENTRY.itemsize) : stop]
    if struct.pack("<I", zlib.crc32(table + content[stop : stop + TAIL.size])) != content[stop + TAIL.size :][:4]:
        raise ValueError("the seek table is damaged")
    return np.frombuffer(table, ENTRY), part, number


def _unpack(batches: Iterator[pa.RecordBatch], wanted: frozenset | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    import zstandard

    loosen = zstandard.ZstdDecompressor()
    for batch in batches:
        for value in batch.column("content"):
            content = value.as_buffer().to_pybytes() if value.is_valid else b""
            if not content:
                continue
            table, part, number = seek_table(content)
            ends, before = np.cumsum(table["size"].astype(np.int64)), np.cumsum(table["n"].astype(np.int64)) - table["n"]
            rows = []
            for k, e in enumerate(table):
                doc_id = int(e["doc_id"]) if e["known"] else None
                if wanted is not None and doc_id not in wanted:
                    continue
                raw = loosen.decompress(content[int(ends[k]) - int(e["size"]) : int(ends[k])], max_output_size=4 * int(e["n"]))
                crc = zlib.crc32(raw)
                if crc != e["crc"] or len(raw) != 4 * e["n"]:
                    raise ValueError(f"the frame of document {doc_id} is damaged")
                rows.append((doc_id, part, number, k, int(before[k]), len(raw) // 4, crc, raw))
            cols = list(zip(*rows)) or [()] * 8
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 7 + [pa.binary()])]
            names = ["doc_id", "part", "file", "place", "before", "n_tokens", "ids_crc32", "raw"]
            if with_ids:
                lists = [np.frombuffer(r, "<u4").astype(np.int64) for r in cols[7]]
                arrays[7], names[7] = pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), "ids"
            else:
                arrays, names = arrays[:7], names[:7]
            yield pa.RecordBatch.from_arrays(arrays, names)


def read_token_files(spark: SparkSession, folder: str, wanted: Sequence[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of the files, checked against their checksums; with ``wanted`` only those ids.

    Rows: doc_id, part, file, place (order of the documents), before (ids before it in its file),
    n_tokens, ids_crc32, ids. Only the frames of wanted documents are decompressed. A damaged frame
    or table raises.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    schema = "doc_id bigint, part bigint, file bigint, place bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
    chosen = None if wanted is None else frozenset(wanted)
    return files.mapInArrow(partial(_unpack, wanted=chosen, with_ids=with_ids), schema + ", ids array<bigint>" * with_ids)


def token_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): ids of all documents before each one, over all files.

    The running total goes over one row per file.
    """
    rows = materialize(read_token_files(spark, folder, with_ids=False), "frames")
    files = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    return rows.join(files, ["part", "file"]).select(
        "doc_id", (F.col("_at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
