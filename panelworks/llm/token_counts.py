"""Exact histogram of encoded lengths, with suffix sums for every context limit.

Documents are reduced to one row per distinct length; running sums over those rows, inside segments of
4,096 lengths and over the segments, give what any limit needs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.pretokens import byte_level_encoder
from panelworks.operators.position import running_within_segments
from panelworks.session import materialize

SEGMENT = 4096


def _lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = byte_level_encoder(path)
    for batch in batches:
        n = [len(ids) for _, ids in encoder.documents(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["length"])


def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """(length): number of ids of each whole text; a null text counts as empty, length 0."""
    return docs.select("text").mapInArrow(partial(_lengths, path=path), "length bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct ``length``; an empty input gives none.

    n_docs: documents of this length. docs_at_least, tokens_at_least: documents of at least this
    length and their ids. truncated_tokens: ids that remain when each document is cut to this
    length. docs_share: share of documents up to this length. total_docs, total_tokens: of all.
    """
    rows = materialize(
        lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumn("_tokens", F.col("length") * F.col("n_docs")), "lengths")
    sums = ["n_docs", "_tokens"]
    up = running_within_segments(rows.withColumn("_seg", F.floor(F.col("length") / SEGMENT)), "length", [], sums)
    turned = up.withColumns({"_seg": -F.col("_seg"), "_down": -F.col("length")}).withColumnsRenamed(
        {f"{s}_before": f"_{s}_shorter" for s in sums})
    both = running_within_segments(turned, "_down", [], sums)
    longer, longer_tokens = F.col("n_docs_before"), F.col("_tokens_before")
    upto = F.col("_n_docs_shorter") + F.col("n_docs")
    upto_tokens = F.col("__tokens_shorter") + F.col("_tokens")
    return both.select(
        "length", "n_docs",
        (longer + F.col("n_docs")).alias("docs_at_least"),
        (longer_tokens + F.col("_tokens")).alias("tokens_at_least"),
        (upto_tokens + F.col("length") * longer).alias("truncated_tokens"),
        (upto / (upto + longer)).alias("docs_share"),
        (upto + longer).alias("total_docs"), (upto_tokens + longer_tokens).alias("total_tokens"))


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, tokens): ids that remain for context limits of any size, from the suffix sums.

    An empty histogram gives null totals.
    """
    aggs = []
    for limit in limits:
        above = F.when(F.col("length") > limit, F.col("length"))
        kept = F.max("total_tokens") - F.coalesce(F.min_by("tokens_at_least", above), F.lit(0))
        aggs.append((kept + F.coalesce(F.min_by("docs_at_least", above), F.lit(0)) * limit).alias(f"_{limit}"))
    pairs = F.array(*[F.struct(F.lit(n).cast("bigint").alias("limit"), F.col(f"_{n}").alias("tokens")) for n in limits])
    return histogram.agg(*aggs).select(F.inline(pairs))


def length_quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the smallest length that covers each share of the documents."""
    aggs = [F.min(F.when(F.col("docs_share") >= s, F.col("length"))).alias(f"_{i}") for i, s in enumerate(shares)]
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"_{i}").alias("length")) for i, s in enumerate(shares)])
    return histogram.agg(*aggs).select(F.inline(pairs))
