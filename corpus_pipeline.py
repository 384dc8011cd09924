"""The corpus pipeline: language, repeated lines, near duplicates, benchmark items, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.llm import bpe, decontaminate, language_id, line_dedup, parity_join
from panelworks.llm.queries import WORD_BPE
from panelworks.operators import position
from panelworks.session import fresh_path, materialize

#: A text of this or a larger mean posterior has a language; an even mix of two languages has 0.5.
MIN_SCORE = 0.4
#: No SQL: a conditional random field and a tokenizer decide. Tests compare with a brute-force version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word, of some language the field is sure enough of."""
    model = language_id.fit(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]  # own names, so that result columns cannot clash
    found = language_id.predict(docs.toDF(*names), model, text=names[docs.columns.index("text")], keep=names)
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return found.filter(sure).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted; documents that consist of them go."""
    cleaned = line_dedup.delete_repeated_runs(docs.withColumnsRenamed({"n_lines": "_own_lines", "n_deleted": "_own_deleted"}))
    kept = cleaned.filter((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    size = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    made = {"n_lines": F.col("_own_lines") if "n_lines" in docs.columns else None,
            "n_deleted": F.col("_own_deleted") if "n_deleted" in docs.columns else None,
            "n_chars": size.cast(docs.schema["n_chars"].dataType) if size is not None else None}
    return kept.select(*[made[c].alias(c) if made.get(c) is not None else F.col(c) for c in docs.columns])


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n), (doc_id = n, text): a number of its own for each document_key with an id.

    It rises with the id, then the text's hash. Ids that hold one text each are their own numbers.
    """
    docs = docs.filter("doc_id is not null")
    keys = materialize(docs.select(line_dedup.document_key().alias("key")).distinct(), "keys")
    if keys.groupBy("key.id").count().filter("count > 1").isEmpty():
        return keys.select("key", F.col("key.id").cast("bigint").alias("n")), docs.select("doc_id", "text")
    placed = position.range_segments(keys.select("key.id", "key.of"), "id", "of")
    placed = position.with_position(placed, ["id", "of"], F.col("_range"), name="n")
    placed = materialize(placed.select(F.struct("id", "of").alias("key"), F.col("n").cast("bigint").alias("n")), "numbered")
    texts = docs.select(line_dedup.document_key().alias("key"), "text").join(placed, "key")
    return placed, materialize(texts.select(F.col("n").alias("doc_id"), "text"), "texts")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays, of rows that repeat an id and its text one.

    A document is an id with its text. Among texts of one id the smallest hash counts as the smallest
    id, among rows that repeat both the smallest other columns. Rows without an id stay.
    """
    numbered, texts = _numbered(docs)
    classes = materialize(parity_join.jaccard_components(texts), "classes")
    others = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("n")).distinct()
    others = materialize(numbered.join(others, "n", "left_semi").select(F.col("key").alias("_other")), "others")
    repeated = classes.groupBy(F.col("doc_id").alias("n")).count().filter("count > 1")
    repeated = materialize(numbered.join(repeated, "n", "left_semi").select(F.col("key").alias("_repeated")), "repeated")
    kept = docs.join(others, line_dedup.document_key() == F.col("_other"), "left_anti")
    again = line_dedup.document_key() == F.col("_repeated")
    single = kept.join(repeated, again, "left_anti")
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields
            if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = F.min_by(whole, F.struct(*rest) if rest else F.lit(0)).alias("_row")  # aggregated before the shuffle
    first = kept.join(repeated, again, "left_semi").groupBy("doc_id", "text").agg(chosen).select("_row.*")
    return single.unionByName(first).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts and their decoding, as counts and digests."""
    return bpe.encode_decode(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
