"""Benchmark items inside documents: MinHash containment search by size partitions, then exact shingles.

An item's MinHash sketch is its q - ceil(t * q) + 1 smallest shingle hashes for containment t: a document
that holds at least t of the item holds one of them, so the search misses nothing. Items are parted by
size (powers of two). The largest sketch hash of a partition bounds what its items can ask for, so a
document's own sketch is its shingles up to the largest bound of the partitions that fit into it:
items of more than its shingles / t are never looked for. Sketches meet by hash; what meets is
verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.line_dedup import document_key
from panelworks.session import materialize

WORDS, PERCENT = 5, 75
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r"
_LOWER = "abcdefghijklmnopqrstuvwxyz     "


def words_of(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), " ", -1), "")


def _shingles(words: str) -> Column:
    """Distinct shingles of a column of words, as texts."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - WORDS + 1), lambda i: F.array_join(F.slice(words, i, WORDS), " "))
    return F.array_distinct(F.when(n >= WORDS, runs).otherwise(F.when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array())))


def _hashed(rows: DataFrame, keep: str) -> DataFrame:
    """(keep, n, h): a row per shingle position, n positions in all; a short text is one shingle.

    Each step is a column of its own, so that it is computed once although the next uses it often. (An
    inner explode would add a filter on its size, which computes everything twice.)
    """
    hashed = rows.select(keep, F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    n = F.size("_h")
    runs = F.arrays_zip(*[F.slice("_h", k + 1, F.greatest(n - WORDS + 1, F.lit(0))).alias(f"w{k}") for k in range(WORDS)])
    short = F.array(F.struct(*[F.get("_h", F.lit(k)).alias(f"w{k}") for k in range(WORDS)]))
    runs = F.when(n >= WORDS, runs).otherwise(F.when(n > 0, short))
    runs = hashed.select(keep, F.greatest(n - WORDS + 1, F.lit(1)).alias("n"), runs.alias("_runs"))
    each = runs.select(keep, "n", F.explode_outer("_runs").alias("s"))
    return each.filter(F.col("s").isNotNull()).select(keep, "n", F.xxhash64(*[f"s.w{k}" for k in range(WORDS)]).alias("h"))


def _item_sketches(items: DataFrame, percent: int) -> DataFrame:
    """(item, size_class, h): the smallest hashes of each item."""
    sets = _hashed(items, "item").groupBy("item").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    q = F.size("hs")
    depth = q - F.ceil(q * percent / 100).cast("int") + 1
    return sets.select("item", F.floor(F.log2(q)).cast("int").alias("size_class"), F.explode(F.slice("hs", F.lit(1), depth)).alias("h"))


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): items of which ``percent`` % or more is in a document.

    Shingles are runs of five words, distinct per text. Only doc_id and text, item_id and text are
    read. Null and empty texts on either side match nothing; a text of fewer than five words is one
    shingle and matches only its like. Rows that repeat an id and its text count once. No matches: no rows.
    """
    return _found(docs, items, percent).drop("doc")


def _found(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """``find_items`` with the key ``doc`` of the document beside its id."""
    items = items.select(F.struct(F.col("item_id").alias("id"), F.xxhash64("text").alias("of")).alias("item"), words_of("text").alias("_words"))
    items = items.filter(F.size("_words") > 0).dropDuplicates(["item"])
    whole = materialize(items.select("item", _shingles("_words").alias("wanted")), "items")
    sketches = materialize(_item_sketches(items, percent), "sketches")

    # one bound per power of two: at most 32 rows
    bounds = sketches.groupBy("size_class").agg(F.max("h").alias("top")).orderBy("size_class").collect()
    top, limit = -(1 << 63), F.lit(None).cast("bigint")
    for b in bounds:
        top = max(top, b["top"])
        least = -(-(1 << b["size_class"]) * percent // 100)
        limit = F.when(F.col("n") >= least, F.lit(top)).otherwise(limit)
    parts = docs.select(document_key().alias("doc"), words_of("text").alias("_words"))
    sketch = _hashed(parts, "doc").filter(F.col("h") <= limit).select("doc", "h")
    return _verified(docs, sketch.join(sketches.select("item", "h"), "h").select("doc", "item").distinct(), whole, percent)


def _verified(docs: DataFrame, candidates: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Exact containment of the candidates (doc, item)."""
    candidates = materialize(candidates, "candidates")
    texts = docs.select(document_key().alias("doc"), "text").join(
        materialize(candidates.select("doc").distinct(), "concerned"), "doc", "left_semi").dropDuplicates(["doc"])
    held = texts.select("doc", words_of("text").alias("_words")).select("doc", _shingles("_words").alias("held"))
    met = candidates.join(held, "doc").join(items, "item")
    counted = met.select(
        "doc", F.col("doc.id").alias("doc_id"), F.col("item.id").alias("item_id"), F.size("wanted").cast("bigint").alias("n_item"),
        F.size(F.array_intersect("wanted", "held")).cast("bigint").alias("n_shared"))
    kept = counted.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return kept.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean_documents(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All rows and columns of the documents that hold no item.

    A document is an id with its text: other texts of a repeated or null id stay.
    """
    leaks = _found(docs, items, percent).select(F.col("doc").alias("_leak")).distinct()
    return docs.join(materialize(leaks, "leaks"), document_key() == F.col("_leak"), "left_anti")
