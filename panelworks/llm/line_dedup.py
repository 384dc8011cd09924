"""Repeated runs of lines: a suffix array over line ids by prefix doubling, cut by its LCP intervals.

Lines that occur once end every repeated run, so only repeated lines get ids and the text is a set of
segments of consecutive repeated lines. Doubling round k ranks every suffix by its first 2^k lines:
the pairs (rank of the first half, rank of the second half) are sorted by ranges, without copies, and
their places are the new ranks. Suffixes that share d lines form one LCP interval of the suffix array;
its identity is the rank of its first and of its last 2^k lines, with 2^k <= d < 2^(k+1). Doubling goes
on until every interval that can matter is told apart.

A maximal run of at least ``min_words`` words that occurs earlier is covered exactly by its shortest
windows of that many words, taken from the left and from the right. Each window is one suffix at one
depth; all but the first occurrence of its interval are later copies, and their lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.session import materialize

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc, pos, words, first half id, second half id) of all lines that occur more than once."""
    # (an inner explode would add a filter on its size, which splits every text twice)
    lines = docs.select("doc", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.filter(F.col("line").isNotNull()).select(
        "doc", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"),
        F.regexp_count("line", F.lit(WORD)).cast("bigint").alias("words"))
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    return lines.join(often, ["h1", "h2"])


def _ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, place): each distinct pair's place in sorted order; written, so that places are final."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select(a, b).distinct().repartitionByRange(n, a, b).sortWithinPartitions(a, b)
    return materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "ranks")


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, start, stop): for each line the shortest run of ``min_words`` words from it on, and up to it.

    Running sums of words meet their targets in one sorted pass over a segment: a target is followed
    (seen from the other end) by the nearest line that reaches it.
    """
    seg = ["doc", "segment"]
    up = Window.partitionBy(*seg).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = lines.withColumn("upto", F.sum("words").over(up)).withColumn("before", F.col("upto") - F.col("words"))

    def nearest(value: Column, target: Column, down: bool) -> DataFrame:
        points = F.array(
            F.struct(value.alias("v"), F.lit(0).alias("asks"), F.col("pos").alias("at")),
            F.struct(target.alias("v"), F.lit(1).alias("asks"), F.col("pos").alias("at")))
        events = sums.select(*seg, F.inline(points))
        order = [F.desc("v"), "asks", F.desc("at")] if down else ["v", "asks", "at"]
        seen = Window.partitionBy(*seg).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        hit = F.last(F.when(F.col("asks") == 0, F.col("at")), ignorenulls=True).over(seen)
        return events.withColumn("hit", hit).filter("asks = 1 and hit is not null")

    fromleft = nearest(F.col("upto"), F.col("before") + min_words, True).select(
        "doc", F.col("at").alias("start"), F.col("hit").alias("stop"))
    fromright = nearest(F.col("before"), F.col("upto") - min_words, False).select(
        "doc", F.col("hit").alias("start"), F.col("at").alias("stop"))
    return fromleft.unionByName(fromright).filter("stop >= start").distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, runs): maximal line runs that are later copies, as [first line, last line] from 0.

    ``doc`` is ``document_key``. Documents are ordered by it, lines by place; of equal runs the first
    stays. A run may repeat within its own document. Documents without such runs have no row.
    """
    lines = materialize(_repeated_lines(docs.select(document_key().alias("doc"), "text")), "lines")
    ranks = _ranked(lines, "h1", "h2")
    own = Window.partitionBy("doc").orderBy("pos")
    seq = lines.join(ranks, ["h1", "h2"]).select("doc", "pos", "words", F.col("place").alias("rank")).distinct()
    seq = materialize(seq.withColumn("segment", F.col("pos") - F.row_number().over(own)), "sequence")
    windows = materialize(_windows(seq, min_words).withColumn("depth", F.col("stop") - F.col("start") + 1), "windows")

    longest = windows.agg(F.max("depth")).first()[0] or 0
    level = seq.select("doc", "pos", "segment", "rank")
    parts, k = [], 0
    while True:
        here = windows.filter((F.col("depth") >= 1 << k) & (F.col("depth") < 2 << k))
        head = level.select("doc", F.col("pos").alias("start"), F.col("rank").alias("head"))
        tail = level.select("doc", (F.col("pos") + (1 << k) - 1).alias("stop"), F.col("rank").alias("tail"))
        parts.append(here.join(head, ["doc", "start"]).join(tail, ["doc", "stop"]))
        if 2 << k > longest:
            break
        # one doubling further; suffixes that end before it are not needed again, so segments stay
        # without gaps and 2^k rows on is 2^k lines on
        along = Window.partitionBy("doc", "segment").orderBy("pos")
        pairs = level.withColumn("then", F.lead("rank", 1 << k).over(along)).filter(F.col("then").isNotNull())
        pairs = materialize(pairs, "pairs")
        ranks = _ranked(pairs, "rank", "then")
        level = pairs.join(ranks, ["rank", "then"]).select("doc", "pos", "segment", F.col("place").alias("rank"))
        level = materialize(level, "level")
        k += 1

    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    placed = materialize(placed, "intervals")
    interval = ["depth", "head", "tail"]
    firsts = placed.groupBy(*interval).agg(
        F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = placed.join(firsts, interval).filter(F.struct("doc", "start") != F.col("first")).select("doc", "start", "stop")
    # touching and overlapping windows make one run
    order = Window.partitionBy("doc").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") > F.coalesce(reach, F.lit(-2)) + 1, 1).otherwise(0)
    number = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = later.distinct().withColumn("opens", opens).withColumn("run", number)
    runs = runs.groupBy("doc", "run").agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    return runs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def document_key() -> Column:
    """(doc_id, hash of the text): rows that repeat both are one document and share its result."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))


def delete_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, the lines of later copies deleted from ``text``.

    Adds n_lines (before; a null text has 0, an empty one 1) and n_deleted. Lines end at a line feed.
    A text whose lines are all deleted becomes empty; a null text stays null. Columns of the input
    named n_lines or n_deleted are replaced.
    """
    # lists of runs grow with the data and are far larger in memory than on disk: never broadcast them
    runs = materialize(repeated_runs(docs, min_words), "runs").hint("merge")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    keyed = docs.select(*kept, document_key().alias("_doc")).join(runs.toDF("_doc", "_runs"), "_doc", "left")
    lines = F.split("text", "\n", -1)
    deleted = F.flatten(F.transform("_runs", lambda r: F.sequence(r["first"], r["last"])))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), deleted)
    text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return keyed.select(
        *[F.when(F.col("_runs").isNotNull(), text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in kept],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(deleted), F.lit(0)).cast("bigint").alias("n_deleted"))
