"""URL filters: stated host and path rules, and association rules mined from labelled URLs.

Spark's FP-growth mines combinations of URL tokens with the label; rules "tokens -> block" are kept by
support and confidence. A rule is indexed by its rarest token: a URL meets only the rules of its own
tokens, and fires those whose other tokens it has too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.session import materialize

MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.0005, 20, 0.5
BLOCK = "label=block"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(F.col(url), _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(F.col(url), _PARTS, 2), F.lit(""))


def longest_rule(host: str, path: str, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule ("host/path", verdict); null if none fits.

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules of one
    length the first in order of text wins.
    """
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        own, slash, rest = text.partition("/")
        here = ((F.col(host) == own) | F.col(host).endswith("." + own)) & F.col(path).startswith(slash + rest)
        fits = F.when(here, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def url_tokens(url: str) -> Column:
    """A URL's tokens, one per kind at most: so that a URL has few combinations, whatever its length.

    scheme, last label, last two labels, host, first of three or more labels, first and second path
    segment (runs of digits as #), ending of the last segment, number of segments, query names, fragment.
    """
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.", -1)
    segments = F.array_remove(F.split(path, "/", -1), "")
    query = F.regexp_extract(F.col(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.array_sort(F.array_distinct(F.transform(F.split(query, "&", -1), lambda p: F.substring_index(p, "=", 1))))

    def shape(i: int) -> Column:
        return F.regexp_replace(F.get(segments, F.lit(i)), r"\d+", "#")

    kinds = {
        "scheme": F.regexp_extract(F.col(url), "(?s)^(.*?)://", 1),
        "top": F.get(labels, F.size(labels) - 1),
        "domain": F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")),
        "host": host,
        "sub": F.when(F.size(labels) >= 3, F.get(labels, F.lit(0))),
        "first": shape(0),
        "second": shape(1),
        "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]+)/?$", 1),
        "depth": F.when(host != "", F.size(segments).cast("string")),
        "query": F.array_join(names, "&"),
        "fragment": F.when(F.instr(F.col(url), "#") > 0, F.lit("yes")),
    }
    tokens = [F.when(v != "", F.concat(F.lit(f"{k}="), v)) for k, v in kinds.items()]
    return F.coalesce(F.array_compact(F.array(*tokens)), F.array())


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, confidence, support) of rules that end in a block, from rows (url, blocked).

    A rule needs ``min_count`` rows and ``min_support`` of all. Rows without a label (null) teach
    nothing; repeated rows count as often as they occur; without rows there are no rules.
    """
    rows = labelled.filter(F.col("blocked").isNotNull()).select(
        F.concat(url_tokens("url"), F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array(F.lit("label=allow")))).alias("items"))
    rows = materialize(rows, "baskets")
    n = rows.count()
    if n < min_count:
        return rows.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mined = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence,
                     numPartitions=parts).fit(rows)
    found = mined.associationRules.filter(F.col("consequent")[0] == BLOCK)
    return found.select(F.col("antecedent").alias("tokens"), "confidence", "support")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, score): the highest confidence among the rules that each distinct url fires; else no row."""
    tokens = urls.select("url").filter(F.col("url").isNotNull()).distinct().select("url", url_tokens("url").alias("has"))
    rules = materialize(rules.withColumn("rule_id", F.xxhash64(F.array_sort("tokens"))), "rules")
    each = rules.select("rule_id", F.explode("tokens").alias("token"))
    often = materialize(tokens.select(F.explode("has").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "often")
    rarest = each.join(often, "token", "left").groupBy("rule_id").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    index = rarest.join(rules, "rule_id").select("token", "tokens", "confidence")
    met = tokens.select("url", "has", F.explode("has").alias("token")).join(index, "token")
    fired = met.filter(F.size(F.array_except("tokens", "has")) == 0)
    return fired.groupBy("url").agg(F.max("confidence").alias("score"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages`` (page_id, url).

    The longest stated rule decides; without one, a URL that fires a mined rule is blocked and every
    other allowed. A null url, or one without ``://``, has an empty host and path. Other columns are
    ignored. ``labelled`` is as for ``mine_rules``.
    """
    scores = match_rules(pages, mine_rules(labelled)).withColumnRenamed("url", "_url")
    judged = pages.select("page_id", "url").withColumns({"host": url_host("url"), "path": url_path("url")})
    judged = judged.withColumn("_rule", longest_rule("host", "path", rules)).join(scores, F.col("url") == F.col("_url"), "left")
    mined = F.when(F.col("score").isNotNull(), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", mined).alias("verdict"), "score")
