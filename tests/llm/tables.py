"""Small tables with the odd cases every operator has to take."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 977} again" for i in range(60_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that results use as names of their own.
CLASHING = ["score", "lang_pred", "n_lines", "n_deleted", "rep", "doc", "part", "kind", "component_id", "_text", "item"]


def odd_documents(spark, clashing: bool = False):
    rows = [
        (None, "a text without an id, of more than five words", "en", None, None),
        (1, None, "en", "s", 0),
        (2, "", "en", "s", 0),
        (3, " \t\n ", None, "s", 4),
        (4, "1234 !!! ???", "en", "s", 12),
        (5, "Il était une fois un très petit texte", "fr", "s", 37),
        (5, "Il était une fois un très petit texte", "fr", "s", 37),
        (6, "two words", "en", "s", 9),
        (7, LONG, "en", "s", len(LONG)),
        (8, "the same words stand here in this line\nand then a second line of it", "en", "s", 70),
        (9, "the same words stand here in this line\nand then a second line of it", "en", "s", 70),
        (10, "<|endoftext|> and a special string <|startoftext|>", "en", "s", 50),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("mine") for c in CLASHING})
    return df


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))
