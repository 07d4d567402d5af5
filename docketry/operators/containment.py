"""Passages of one table within the texts of another, by word n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import text

GRAM = 8


def _words(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, w): words of the normal form; the explode holds them, so that nothing above computes them again."""
    split = F.filter(F.split(text.normalised(F.col(body)), " "), lambda x: x != "")
    return rows.select(F.col(key), F.explode(F.array(split)).alias("w")).where(F.size("w") > 0)


def _grams(words: DataFrame, key: str, size: int) -> DataFrame:
    """(key, at, h): a 64-bit hash of each n-gram; a shorter text is one gram."""
    places = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return words.select(key, F.posexplode(F.transform(places, lambda i: F.xxhash64(F.slice("w", i, size)))).alias("at", "h"))


def shared_passages(docs: DataFrame, doc: str, items: DataFrame, item: str, body: str, size: int = GRAM) -> DataFrame:
    """(doc, item): texts of docs that hold any n-gram of an item.

    Only hashes and places are shuffled (or none, where the items' hashes are few
    enough to broadcast by Spark's own bound); the words of hits are compared.
    Null and wordless texts hold nothing; an item shorter than a gram is found
    only where it is the whole text.
    """
    words, wanted = _words(docs, doc, body), _words(items, item, body)
    grams = wanted.select(item, F.explode(F.array(F.col("w"))).alias("iw"))
    places = F.sequence(F.lit(1), F.greatest(F.size("iw") - (size - 1), F.lit(1)))
    grams = grams.select(item, F.explode(F.transform(places, lambda i: F.slice("iw", i, size))).alias("gram")).distinct()
    hits = _grams(words, doc, size).join(grams.select(item, "gram", F.xxhash64("gram").alias("h")), "h").select(doc, item, "at", "gram")
    sure = words.join(hits, doc).where(F.slice("w", F.col("at") + 1, F.lit(size)) == F.col("gram"))
    return sure.select(doc, item).distinct()
