"""Words with boxes on pages: lines, label-to-value joins, anchors with bands, spans.

A word row has a page key and text, x0, y0, x1, y1 (y grows downwards).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(words: DataFrame, page: list[str], line: list[str], order: str) -> DataFrame:
    """Words of a line joined in order, with the union of their boxes."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("text"))))
    box = [f("x0").alias("x0") if f is F.min else f("x1").alias("x1") for f in (F.min, F.max)]
    return words.groupBy(*page, *line).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), *box, F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def right_of(words: DataFrame, labels: DataFrame, page: list[str], gap: float = 40.0) -> DataFrame:
    """For each label box, the words on its row to the right, chained while the gap is at most `gap`.

    On the same row: middles at most max(0.6 of the label's height, 4) apart; to
    the right: not more than 2 before the label's end.
    """
    label = labels.select(*page, F.col("text").alias("label"), *[F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    near = F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("ly0") + F.col("ly1")) / 2) <= F.greatest(0.6 * (F.col("ly1") - F.col("ly0")), F.lit(4.0))
    rows = words.join(label, page).where(near & (F.col("x0") >= F.col("lx1") - 2))
    w = Window.partitionBy(*page, "label", "lx0", "ly0").orderBy("x0", "text")
    jump = (F.col("x0") - F.coalesce(F.lag("x1").over(w), F.col("lx1")) > gap).cast("int")
    rows = rows.withColumn("_jump", jump).withColumn("_run", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_run = 0")
    parts = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return rows.groupBy(*page, "label", "lx0", "ly0").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("value"))


def anchored_bands(regions: DataFrame, anchors: DataFrame, page: list[str], least: float = 0.6, pin: str = "[1-9][0-9]{5}") -> DataFrame:
    """Regions right of an anchor: its own band (8 above to 4 below), 32 below as continuation, 55 below
    only for a PIN code that the others lack; dropped where mean or least confidence is below `least`."""
    anchor = anchors.select(*page, *[F.col(c).alias(f"a{c}") for c in ("x1", "y0", "y1")])
    rows = regions.join(anchor, page).where(F.col("x0") >= F.col("ax1"))
    band = F.when(F.col("y0").between(F.col("ay0") - 8, F.col("ay1") + 4), 0).when(F.col("y0").between(F.col("ay1") + 4, F.col("ay1") + 32), 1).when(F.col("y0").between(F.col("ay1") + 32, F.col("ay1") + 55), 2)
    rows = rows.withColumn("band", band).where("band is not null")
    keys = [*page, "ax1", "ay0"]
    has_pin = F.max(F.when(F.col("band") < 2, F.col("text").rlike(pin)).otherwise(False)).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_pin", has_pin).where((F.col("band") < 2) | (~F.col("_pin") & F.col("text").rlike(pin)))
    parts = F.array_sort(F.collect_list(F.struct("band", "y0", "x0", "text")))
    out = rows.groupBy(*keys).agg(F.array_join(F.array_distinct(F.transform(parts, lambda p: p["text"])), " ").alias("value"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("least_confidence"))
    return out.where((F.col("mean_confidence") >= least) & (F.col("least_confidence") >= least))


def shortest_span(words: Column, value: Column, most: int = 12) -> Column:
    """Struct (size, start) of the shortest run of at most `most` words whose joined text holds value; null if none does."""
    n = F.size(words)
    spans = F.flatten(
        F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i + k - 1 <= n), lambda i: F.struct(k.alias("size"), i.alias("start"))))
    )
    return F.array_min(F.filter(spans, lambda s: F.contains(F.array_join(F.slice(words, s["start"], s["size"]), " "), value)))


def union_box(boxes: Column) -> Column:
    """Struct of the smallest box around an array of boxes."""

    def edge(name: str) -> Column:
        return (F.array_min if name in ("x0", "y0") else F.array_max)(F.transform(boxes, lambda b: b[name])).alias(name)

    return F.struct(*[edge(c) for c in ("x0", "y0", "x1", "y1")])
