"""Ordering operators: runs of rows, reading order, caps and counters, all windows over one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of pixels that a line grows by on both sides.
LINE_PAD = 6


def runs(df: DataFrame, keys: list[str], y: str, pad: int = LINE_PAD, height: Column | None = None) -> DataFrame:
    """keys, y0, y1 (exclusive): maximal runs of consecutive y, grown by pad and cut to the page. Gaps and islands: y minus its rank
    is constant inside a run."""
    island = F.col(y) - F.row_number().over(Window.partitionBy(*keys).orderBy(y))
    found = df.select(*keys, y).distinct().withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(y).alias("a"), F.max(y).alias("b"))
    end = F.col("b") + 1 + pad
    return found.select(*keys, F.greatest(F.col("a") - pad, F.lit(0)).alias("y0"), (end if height is None else F.least(end, height)).alias("y1"))


def inked_rows(df: DataFrame, ink: str, width: str) -> DataFrame:
    """Rows of a page whose ink is more than max(5, 2 % of the width)."""
    return df.where(F.col(ink) > F.greatest(F.lit(5), F.floor(F.col(width) * 0.02).cast("int")))


def reading_order(b: str) -> list[Column]:
    """Top to bottom, then left to right, with a full tie-break."""
    c = lambda n: F.col(f"{b}.{n}")
    return [c("y0"), c("x0"), c("x1"), c("y1"), (c("x1") - c("x0")) * (c("y1") - c("y0"))]


def capped_regions(df: DataFrame, keys: list[str], b: str, cap: int, tie: str) -> DataFrame:
    """The first regions of each page in reading order: a soft cap of twice as many, then without empty ones, then the cap. rank
    counts from 1. row_number with a limit becomes a window group limit, so no page is sorted further than its cap."""
    order = Window.partitionBy(*keys).orderBy(*reading_order(b), tie)
    soft = df.withColumn("__soft", F.row_number().over(order)).where(F.col("__soft") <= 2 * cap)
    full = soft.where((F.col(f"{b}.x1") > F.col(f"{b}.x0")) & (F.col(f"{b}.y1") > F.col(f"{b}.y0")))
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).drop("__soft")


def crop_ids(df: DataFrame, keys: list[str], kind: str, order: list) -> DataFrame:
    """crop_id from 0 over the kept crops of a page, printed before handwriting."""
    hand = F.when(F.col(kind) == "handwriting", 1).otherwise(0)
    return df.withColumn("crop_id", F.row_number().over(Window.partitionBy(*keys).orderBy(hand, *order)) - 1)


def form_cap(max_crops: int) -> int:
    """How many high-resolution handwriting crops a form may have."""
    return max(60, max_crops // 2)


def first_max(df: DataFrame, keys: list[str], order: list, value: Column, n: int = 8) -> DataFrame:
    """keys, top: the largest value among the first n rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__v", value).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).groupBy(*keys).agg(F.max("__v").alias("top"))


def zip_positions(left: DataFrame, right: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Positional pairing of two lists of a page; what one of them has more is left out."""
    return left.join(right, [*keys, position])
