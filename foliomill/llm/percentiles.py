"""Percentiles of very large numeric columns by SQL cumulative frequencies.

The state that partitions, days or runs exchange is a table of group-value counts (`summarise`). Summaries are combined by adding
counts (`combine`), and `percentiles` turns a summary into order statistics: it is range-sorted by group and value, whose range bounds
come from a sample of the summary; each range gets the count before it as offset, a window adds running sums inside the range, and
the first value whose cumulative count reaches ceil(q * n) is picked.

Error. With digits=None values are counted as they are, of whatever numeric type, and the result is an exact order statistic: error bound
0. With digits=d a value keeps its d leading binary digits (HDR grid), a summary then has at most 2**d rows an octave whatever
the input, and the bound given is the width of the grid cell of the picked value, at most value * 2**(1-d). Integers never lose
a unit by the grid below 2**d; fractional values are kept on a grid of their own octaves, also below 1.

Skew. Counts are aggregated before the shuffle, so a group that holds a third of all rows sends its distinct values only, and the
ranges cut a group of many values wherever its values lie. The cumulative windows are partitioned by (group, range), never by group alone.

Defined cases. Null, NaN, infinite and negative values are no measurements and are left out; a group without measurements has no
row. Null group keys form a group of their own. Repeated rows count as often as they occur; ties share one value. An empty table
gives an empty result. Only the columns named are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def grid_floor(value: Column, digits: int | None, whole: bool = True) -> Column:
    """The lower end of the value's grid cell."""
    if digits is None:
        return value
    width = grid_width(value, digits, whole)
    return value - value % width if whole else F.when(value > 0, F.floor(value / width) * width).otherwise(value)


def grid_width(value: Column, digits: int | None, whole: bool = True) -> Column:
    """Width of the value's grid cell, a power of two: of integers 1 below 2**digits; 0 if there is no grid or the value is 0."""
    if digits is None:
        return F.lit(0).cast("long" if whole else "double")
    if whole:
        return F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - digits, F.lit(0))).cast("long")
    return F.when(value > 0, F.pow(F.lit(2.0), F.floor(F.log2(value)) + 1 - digits)).otherwise(0.0)


def is_whole(df: DataFrame, column: str = "value") -> bool:
    return dict(df.dtypes)[column] in _WHOLE


def summarise(df: DataFrame, value: Column, groups: dict[str, Column], digits: int | None = None) -> DataFrame:
    """Group-value counts: the groups' columns, value and n. Integers are kept as bigint, decimals as they are, other numbers as double."""
    kept = df.select(*(c.alias(g) for g, c in groups.items()), value.alias("value"))
    kind = dict(kept.dtypes)["value"]
    whole = kind in _WHOLE
    if whole or not (digits is None and kind.startswith("decimal")):
        kept = kept.withColumn("value", F.col("value").cast("long" if whole else "double"))
    kept = kept.where(F.col("value") >= 0)
    if dict(kept.dtypes)["value"] == "double":
        kept = kept.where(F.col("value") < float("inf"))  # NaN is the greatest
    kept = kept.withColumn("value", grid_floor(F.col("value"), digits, whole))
    return kept.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def combine(summary: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds up summaries, or a summary over the groups not named."""
    return summary.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles(summary: DataFrame, groups: Sequence[str], per_mille: Sequence[int], digits: int | None = None) -> DataFrame:
    """One row per group: n, one column p<per mille> for each rank (the lower end of the cell), and error_bound, the largest
    distance of any of them to the exact order statistic."""
    by, whole = list(groups), is_whole(summary)
    # the range sort; written once, so that every row keeps its range in all that follows
    ranged = summary.repartitionByRange(*by, "value").withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "value-ranges")
    # offset of each range: a window over the few rows of (group, range)
    totals = ranged.groupBy(*by, "__range").agg(F.sum("n").alias("__in"))
    w = Window.partitionBy(*by).orderBy("__range")
    totals = totals.select(
        *by,
        "__range",
        (F.sum("__in").over(w) - F.col("__in")).alias("__offset"),
        F.sum("__in").over(Window.partitionBy(*by)).alias("__n"),
        F.col("__in"),
    )
    # ranges that hold a wanted rank; only their values need running sums
    ranks = [((F.col("__n") * q + 999) / 1000).cast("long") for q in per_mille]
    holds = F.array(*(F.when((r > F.col("__offset")) & (r <= F.col("__offset") + F.col("__in")), r) for r in ranks))
    wanted = totals.withColumn("__ranks", holds).where(F.exists("__ranks", lambda r: r.isNotNull()))
    a, b = ranged.alias("a"), wanted.alias("b")
    on = F.col("a.__range") == F.col("b.__range")
    for g in by:
        on = on & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = a.join(b, on).select(*(f"a.{g}" for g in by), "a.__range", "value", "n", "__offset", "__n", "__ranks")
    inside = Window.partitionBy(*by, "__range").orderBy("value")
    running = joined.withColumn("__upto", F.col("__offset") + F.sum("n").over(inside))
    picks = []
    for i, q in enumerate(per_mille):
        hit = (F.col("__ranks")[i] > F.col("__upto") - F.col("n")) & (F.col("__ranks")[i] <= F.col("__upto"))
        picks.append(F.max(F.when(hit, F.col("value"))).alias(f"p{q}"))
    picked = running.groupBy(*by).agg(F.max("__n").alias("n"), *picks)
    names = [f"p{q}" for q in per_mille]
    # an integer is at most its cell's width less one above the lower end
    widths = [grid_width(F.col(c), digits, whole) - (1 if whole and digits is not None else 0) for c in names]
    bound = F.greatest(*widths) if len(widths) > 1 else widths[0]
    return picked.select(*by, "n", *names, bound.alias("error_bound"))
