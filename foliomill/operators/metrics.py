"""Run metrics of both definitions. They share names but not meanings, so they stay two functions; see the docstrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def rate(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))


def linear_quantile(x: Column, q: float) -> Column:
    """Interpolated between neighbours; null without values."""
    return F.percentile(x, F.lit(q))


def floor_quantile(x: Column, q: float) -> Column:
    """The lower neighbour, at index floor(q * (n - 1)) of the sorted values: gathers one group's values, so for per-run use."""
    xs = F.sort_array(F.collect_list(x))
    at = F.floor((F.size(xs) - 1) * F.lit(q)).cast("int") + 1
    return F.when(F.size(xs) > 0, F.element_at(xs, F.greatest(at, F.lit(1))))


def floor_quantiles(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """by, lower: the same for groups of any size: counts of values, a running sum over them, and the first value that reaches the rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(by)
    upto = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__all", F.sum("__n").over(w))
    rank = F.floor((F.col("__all") - 1) * F.lit(q)) + 1
    found = upto.where(F.col("__upto") >= rank).groupBy(by).agg(F.min(value).alias("lower"))
    return df.select(by).distinct().alias("g").join(found.alias("f"), F.col(f"g.{by}").eqNullSafe(F.col(f"f.{by}")), "left").select(f"g.{by}", "lower")


def diagnostic(name: str) -> Column:
    """A number kept as text in the diagnostics map; null if absent or no number."""
    return F.try_element_at(F.col("diagnostics"), F.lit(name)).try_cast("double")


def core_metrics(blocks: DataFrame, summaries: DataFrame, errors: DataFrame, headers: DataFrame) -> DataFrame:
    """Per run, the pipeline's own definition: placeholders and kinds over recognised blocks only, error rate over the pages of the
    document, latency over recognised pages, interpolated quantiles."""
    ocr = F.lower("mode") != "embedded"
    flagged = F.coalesce(F.col("flags.placeholder"), F.col("placeholder"), F.lit(False))
    form = F.coalesce(F.col("flags.is_form"), F.lit(False))
    b = blocks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(ocr & flagged).alias("placeholders"),
        F.count_if(ocr & form).alias("form_blocks"),
        F.avg("features.ink_ratio").alias("ink_mean"),
        *(linear_quantile(F.col("features.ink_ratio"), q / 100).alias(f"ink_p{q}") for q in (10, 50, 90)),
    )
    mode = F.lower(F.trim("mode"))
    s = summaries.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("summaries"),
        F.avg(F.when(mode != "embedded", F.col("latency_ms"))).alias("latency_mean"),
        linear_quantile(F.when(mode != "embedded", F.col("latency_ms")), 0.95).alias("latency_p95"),
    )
    # diagnostics of every page, also of those that failed
    pages = summaries.select("run_id", "diagnostics").unionByName(errors.select("run_id", "diagnostics"))
    d = pages.groupBy("run_id").agg(
        F.avg(diagnostic("prep_ms")).alias("prep_mean"),
        linear_quantile(diagnostic("prep_ms"), 0.95).alias("prep_p95"),
        F.avg(diagnostic("boxes")).alias("boxes_mean"),
        linear_quantile(diagnostic("boxes"), 0.95).alias("boxes_p95"),
        F.avg(diagnostic("pr_crops")).alias("printed_crops_mean"),
        F.avg(diagnostic("hw_crops")).alias("handwriting_crops_mean"),
    )
    e = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("errors"))
    out = headers.select("run_id", "doc_id", F.col("pages").alias("header_pages")).join(s, "run_id", "left").join(d, "run_id", "left").join(e, "run_id", "left").join(b, "run_id", "left")
    counts = {"blocks": 0, "placeholders": 0, "form_blocks": 0, "summaries": 0, "errors": 0}
    out = out.fillna(counts)
    pages = F.coalesce("header_pages", F.col("summaries") + F.col("errors"))
    return out.withColumn("pages", pages).withColumns({"placeholder_rate": rate(F.col("placeholders"), F.col("blocks")), "error_rate": rate(F.col("errors"), F.col("pages"))})


def hard_metrics(blocks: DataFrame, summaries: DataFrame, errors: DataFrame) -> DataFrame:
    """Per run, the wrapper's definition: pages are summaries, error rate may exceed 1 and is 0 without summaries, all pages count
    for latency, and p95 is the lower neighbour."""
    flagged = F.coalesce(F.col("flags.placeholder"), F.col("placeholder"), F.lit(False))
    b = blocks.groupBy("run_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(flagged).alias("placeholders"))
    s = summaries.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"), F.avg("latency_ms").alias("latency_mean"), floor_quantile(F.col("latency_ms"), 0.95).alias("latency_p95"))
    e = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("errors"))
    out = s.join(e, "run_id", "full").join(b, "run_id", "full").fillna({"blocks": 0, "placeholders": 0, "pages": 0, "errors": 0})
    return out.withColumns({"placeholder_rate": rate(F.col("placeholders"), F.col("blocks")), "error_rate": rate(F.col("errors"), F.col("pages"))})


def category_counts(df: DataFrame, by: str, column: Column) -> DataFrame:
    """by, category, n: long form of the count maps."""
    return df.select(by, column.alias("category")).groupBy(by, "category").agg(F.count(F.lit(1)).alias("n"))


def count_map(counts: DataFrame, by: str) -> DataFrame:
    """by, counts map<string, bigint>: for the edge, when categories are few."""
    return counts.where("category is not null").groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"))
