"""Comparison of a run with its baseline: distribution divergence, deltas and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Alert thresholds, all of them strict.
JUNK_FLOOR, JUNK_FACTOR, LATENCY_FACTOR, MIX_SHIFT = 0.08, 1.8, 1.5, 0.18


def shares(counts: DataFrame, by: str) -> DataFrame:
    """by, category, share of long-form counts; groups of sum 0 have no rows."""
    total = F.sum("n").over(Window.partitionBy(by))
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), total)).where("share is not null").select(by, "category", "share")


def divergences(pairs: DataFrame, left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """pair, core, hard: Jensen-Shannon divergence in bits of the category distributions of two groups, by both definitions.

    pairs has pair, a, b (groups of left and right). With one side empty the definitions differ: 0.5 where the missing side
    counts as a zero vector in the mean (core), 0.0 where it stops the comparison (hard); both empty give 0.
    """
    a = pairs.join(shares(left, by), pairs["a"] == F.col(by)).select("pair", "category", F.col("share").alias("p"), F.lit(0.0).alias("q"))
    b = pairs.join(shares(right, by), pairs["b"] == F.col(by)).select("pair", "category", F.lit(0.0).alias("p"), F.col("share").alias("q"))
    # union and sum is the full outer join on (pair, category) with one shuffle, and partial sums before it
    both = a.unionByName(b).groupBy("pair", "category").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    js = both.groupBy("pair").agg((F.sum(term(F.col("p"))) / 2 + F.sum(term(F.col("q"))) / 2).alias("js"), F.sum("p").alias("pa"), F.sum("q").alias("qb"))
    one_empty = (F.col("pa") == 0) | (F.col("qb") == 0)
    out = js.select("pair", *(F.when(one_empty, F.lit(x)).otherwise(F.col("js")).alias(n) for n, x in (("core", 0.5), ("hard", 0.0))))
    return pairs.select("pair").join(out, "pair", "left").fillna({"core": 0.0, "hard": 0.0})


def divergence(pairs: DataFrame, left: DataFrame, right: DataFrame, by: str, empty_side: float) -> DataFrame:
    """pair, js: the divergence of one definition, by what an empty side counts: 0.5 (core) or 0.0 (hard)."""
    return divergences(pairs, left, right, by).select("pair", F.col("core" if empty_side else "hard").alias("js"))


def baselines(headers: DataFrame) -> DataFrame:
    """pair, a (baseline run), b: each later run of a document with the document's first run, which is created once and never replaced."""
    order = Window.partitionBy("doc_id").orderBy("ts_utc", "run_id")
    first = headers.withColumn("a", F.first("run_id").over(order)).where(F.col("run_id") != F.col("a"))
    return first.select(F.col("run_id").alias("pair"), "a", F.col("run_id").alias("b"))


def alert_list(core: bool) -> Column:
    """array<struct<id, why>> of a row with error_rate, errors, placeholder_rate, base_placeholder_rate, latency_ratio, js_script, js_mode."""

    def alert(cond: Column, name: str, why: str) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("id"), F.lit(why).alias("why")))

    errors = F.col("error_rate") > 0 if core else F.col("errors") > 0
    found = [
        alert(errors, "P1_PAGE_ERRORS", "pages failed"),
        alert(F.col("placeholder_rate") > F.greatest(F.lit(JUNK_FLOOR), F.col("base_placeholder_rate") * JUNK_FACTOR), "P1_JUNK_SPIKE", "more junk than the baseline"),
        *([alert(F.col("latency_ratio") > LATENCY_FACTOR, "P2_LATENCY_REGRESSION", "slower than the baseline")] if core else []),
        alert(F.col("js_script") > MIX_SHIFT, "P2_SCRIPT_MIX_SHIFT", "scripts differ from the baseline"),
        alert(F.col("js_mode") > MIX_SHIFT, "P2_PAGE_MODE_SHIFT", "page modes differ from the baseline"),
    ]
    return F.array_compact(F.array(*found))


def deviations(metrics: DataFrame, pairs: DataFrame, js_script: DataFrame, js_mode: DataFrame, core: bool = True) -> DataFrame:
    """One row per compared run: deltas to its baseline and the alerts they raise."""
    now, base = metrics.alias("n"), metrics.alias("o")
    both = pairs.join(now, F.col("b") == F.col("n.run_id")).join(base, F.col("a") == F.col("o.run_id"))
    ratio = F.when(F.col("o.latency_mean") > 0, F.col("n.latency_mean") / F.col("o.latency_mean"))
    rows = both.select(
        "pair",
        F.col("a").alias("baseline_run"),
        F.col("n.errors").alias("errors"),
        F.col("n.error_rate").alias("error_rate"),
        F.col("n.placeholder_rate").alias("placeholder_rate"),
        F.col("o.placeholder_rate").alias("base_placeholder_rate"),
        (F.col("n.placeholder_rate") - F.col("o.placeholder_rate")).alias("placeholder_rate_abs"),
        (F.col("n.error_rate") - F.col("o.error_rate")).alias("error_rate_abs"),
        ratio.alias("latency_ratio"),
    )
    rows = rows.join(js_script.select("pair", F.col("js").alias("js_script")), "pair").join(js_mode.select("pair", F.col("js").alias("js_mode")), "pair")
    return rows.withColumn("alerts", alert_list(core))


def deltas(core: bool) -> Column:
    """map<string, double> of a compared run: what changed against its baseline; the hard form has no latency."""
    names = ["js_script", "js_mode", "placeholder_rate_abs", "error_rate_abs"]
    pairs = [F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names]
    if core:
        pairs.append(F.when(F.col("latency_ratio").isNotNull(), F.struct(F.lit("page_latency_mean_ratio").alias("key"), F.col("latency_ratio").alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def report(compared: DataFrame, core: bool = True) -> DataFrame:
    """run_id, value: the deviation report of each compared run as one pretty JSON document."""
    body = F.struct(F.col("pair").alias("run_id"), F.col("baseline_run"), F.lit(False).alias("baseline_created"), F.col("alerts"), deltas(core).alias("deltas"))
    return compared.select(F.col("pair").alias("run_id"), F.to_json(body, {"pretty": "true"}).alias("value"))
