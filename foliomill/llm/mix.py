"""Mixing sources to target weights.

Tokens are summed per source; the repetition rate of a source is target_share * M / tokens, where M, the size of the mix, is the
largest at which no rate exceeds its max_repeat (or the size asked for, if smaller). Each document is then emitted floor(rate)
times plus once more if its seeded hash, uniform on [0, 1), is below the fraction: no shuffle, the same result on every run, and
never more than max_repeat copies. Few long documents can make a plain Bernoulli draw miss its share by some per cent, so the
limit the hash is held against is then calibrated: tokens are summed per source and hash bin, and the bin boundary is taken at
which the extra copies hold nearest to fraction * tokens.

Defined cases. Rows whose source is null or has no target are no part of the mix. A target without tokens, with a share or
max_repeat that is null or not positive, is reported with rate 0; the others then keep their proportions. Documents of no
tokens are emitted at their source's rate. An empty table gives an empty mix. A source named twice in the targets is an error
of the targets: the first by (share, max_repeat) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of mix targets: a configuration table; a larger one is refused, because rates are broadcast.
MAX_SOURCES = 100_000


#: Hash bins of the calibration; a source has at most so many rows in it.
BINS = 1 << 16


def uniform(seed: int, *columns: str) -> Column:
    """A hash of the columns, uniform on [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") * F.lit(2.0**-53)


def rates(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """source, target_share, max_repeat, tokens_available, rate for each target. sized: doc_id, source, tokens."""
    if targets.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    one = targets.groupBy("source").agg(F.min(F.struct("target_share", "max_repeat")).alias("t")).select("source", "t.*")
    have = sized.join(F.broadcast(one.select("source")), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens_available"))
    both = one.join(have, "source", "left").withColumn("tokens_available", F.coalesce("tokens_available", F.lit(0).cast("long")))
    usable = (F.col("target_share") > 0) & (F.col("max_repeat") > 0) & (F.col("tokens_available") > 0)
    limit = F.when(usable, F.col("max_repeat") * F.col("tokens_available") / F.col("target_share"))
    size = F.min(limit).over(Window.partitionBy())  # over the targets, a table of at most MAX_SOURCES rows
    if total is not None:
        size = F.least(size, F.lit(float(total)))
    rate = F.when(usable, F.least(F.round(F.col("target_share") * size / F.col("tokens_available"), 9), F.col("max_repeat").cast("double")))
    return both.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def calibrate(sized: DataFrame, rate_table: DataFrame, seed: int = 17) -> DataFrame:
    """rate_table with the limit below which a document's hash earns it one more copy."""
    part = F.col("rate") - F.floor("rate")
    want = rate_table.select("source", (part * F.col("tokens_available")).alias("want"), part.alias("part"))
    bins = sized.select("source", F.floor(uniform(seed, "doc_id", "source") * BINS).cast("int").alias("bin"), "tokens")
    sums = bins.join(F.broadcast(want), "source").where("part > 0").groupBy("source", "bin").agg(F.sum("tokens").alias("t"), F.first("want").alias("want"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("bin"))
    near = sums.withColumn("upto", upto)
    limits = near.groupBy("source").agg(
        F.min_by("bin", F.struct(F.abs(F.col("upto") - F.col("want")), F.col("bin"))).alias("bin"), F.min(F.abs(F.col("upto") - F.col("want"))).alias("gap"), F.first("want").alias("want")
    )
    limit = F.when(F.col("want") < F.col("gap"), 0.0).otherwise((F.col("bin") + 1) / F.lit(float(BINS)))
    return rate_table.join(F.broadcast(limits.select("source", limit.alias("limit"))), "source", "left").fillna({"limit": 0.0})


def emit(sized: DataFrame, rate_table: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, copy (1, 2, ...), tokens."""
    known = sized.join(F.broadcast(rate_table.select("source", "rate", "limit")), "source")
    whole = F.floor("rate").cast("int")
    more = F.when(uniform(seed, "doc_id", "source") < F.col("limit"), 1).otherwise(0)
    n = known.withColumn("copies", whole + more).where("copies > 0")
    return n.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "tokens")


def shares(sized: DataFrame, rate_table: DataFrame, seed: int = 17) -> DataFrame:
    """What was reached, per target: rows and tokens emitted, the actual share and its distance to the target."""
    got = emit(sized, rate_table, seed).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows_emitted"), F.sum("tokens").alias("tokens_emitted"), F.max("copy").alias("most_copies")
    )
    both = rate_table.join(F.broadcast(got), "source", "left")  # as many rows as targets
    zero = {"rows_emitted": 0, "tokens_emitted": 0, "most_copies": 0}
    actual = F.try_divide(F.col("tokens_emitted").cast("double"), F.sum("tokens_emitted").over(Window.partitionBy()))
    return both.fillna(zero).withColumn("actual_share", F.coalesce(actual, F.lit(0.0)))
