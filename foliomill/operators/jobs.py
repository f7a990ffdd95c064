"""The life of a job: intake, idempotence, status, retry and dead letters, events, and what is counted about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import is_pdf
from ..functions.text import strip_ws

# Exit codes, retries and the histogram's bounds in seconds.
MAX_RETRIES = 2
RUNTIME_BOUNDS = (1, 2, 5, 10, 20, 30, 60, 120, 180, 240, 300, 420, 540, 610)
DONE = ("success", "partial")


def status_of(exit_code: Column) -> Column:
    return F.when(exit_code == 0, "success").when(exit_code == 10, "partial").otherwise("failed")


def parse_jobs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Jobs of JSON payloads: absent fields become '' or 0, an empty out_name null; what is no JSON object has raw kept and no job_id."""
    j = F.from_json(F.col(column), "job_id string, pdf_path string, out_dir string, out_name string, attempt string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    j = lines.select(F.col(column).alias("raw"), j.alias("j"))
    text = lambda n: F.coalesce(F.col(f"j.{n}"), F.lit(""))
    return j.select(
        "raw",
        text("job_id").alias("job_id"),
        text("pdf_path").alias("pdf_path"),
        text("out_dir").alias("out_dir"),
        F.nullif(F.col("j.out_name"), F.lit("")).alias("out_name"),
        F.coalesce(F.col("j.attempt").try_cast("int"), F.lit(0)).alias("attempt"),
    )


def is_valid(df: DataFrame | None = None) -> Column:
    """A job needs job_id, pdf_path and out_dir."""
    given = lambda n: F.coalesce(strip_ws(F.col(n)) != "", F.lit(False))
    return given("job_id") & given("pdf_path") & given("out_dir")


def split_valid(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, dead letters)."""
    return jobs.where(is_valid()), jobs.where(~is_valid()).withColumn("reason", F.lit("malformed"))


def accepts_path(path: Column, exists: Column | None = None) -> Column:
    """Whether a path may be submitted: a .pdf, of a file that exists where that is known."""
    return is_pdf(path) if exists is None else is_pdf(path) & F.coalesce(exists, F.lit(False))


def accepts_upload(content: Column) -> Column:
    """Whether an upload may be submitted: its body isn't empty, whatever its name."""
    return F.coalesce(F.octet_length(content) > 0, F.lit(False))


def latest_results(results: DataFrame) -> DataFrame:
    """The last result of each job: by attempt, then time. max_by over one ordered struct aggregates before the shuffle."""
    cols = [c for c in results.columns if c != "job_id"]
    order = F.struct(F.coalesce("attempt", F.lit(0)).alias("a"), F.coalesce(F.col("finished_at").cast("string"), F.lit("")).alias("t"), F.coalesce("status", F.lit("")).alias("s"))
    return results.groupBy("job_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("job_id", *(F.col(f"r.{c}") for c in cols))


def pending(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs whose last result isn't success or partial: these are not worked on again. Semi and anti joins shuffle keys only."""
    done = latest_results(results).where(F.col("status").isin(*DONE)).select("job_id")
    return jobs.join(done, "job_id", "left_anti")


def skipped(jobs: DataFrame, results: DataFrame) -> DataFrame:
    done = latest_results(results).where(F.col("status").isin(*DONE)).select("job_id")
    return jobs.join(done, "job_id", "left_semi")


def route(results: DataFrame) -> DataFrame:
    """results with action: 'done', 'retry' with next_attempt while attempts are left, else 'dead'; timeouts and crashes are dead at once."""
    attempt = F.coalesce("attempt", F.lit(0))
    action = F.when(F.col("status").isin(*DONE), "done").when(F.col("status").isin("timeout", "crash"), "dead").when((F.col("status") == "failed") & (attempt < MAX_RETRIES), "retry").otherwise("dead")
    return results.withColumn("action", action).withColumn("next_attempt", F.when(F.col("action") == "retry", attempt + 1))


def statuses(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """job_id, status of every job asked for; without a result it is queued or running."""
    return jobs.select("job_id").distinct().join(latest_results(results).select("job_id", "status"), "job_id", "left").select("job_id", F.coalesce("status", F.lit("queued_or_running")).alias("status"))


def events(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """job_id, type, at: the append-only history, one row for each thing that happened."""
    start = F.col("finished_at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce("runtime_s", F.lit(0.0)).cast("decimal(18,6)"))
    queued = jobs.select("job_id", F.lit("enqueued").alias("type"), F.col("received_at").alias("at"))
    begun = results.select("job_id", F.lit("job_started").alias("type"), start.alias("at"))
    ended = route(results).select(
        "job_id",
        F.explode(F.when(F.col("action") == "retry", F.array(F.lit("job_finished"), F.lit("job_retry"))).when(F.col("status") == "timeout", F.array(F.lit("job_timeout"))).when(F.col("status") == "crash", F.array(F.lit("job_crash"))).otherwise(F.array(F.lit("job_finished")))).alias("type"),
        F.col("finished_at").alias("at"),
    )
    return queued.unionByName(begun).unionByName(ended)


def log_of(given: DataFrame, skipped: DataFrame, results: DataFrame) -> DataFrame:
    """job_id, attempt, seq, type: what happened to the jobs of a batch, seq in the order of a job's life."""
    ended = (
        F.when(F.col("action") == "retry", F.array(F.lit("job_finished"), F.lit("job_retry")))
        .when(F.col("status") == "timeout", F.array(F.lit("job_timeout")))
        .when(F.col("status") == "crash", F.array(F.lit("job_crash")))
        .otherwise(F.array(F.lit("job_finished")))
    )
    of = lambda df, seq, name: df.select("job_id", "attempt", F.lit(seq).alias("seq"), F.lit(name).alias("type"))
    ends = results.select("job_id", "attempt", F.posexplode(ended).alias("p", "type")).select("job_id", "attempt", (F.col("p") + 2).alias("seq"), "type")
    return of(given, 1, "job_started").unionByName(ends).unionByName(of(skipped, 0, "job_skipped_idempotent"))


def skip_events(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """job_id, type, at: messages received after their job was done, which are skipped."""
    done = results.where(F.col("status").isin(*DONE)).groupBy("job_id").agg(F.min("finished_at").alias("done_at"))
    late = jobs.join(done, "job_id").where(F.col("received_at") > F.col("done_at"))
    return late.select("job_id", F.lit("job_skipped_idempotent").alias("type"), F.col("received_at").alias("at"))


def inflight(results: DataFrame) -> DataFrame:
    """at, running: how many attempts are running after each start or end. Sums per second come first, so the one ordered window runs over
    at most as many rows as there are seconds in the history, whatever the number of jobs."""
    timed = results.where(F.col("finished_at").isNotNull() & F.col("runtime_s").isNotNull())
    end = F.date_trunc("second", "finished_at")
    begin = F.date_trunc("second", F.col("finished_at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("runtime_s").cast("decimal(18,6)")))
    steps = timed.select(begin.alias("at"), F.lit(1).alias("d")).unionByName(timed.select(end.alias("at"), F.lit(-1).alias("d")))
    per_second = steps.groupBy("at").agg(F.sum("d").alias("d"))
    per_day = per_second.groupBy(F.to_date("at").alias("day")).agg(F.sum("d").alias("day_sum"))
    before = per_day.select("day", (F.sum("day_sum").over(Window.orderBy("day")) - F.col("day_sum")).alias("before"))  # a row a day
    within = F.sum("d").over(Window.partitionBy(F.to_date("at")).orderBy("at"))
    both = per_second.withColumn("within", within).withColumn("day", F.to_date("at")).join(before, "day")
    return both.select("at", (F.col("before") + F.col("within")).alias("running"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status", "exit_code").agg(F.count(F.lit(1)).alias("n"))


def runtime_histogram(results: DataFrame) -> DataFrame:
    """le, n: cumulative counts per bound and in all (le is null). One pass of conditional counts, no join with the bounds."""
    aggs = [F.count_if(F.col("runtime_s") <= b).alias(f"b{i}") for i, b in enumerate(RUNTIME_BOUNDS)] + [F.count("runtime_s").alias("all")]
    one = results.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(RUNTIME_BOUNDS)), F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def gauges(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """queued: messages whose attempt has no result; one row."""
    left = jobs.select("job_id", F.coalesce("attempt", F.lit(0)).alias("attempt")).distinct().join(results.select("job_id", F.coalesce("attempt", F.lit(0)).alias("attempt")), ["job_id", "attempt"], "left_anti")
    return left.agg(F.count(F.lit(1)).alias("queued"), F.countDistinct("job_id").alias("jobs"))


def load_summary(results: DataFrame) -> DataFrame:
    """ok, partial, failed and jobs a second of the latest results over the time they span; one row."""
    last = latest_results(results)
    seconds = F.unix_micros(F.max("finished_at").cast("timestamp")) - F.unix_micros(F.min("finished_at").cast("timestamp"))
    n = F.count(F.lit(1))
    return last.agg(
        n.alias("jobs"),
        F.count_if(F.col("status") == "success").alias("ok"),
        F.count_if(F.col("status") == "partial").alias("partial"),
        F.count_if(~F.col("status").isin(*DONE)).alias("failed"),
        F.round(F.try_divide(n * 1_000_000.0, seconds), 9).alias("jobs_per_s"),
    )


def first_of_content(jobs: DataFrame, content: Column) -> DataFrame:
    """One job per content, the one received first: submits of the same file while it is in flight are dropped too."""
    w = Window.partitionBy("__content").orderBy("delivery_id")
    return jobs.withColumn("__content", content).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__content")
