"""The worker as a stream: a folder of job messages in, results, dead letters, retries and events out.

Each micro-batch writes to folders named by its number, so a batch that is run again replaces its own output. Retries go
back into the queue folder as new messages; what a job has already reached (success or partial) is skipped. What a batch must know of the
past is a narrow table of finished attempts by key hash, of which it reads the parts its jobs fall into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..schemas import JOB
from ..session import materialize

Work = Callable[[DataFrame], DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def enqueue(jobs: DataFrame, queue: str) -> None:
    """Appends jobs to the queue folder, as JSON lines."""
    jobs.select(F.to_json(F.struct("job_id", "pdf_path", "out_dir", "out_name", "attempt")).alias("value")).write.mode("append").text(queue)


#: Parts of the table of finished attempts, and of the events, by hash of the job.
PARTS = 16


def part_of(job_id: Column) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(PARTS)).cast("int")


def events_of(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """The history of one job, oldest first: reads the part of the log its hash names. The log is appended to and never emptied."""
    part = spark.range(1).select(part_of(F.lit(job_id)).alias("p")).first()[0]
    return spark.read.parquet(f"{root}/events").where((F.col("part") == part) & (F.col("job_id") == job_id)).orderBy("batch", "seq", "attempt")


def run_worker(spark: SparkSession, queue: str, root: str, work: Work, rounds: int = 4, timeout_s: float = 3600.0) -> DataFrame:
    """Consumes the queue until no retry is left, at most rounds times, and returns all results.

    work turns a table of jobs into (job_id, attempt, exit_code, runtime_s); it is where recognition plugs in. An attempt that took
    timeout_s or longer timed out, one without an exit code crashed; both go to the dead letters at once. Of several deliveries of an attempt
    in a batch the one with the smallest fields is worked on.
    """

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        jobs, dead = J.split_valid(J.parse_jobs(batch))
        fields = [f.name for f in JOB.fields if f.name not in ("job_id", "attempt")]
        jobs = jobs.groupBy("job_id", "attempt").agg(F.min(F.struct(*fields)).alias("j")).select("job_id", "attempt", "j.*")
        jobs = materialize(jobs.withColumn("part", part_of(F.col("job_id"))), "jobs")
        skipped = jobs.where("1 = 0")
        if exists(session, f"{root}/finished"):
            parts = [r[0] for r in jobs.select("part").distinct().collect()]  # at most PARTS numbers
            schema = "job_id string, attempt int, status string, part int, batch int"
            old = session.read.schema(schema).parquet(f"{root}/finished").where(F.col("part").isin(parts) & (F.col("batch") < number))
            done = old.where(F.col("status").isin(*J.DONE)).select("job_id").distinct()
            skipped = jobs.join(done, "job_id", "left_semi")
            jobs = jobs.join(done, "job_id", "left_anti").join(old.select("job_id", "attempt"), ["job_id", "attempt"], "left_anti")
        given = jobs.select("job_id", "pdf_path", "out_dir", "out_name", "attempt")
        out = given.join(work(given), ["job_id", "attempt"])
        status = F.when(F.col("runtime_s") >= timeout_s, "timeout").when(F.col("exit_code").isNull(), "crash").otherwise(J.status_of(F.col("exit_code")))
        path = f"{root}/results/batch={number}"
        J.route(out.withColumn("status", status).withColumn("runtime_s", F.round("runtime_s", 3))).write.mode("overwrite").parquet(path)
        written = session.read.parquet(path)
        narrow = written.select("job_id", "attempt", "status", part_of(F.col("job_id")).alias("part"))
        narrow.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/finished/batch={number}")
        reason = F.when(F.col("status").isin("timeout", "crash"), F.col("status")).otherwise("failed")
        lost = written.where("action = 'dead'").select("job_id", "pdf_path", "out_dir", F.lit(None).cast("string").alias("raw"), reason.alias("reason"))
        dead.select("job_id", "pdf_path", "out_dir", "raw", "reason").unionByName(lost).write.mode("overwrite").parquet(f"{root}/dead/batch={number}")
        log = J.log_of(given, skipped, written).withColumn("part", part_of(F.col("job_id")))
        log.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/events/batch={number}")
        again = written.where("action = 'retry'").select("job_id", "pdf_path", "out_dir", "out_name", F.col("next_attempt").alias("attempt"))
        again.select(F.to_json(F.struct(*(f.name for f in JOB.fields))).alias("value")).write.mode("overwrite").text(f"{queue}/retry-{number}")

    for _ in range(rounds):
        source = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(queue)
        query = source.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{root}/results")
