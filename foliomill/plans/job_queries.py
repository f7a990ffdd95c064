"""Queries over the life of jobs, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import jobs as J
from ..session import table, work_dir
from ..streaming import jobs as worker


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "job_message"), table(spark, sf_dir, "job_result")


def job_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last result of each job."""
    return J.latest_results(_jobs(spark, sf_dir)[1]).select("job_id", "status", "attempt", "exit_code")


def idempotent_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid messages still to be worked on."""
    m, r = _jobs(spark, sf_dir)
    return J.pending(m.where(J.is_valid()), r).select("delivery_id", "job_id")


def idempotent_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid messages of jobs that are done."""
    m, r = _jobs(spark, sf_dir)
    return J.skipped(m.where(J.is_valid()), r).groupBy("job_id").agg(F.count(F.lit(1)).alias("messages"))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without what a job needs."""
    return J.split_valid(_jobs(spark, sf_dir)[0])[1].select("delivery_id", "reason")


def retry_dlq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to each result."""
    return J.route(_jobs(spark, sf_dir)[1]).select("job_id", F.coalesce("attempt", F.lit(0)).alias("attempt"), "action", "next_attempt")


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every job asked for."""
    m, r = _jobs(spark, sf_dir)
    return J.statuses(m.where("job_id is not null"), r)


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type."""
    return J.events(*_jobs(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("jobs"))


def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.status_counts(_jobs(spark, sf_dir)[1])


def runtime_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.runtime_histogram(_jobs(spark, sf_dir)[1])


def queue_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.gauges(*_jobs(spark, sf_dir))


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.load_summary(_jobs(spark, sf_dir)[1])


def job_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each message's outputs go."""
    m = _jobs(spark, sf_dir)[0]
    path = [F.col("out_dir"), F.col("out_name"), F.col("pdf_path")]
    return m.select("delivery_id", S.output_path(*path, ".txt").alias("out_txt"), S.output_path(*path, ".jsonl").alias("out_jsonl"), S.is_pdf(F.col("pdf_path")).alias("pdf"))


def in_flight_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each file, the first."""
    m = _jobs(spark, sf_dir)[0].where("pdf_path is not null")
    return J.first_of_content(m, F.regexp_replace(F.lower(F.trim("pdf_path")), "/+", "/")).select("delivery_id")


def job_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages sent as JSON and read again."""
    m = _jobs(spark, sf_dir)[0]
    lines = m.select(F.to_json(F.struct("job_id", "pdf_path", "out_dir", "out_name", "attempt")).alias("value"))
    return J.parse_jobs(lines).groupBy("job_id", "attempt", "out_name").agg(F.count(F.lit(1)).alias("n"))


def _worker(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The worker stream over valid messages with the attempts they came with. Work fails on a job's first attempt if its last sign's
    code is a multiple of 3, on every attempt if it is one of 7; it takes an hour if it is one of 11 and crashes if one of 13."""
    root = work_dir(spark, "worker")
    worker.enqueue(_jobs(spark, sf_dir)[0].where(J.is_valid()), f"{root}/queue")

    def work(jobs: DataFrame) -> DataFrame:
        code = F.ascii(F.right("job_id", F.lit(1)))
        fails = (code % 7 == 0) | ((code % 3 == 0) & (F.col("attempt") == 0))
        exit_code = F.when(code % 13 != 0, F.when(fails, 1).otherwise(F.when(code % 2 == 0, 10).otherwise(0)))
        return jobs.select("job_id", "attempt", exit_code.alias("exit_code"), F.when(code % 11 == 0, 3600.0).otherwise(0.1234).alias("runtime_s"))

    return worker.run_worker(spark, f"{root}/queue", root, work, rounds=4), root


def streaming_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each attempt."""
    out, _ = _worker(spark, sf_dir)
    return out.select("job_id", F.col("attempt").cast("int").alias("attempt"), "status", "action")


def streaming_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worker's log by type."""
    _, root = _worker(spark, sf_dir)
    return spark.read.parquet(f"{root}/events").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def skipped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages received after their job was done, by job."""
    return J.skip_events(*_jobs(spark, sf_dir)).groupBy("job_id", "type").agg(F.count(F.lit(1)).alias("n"))


def inflight_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts running after each second in which one began or ended."""
    return J.inflight(_jobs(spark, sf_dir)[1]).select(F.col("at").cast("string").alias("moment"), "running")


def download_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each result that can be downloaded."""
    r = _jobs(spark, sf_dir)[1].where("out_txt is not null")
    return r.select("job_id", F.coalesce("attempt", F.lit(0)).alias("attempt"), *(S.download_path(F.col("out_txt"), k).alias(k) for k in S.DOWNLOADS)).distinct()


_INTAKE = [("a.pdf", True, "x"), ("B.PDF", True, ""), ("c.txt", True, "x"), ("d.pdf", False, None), ("", None, "y")]


def intake_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which submits are accepted, by path and as an upload."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_INTAKE)], "id int, path string, found boolean, body string")
    return rows.select("id", J.accepts_path(F.col("path"), F.col("found")).alias("by_path"), J.accepts_upload(F.col("body").cast("binary")).alias("by_upload"))


_BLANK = r"[\s\x{A0}]"
_VALID = " AND ".join(f"coalesce(regexp_replace({c}, '{_BLANK}', '', 'g'), '') <> ''" for c in ("job_id", "pdf_path", "out_dir"))
_LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(attempt, 0) DESC, coalesce(finished_at::VARCHAR, '') DESC, coalesce(status, '') DESC) AS rn FROM job_result) WHERE rn = 1)"""
_DONE = "status IN ('success', 'partial')"
_ACTION = f"CASE WHEN {_DONE} THEN 'done' WHEN status IN ('timeout', 'crash') THEN 'dead' WHEN status = 'failed' AND coalesce(attempt, 0) < 2 THEN 'retry' ELSE 'dead' END"
_STEM = r"regexp_replace(regexp_extract(pdf_path, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_OUT = f"regexp_replace(out_dir, '/+$', '') || '/' || coalesce(nullif(trim(out_name), ''), {_STEM})"

_NAMES = (
    "job_status_latest idempotent_pending idempotent_skipped dead_letters retry_dlq_split job_status job_events job_counts runtime_histogram queue_gauges load_summary job_paths in_flight_dedup job_parse streaming_jobs streaming_events "
    "skipped_events inflight_gauge download_paths intake_checks"
)
QUERIES = {n: globals()[n] for n in _NAMES.split()}
# the worker without a stream: batch 0 works on every attempt received, each later one on the retries of the one before, as long as
# nothing is done
_WORKER = f"""
m AS (SELECT DISTINCT job_id, coalesce(attempt, 0) AS attempt, ascii(right(job_id, 1)) AS c FROM job_message WHERE {_VALID}),
w0 AS (SELECT *, CASE WHEN c % 11 = 0 THEN 'timeout' WHEN c % 13 = 0 THEN 'crash' WHEN c % 7 = 0 OR (c % 3 = 0 AND attempt = 0) THEN 'failed' WHEN c % 2 = 0 THEN 'partial' ELSE 'success' END AS status FROM m),
w1 AS (SELECT job_id, attempt + 1 AS attempt, c, CASE WHEN c % 7 = 0 THEN 'failed' WHEN c % 2 = 0 THEN 'partial' ELSE 'success' END AS status FROM w0 a WHERE status = 'failed' AND attempt < 2
  AND NOT EXISTS (SELECT 1 FROM w0 b WHERE b.job_id = a.job_id AND (b.status IN ('success', 'partial') OR b.attempt = a.attempt + 1))),
w2 AS (SELECT job_id, attempt + 1 AS attempt, c, 'failed' AS status FROM w1 a WHERE status = 'failed' AND attempt < 2 AND NOT EXISTS (SELECT 1 FROM w0 b WHERE b.job_id = a.job_id AND b.attempt = a.attempt + 1)),
w AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2)
"""
ORACLES = {
    "streaming_jobs": f"WITH {_WORKER} SELECT job_id, attempt, status, {_ACTION} AS action FROM w",
    "streaming_events": f"""WITH {_WORKER}, e AS (SELECT 'job_started' AS type FROM w UNION ALL SELECT CASE WHEN status = 'timeout' THEN 'job_timeout' WHEN status = 'crash' THEN 'job_crash' ELSE 'job_finished' END FROM w
UNION ALL SELECT 'job_retry' FROM w WHERE {_ACTION} = 'retry'
UNION ALL SELECT 'job_skipped_idempotent' FROM w0 a WHERE status = 'failed' AND attempt < 2 AND EXISTS (SELECT 1 FROM w0 b WHERE b.job_id = a.job_id AND b.status IN ('success', 'partial'))
UNION ALL SELECT 'job_skipped_idempotent' FROM w1 a WHERE status = 'failed' AND attempt < 2 AND EXISTS (SELECT 1 FROM w0 b WHERE b.job_id = a.job_id AND b.status IN ('success', 'partial')))
SELECT type, count(*) AS n FROM e GROUP BY type""",
    "skipped_events": f"""WITH d AS (SELECT job_id, min(finished_at) AS done_at FROM job_result WHERE {_DONE} GROUP BY job_id)
SELECT m.job_id, 'job_skipped_idempotent' AS type, count(*) AS n FROM job_message m JOIN d ON d.job_id = m.job_id WHERE m.received_at > d.done_at GROUP BY ALL""",
    "inflight_gauge": """WITH t AS (SELECT date_trunc('second', finished_at) AS e, date_trunc('second', finished_at - to_microseconds((runtime_s::DECIMAL(18,6) * 1000000)::BIGINT)) AS b FROM job_result WHERE finished_at IS NOT NULL AND runtime_s IS NOT NULL),
s AS (SELECT b AS w, 1 AS d FROM t UNION ALL SELECT e, -1 FROM t), g AS (SELECT w, sum(d) AS d FROM s GROUP BY w)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS moment, (sum(d) OVER (ORDER BY w))::BIGINT AS running FROM g""",
    "download_paths": "SELECT DISTINCT job_id, coalesce(attempt, 0) AS attempt, out_txt AS txt, " + ", ".join(f"regexp_replace(out_txt, '\\.txt$', '') || '{suffix}' AS {kind}" for kind, suffix in S.DOWNLOADS.items() if kind != "txt") + " FROM job_result WHERE out_txt IS NOT NULL",
    "intake_checks": "SELECT * FROM (VALUES (0, true, true), (1, true, false), (2, false, true), (3, false, false), (4, false, true)) v(id, by_path, by_upload)",
    "job_status_latest": f"WITH {_LAST} SELECT job_id, status, attempt, exit_code FROM last",
    "idempotent_pending": f"WITH {_LAST} SELECT delivery_id, job_id FROM job_message WHERE {_VALID} AND job_id NOT IN (SELECT job_id FROM last WHERE {_DONE} AND job_id IS NOT NULL)",
    "idempotent_skipped": f"WITH {_LAST} SELECT job_id, count(*) AS messages FROM job_message WHERE {_VALID} AND job_id IN (SELECT job_id FROM last WHERE {_DONE}) GROUP BY job_id",
    "dead_letters": f"SELECT delivery_id, 'malformed' AS reason FROM job_message WHERE NOT ({_VALID})",
    "retry_dlq_split": f"SELECT job_id, coalesce(attempt, 0) AS attempt, {_ACTION} AS action, CASE WHEN {_ACTION} = 'retry' THEN coalesce(attempt, 0) + 1 END AS next_attempt FROM job_result",
    "job_status": f"WITH {_LAST} SELECT m.job_id, coalesce(l.status, 'queued_or_running') AS status FROM (SELECT DISTINCT job_id FROM job_message WHERE job_id IS NOT NULL) m LEFT JOIN last l ON l.job_id = m.job_id",
    "job_events": f"""WITH e AS (SELECT job_id, 'enqueued' AS type FROM job_message UNION ALL SELECT job_id, 'job_started' FROM job_result
UNION ALL SELECT job_id, CASE WHEN status = 'timeout' THEN 'job_timeout' WHEN status = 'crash' THEN 'job_crash' ELSE 'job_finished' END FROM job_result UNION ALL SELECT job_id, 'job_retry' FROM job_result WHERE {_ACTION} = 'retry')
SELECT type, count(*) AS n, count(DISTINCT job_id) AS jobs FROM e GROUP BY type""",
    "job_counts": "SELECT status, exit_code, count(*) AS n FROM job_result GROUP BY ALL",
    "runtime_histogram": "WITH b(le) AS (VALUES " + ", ".join(f"({float(b)})" for b in J.RUNTIME_BOUNDS) + ") SELECT le::DOUBLE AS le, (SELECT count(*) FROM job_result WHERE runtime_s <= le) AS n FROM b UNION ALL SELECT NULL, count(runtime_s) FROM job_result",
    "queue_gauges": """SELECT count(*) AS queued, count(DISTINCT job_id) AS jobs FROM (SELECT DISTINCT job_id, coalesce(attempt, 0) AS attempt FROM job_message) m
WHERE NOT EXISTS (SELECT 1 FROM job_result r WHERE r.job_id = m.job_id AND coalesce(r.attempt, 0) = m.attempt)""",
    "load_summary": f"""WITH {_LAST} SELECT count(*) AS jobs, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (NOT ({_DONE})) AS failed,
round(count(*) * 1000000.0::DOUBLE / (epoch_us(max(finished_at)) - epoch_us(min(finished_at))), 9) AS jobs_per_s FROM last""",
    "job_paths": f"SELECT delivery_id, {_OUT} || '.txt' AS out_txt, {_OUT} || '.jsonl' AS out_jsonl, coalesce(lower(pdf_path) LIKE '%.pdf', false) AS pdf FROM job_message",
    "in_flight_dedup": "SELECT min(delivery_id) AS delivery_id FROM job_message WHERE pdf_path IS NOT NULL GROUP BY regexp_replace(lower(trim(pdf_path)), '/+', '/', 'g')",
    "job_parse": "SELECT coalesce(job_id, '') AS job_id, coalesce(attempt, 0) AS attempt, nullif(out_name, '') AS out_name, count(*) AS n FROM job_message GROUP BY ALL",
}
