"""Queries of the message queue: exactly one copy of each message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table, work_dir
from ..streaming import dedup


#: Files the queue is read from, and how many make a micro-batch: the stream runs in three of them.
FILES, FILES_PER_BATCH = 12, 4


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """delivery_id of every repeat, by the stateful streaming operator over all of job_message, in three micro-batches."""
    messages, root = table(spark, sf_dir, "job_message"), work_dir(spark, "messages")
    path = dedup.in_batches(messages, FILES, root)
    return dedup.found(spark, path, messages.schema, files_per_batch=FILES_PER_BATCH, root=f"{root}/stream")


def p6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row kept of each message, and the rows without job_id; batch form."""
    kept = dedup.keep_one(table(spark, sf_dir, "job_message"))
    return kept.select("delivery_id", "batch_id", "job_id", "pdf_path", "out_dir", "out_name", "attempt")


_KEYED = r"""
WITH keyed AS (
  SELECT *, regexp_replace(lower(regexp_replace(job_id, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '^$', '') AS k,
         coalesce(attempt, 0) AS a FROM job_message),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, a ORDER BY delivery_id) AS r FROM keyed WHERE k <> '')
"""

QUERIES = {"p6_found": p6_found, "p6_messages": p6_messages}
ORACLES = {
    "p6_found": _KEYED + "SELECT delivery_id FROM ranked WHERE r > 1",
    "p6_messages": _KEYED
    + """SELECT delivery_id, batch_id, job_id, pdf_path, out_dir, out_name, attempt FROM ranked WHERE r = 1
UNION ALL SELECT delivery_id, batch_id, job_id, pdf_path, out_dir, out_name, attempt FROM keyed WHERE k IS NULL OR k = ''""",
}
