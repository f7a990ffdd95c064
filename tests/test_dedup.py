"""Exactly one copy of each message, in whatever order and however many batches it comes."""

import datetime as dt
import random

from foliomill.streaming import dedup

SCHEMA = "delivery_id long, batch_id string, received_at timestamp_ntz, job_id string, pdf_path string, out_dir string, out_name string, attempt int"


def _rows(n=400, seed=1):
    r = random.Random(seed)
    t = dt.datetime(2026, 1, 1)
    jobs = ["hot"] * 150 + [f"Job-{i}" for i in range(60)] + [None, "", "  ", " job-3", "JOB-4 "]
    return [(i, f"b{i // 10}", t + dt.timedelta(minutes=i) if i % 17 else None, r.choice(jobs), "p", "o", None, r.choice([None, 0, 1])) for i in range(n)]


def _expected(rows):
    seen, again = set(), set()
    for row in sorted(rows, key=lambda x: x[0]):
        name = (row[3] or "").strip().lower()
        key = (name, row[7] or 0)
        if name:
            (again.add(row[0]) if key in seen else seen.add(key))
    return again


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rows = _rows()
    want = _expected(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[0] for r in dedup.repeats(df).collect()} == want
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    for i in range(0, len(shuffled), 100):
        spark.createDataFrame(shuffled[i : i + 100], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = dedup.found(spark, f"{tmp_path}/in*", df.schema, files_per_batch=1)
    assert {r[0] for r in got.collect()} == want


def test_state_expires_and_late_copies_are_looked_up(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    batches = [[(1, "b", t, "a", "p", "o", None, 0)], [(2, "b", t + dt.timedelta(days=9), "z", "p", "o", None, 0)], [(3, "b", t + dt.timedelta(days=9), "y", "p", "o", None, 0)], [(4, "b", t, "a", "p", "o", None, 0), (5, "b", t, "A ", "p", "o", None, None)]]
    root = str(tmp_path / "state")
    schema = spark.createDataFrame([], SCHEMA).schema
    out = None
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # one bucket, so that every batch visits it and the expiry needs no sweep
        out = dedup.run_verdicts(spark, f"{tmp_path}/in*", schema, 1, root, watermark="1 minute", keep_ms=86_400_000, buckets=1)
    rows = out.collect()
    assert {r.delivery_id for r in rows if r.verdict == "repeat"} == {4, 5}
    assert spark.read.parquet(f"{root}/raw").where("verdict = 'expired'").count() > 0
    # the copies that came after the expiry were found by the lookup
    assert {r.delivery_id for r in spark.read.parquet(f"{root}/late").collect()} == {4}


def test_registered_query_runs_in_batches_with_expiry(spark, sf, tmp_path):
    """The messages of the smallest table in four micro-batches, of which the later ones see expired identifiers."""
    messages = spark.read.parquet(f"{sf}/job_message.parquet")
    path = dedup.in_batches(messages, 8, str(tmp_path))
    root = str(tmp_path / "stream")
    out = dedup.run_verdicts(spark, path, messages.schema, 2, root, keep_ms=86_400_000)
    got = {r.delivery_id for r in out.where("verdict = 'repeat'").collect()}
    assert got == {r.delivery_id for r in dedup.repeats(messages).collect()}
    raw = spark.read.parquet(f"{root}/raw")
    assert raw.select("batch").distinct().count() == 4
    assert raw.where("verdict = 'expired'").count() > 0


def test_keep_one_with_clashing_columns_nulls_and_no_rows(spark):
    rows = [(2, "a", 0, "x"), (1, " A", None, "y"), (None, "a", 0, "z"), (3, None, 0, "n"), (4, None, 0, "n"), (5, "b", 1, None)]
    df = spark.createDataFrame(rows, "delivery_id long, job_id string, attempt int, key string")
    got = sorted((r.delivery_id, r.key) for r in dedup.keep_one(df).collect())
    assert got == [(1, "y"), (3, "n"), (4, "n"), (5, None)]
    assert dedup.keep_one(df.where("1 = 0")).count() == 0
    assert {r[0] for r in dedup.repeats(df).collect()} == {2}
