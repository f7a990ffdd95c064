import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from foliomill.operators import drift, imaging, jobs, metrics, records, recognise, segment
from foliomill.sources import files
from foliomill.streaming import jobs as worker


def test_divergence_of_empty_sides(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 3), ("b", "y", 1), ("c", "z", 4)], "run string, category string, n long")
    pairs = spark.createDataFrame([("same", "a", "b"), ("apart", "a", "c"), ("one", "a", "none"), ("none", "no", "none")], "pair string, a string, b string")
    core = {r.pair: r.js for r in drift.divergence(pairs, counts, counts, "run", 0.5).collect()}
    hard = {r.pair: r.js for r in drift.divergence(pairs, counts, counts, "run", 0.0).collect()}
    assert core["same"] == 0 and abs(core["apart"] - 1) < 1e-12 and core["one"] == 0.5 and core["none"] == 0
    assert hard["one"] == 0


def test_alert_thresholds_are_strict(spark):
    cols = "error_rate double, errors long, placeholder_rate double, base_placeholder_rate double, latency_ratio double, js_script double, js_mode double"
    df = spark.createDataFrame([(0.0, 0, 0.08, 0.01, 1.5, 0.18, 0.18), (0.1, 1, 0.081, 0.01, 1.6, 0.19, 0.19), (0.0, 0, 0.17, 0.1, None, 0.0, 0.0)], cols)
    got = [[a.id for a in r.x] for r in df.select(drift.alert_list(True).alias("x")).collect()]
    assert got == [[], ["P1_PAGE_ERRORS", "P1_JUNK_SPIKE", "P2_LATENCY_REGRESSION", "P2_SCRIPT_MIX_SHIFT", "P2_PAGE_MODE_SHIFT"], []]
    assert len(df.select(drift.alert_list(False).alias("x")).collect()[1].x) == 4


def test_quantiles_differ_as_documented(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    r = df.agg(metrics.linear_quantile(F.col("x"), 0.95).alias("a"), metrics.floor_quantile(F.col("x"), 0.95).alias("b")).first()
    assert abs(r.a - 8.8) < 1e-9 and r.b == 4.0
    e = df.where("x > 99").agg(metrics.linear_quantile(F.col("x"), 0.95).alias("a"), metrics.floor_quantile(F.col("x"), 0.95).alias("b")).first()
    assert e.a is None and e.b is None


def test_runs_and_caps(spark):
    rows = spark.createDataFrame([("p", y) for y in (0, 1, 2, 7, 8, 20)], "page string, y int")
    got = sorted((r.y0, r.y1) for r in segment.runs(rows, ["page"], "y", pad=1, height=F.lit(21)).collect())
    assert got == [(0, 4), (6, 10), (19, 21)]
    boxes = spark.createDataFrame([("p", i, (0, 10 - i, 5, 12)) for i in range(6)] + [("p", 9, (3, 0, 3, 9))], "page string, i int, b struct<x0: int, y0: int, x1: int, y1: int>")
    top = segment.capped_regions(boxes, ["page"], "b", 3, "i").orderBy("rank").collect()
    assert [r.i for r in top] == [5, 4, 3]


def test_records_round_trip_and_quarantine(spark, tmp_path):
    lines = ["", "{\"type\": \"block\", \"page\": 1, \"text\": \"a b\", \"flags\": {\"placeholder\": true}}", "{\"type\": \"block\", \"placeholder\": true}", "[1]", "{\"page\": \"x\"", "nonsense"]
    good, bad = records.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert good.count() == 2 and bad.count() == 3
    assert good.where("text is not null").first().text == "a b"
    files.write_records(good, f"{tmp_path}/out")
    again, none = files.read_records(spark, f"{tmp_path}/out")
    assert again.count() == 2 and none.count() == 0


def test_baseline_is_created_once(spark, tmp_path):
    path = f"{tmp_path}/base"
    assert files.read_baseline(spark, path) is None
    files.create_baseline(spark.createDataFrame([(1,)], "n int"), path)
    files.create_baseline(spark.createDataFrame([(2,)], "n int"), path)
    assert files.read_baseline(spark, path).first().n == 1


def test_jobs_parse_and_route(spark):
    raw = [json.dumps({"job_id": "a", "pdf_path": "p", "out_dir": "o", "attempt": "2"}), json.dumps({"job_id": "b"}), "{", "[]"]
    j = jobs.parse_jobs(spark.createDataFrame([(x,) for x in raw], "value string"))
    ok, dead = jobs.split_valid(j)
    assert [(r.job_id, r.attempt, r.out_name) for r in ok.collect()] == [("a", 2, None)] and dead.count() == 3
    results = spark.createDataFrame([("a", "failed", 0), ("a", "failed", 2), ("b", "timeout", 0), ("c", "partial", None)], "job_id string, status string, attempt int")
    assert [(r.action, r.next_attempt) for r in jobs.route(results).collect()] == [("retry", 1), ("dead", None), ("dead", None), ("done", None)]


def test_latest_result_takes_the_last_attempt(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("a", "failed", 1, 0, t), ("a", "success", 0, 1, None), ("b", "partial", 10, None, t), ("b", "failed", 1, 0, t)]
    r = spark.createDataFrame(rows, "job_id string, status string, exit_code int, attempt int, finished_at timestamp_ntz")
    assert {x.job_id: x.status for x in jobs.latest_results(r).collect()} == {"a": "success", "b": "partial"}
    assert jobs.latest_results(r.where("1 = 0")).count() == 0


def test_worker_stream_retries_and_dead_letters(spark, tmp_path):
    rows = [("ok", "p", "d", None, 0), ("bad", "p", "d", None, 0), ("ok", "p", "d", None, 0), ("", "p", "d", None, 0)]
    worker.enqueue(spark.createDataFrame(rows, "job_id string, pdf_path string, out_dir string, out_name string, attempt int"), f"{tmp_path}/q")
    work = lambda j: j.select("job_id", "attempt", F.when(F.col("job_id") == "bad", 1).otherwise(0).alias("exit_code"), F.lit(0.1).alias("runtime_s"))
    out = worker.run_worker(spark, f"{tmp_path}/q", str(tmp_path), work, rounds=4)
    assert sorted((r.job_id, r.attempt, r.action) for r in out.collect()) == [("bad", 0, "retry"), ("bad", 1, "retry"), ("bad", 2, "dead"), ("ok", 0, "done")]
    assert sorted(r.reason for r in spark.read.parquet(f"{tmp_path}/dead").collect()) == ["failed", "malformed"]


def test_worker_keeps_attempts_of_a_batch_apart(spark, tmp_path):
    """Two attempts of one job in a batch have each its own result; timeouts and crashes are dead letters at once; the log can be read by job."""
    rows = [("a", "p", "d", None, 0), ("a", "p", "d", None, 1), ("slow", "p", "d", None, 0), ("gone", "p", "d", None, 0)]
    worker.enqueue(spark.createDataFrame(rows, "job_id string, pdf_path string, out_dir string, out_name string, attempt int"), f"{tmp_path}/q")

    def work(j):
        code = F.when(F.col("job_id") == "gone", None).when((F.col("job_id") == "a") & (F.col("attempt") == 0), 1).otherwise(0)
        return j.select("job_id", "attempt", code.alias("exit_code"), F.when(F.col("job_id") == "slow", 99.0).otherwise(0.12345).alias("runtime_s"))

    out = worker.run_worker(spark, f"{tmp_path}/q", str(tmp_path), work, rounds=3, timeout_s=60.0)
    got = sorted((r.job_id, r.attempt, r.status, r.action, r.runtime_s) for r in out.collect())
    assert got == [("a", 0, "failed", "retry", 0.123), ("a", 1, "success", "done", 0.123), ("gone", 0, "crash", "dead", 0.123), ("slow", 0, "timeout", "dead", 99.0)]
    assert sorted(r.reason for r in spark.read.parquet(f"{tmp_path}/dead").collect()) == ["crash", "timeout"]
    log = [r.type for r in worker.events_of(spark, str(tmp_path), "a").collect()]
    assert log == ["job_started", "job_started", "job_finished", "job_finished", "job_retry", "job_skipped_idempotent"]
    assert worker.events_of(spark, str(tmp_path), "none").count() == 0


def test_floor_quantiles_of_large_groups(spark):
    rows = [("a", float(i % 97)) for i in range(1000)] + [("b", 1.0), ("b", None), ("c", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r.lower for r in metrics.floor_quantiles(df, "k", "x", 0.95).collect()}
    xs = sorted(x for k, x in rows if k == "a")
    assert got == {"a": xs[int(0.95 * 999)], "b": 1.0, "c": None, None: 5.0}


def test_deviation_report(spark):
    row = {"pair": "r2", "baseline_run": "r1", "js_script": 0.2, "js_mode": 0.0, "placeholder_rate_abs": 0.1, "error_rate_abs": 0.0, "latency_ratio": None, "error_rate": 0.0, "errors": 0, "placeholder_rate": 0.2, "base_placeholder_rate": 0.1}
    schema = "pair string, baseline_run string, js_script double, js_mode double, placeholder_rate_abs double, error_rate_abs double, latency_ratio double, error_rate double, errors long, placeholder_rate double, base_placeholder_rate double"
    df = spark.createDataFrame([tuple(row.values())], schema)
    text = drift.report(df.withColumn("alerts", drift.alert_list(True))).first().value
    doc = json.loads(text)
    assert "\n" in text and doc["deltas"] == {"js_script": 0.2, "js_mode": 0.0, "placeholder_rate_abs": 0.1, "error_rate_abs": 0.0}
    assert [a["id"] for a in doc["alerts"]] == ["P1_JUNK_SPIKE", "P2_SCRIPT_MIX_SHIFT"]


def test_config_reads_and_refuses():
    from foliomill.config import Config

    assert Config.read({}).max_crops == 180 and Config.read({"OCR_LOW_DPI": "150"}).low_dpi == 150
    try:
        Config.read({"OCR_LOW_DPI": "high"})
        raise AssertionError
    except ValueError as e:
        assert "OCR_LOW_DPI" in str(e)


def test_broken_pages_are_records(spark):
    from foliomill.operators import prepare

    image = "struct<height: int, width: int, data: binary>"
    white = (40, 50, bytes([255]) * 2000)
    rows = [("d", 1, None, None, None), ("d", 2, "long enough to keep", None, None), ("d", 3, "short", white, white)]
    pages, crops = prepare.prepare(spark.createDataFrame(rows, f"doc_id string, page int, embedded string, low {image}, high {image}"))
    assert sorted((r.page, r.mode, r.error is not None, r.printed_crops) for r in pages.collect()) == [(1, "error", True, 0), (2, "embedded", False, 0), (3, "printed", False, 0)]
    assert crops.count() == 0 and prepare.prepare(pages.sparkSession.createDataFrame([], f"doc_id string, page int, embedded string, low {image}, high {image}"))[0].count() == 0


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    import pytest

    from foliomill import session

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: None)

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_imaging_kernels():
    ink = np.zeros((60, 200), bool)
    ink[10, 5:190] = True
    ink[30:40, 50:60] = True
    ink[29, 60] = True  # touches only by a corner
    assert imaging.grid_ratio(ink) > 0
    assert not imaging.without_rules(ink)[10, 50] and sorted(c[4] for c in imaging.components(ink)) == [101, 185]
    gray = np.full((80, 80), 255.0)
    gray[20:24, 20:60] = 0
    assert imaging.binarize(gray)[21, 30] and not imaging.binarize(gray)[60, 60]
    assert imaging.text_regions(np.zeros((20, 20), bool), "printed") == []


def test_recognition_records_failures(spark):
    class EchoRecogniser:
        """A stand-in for a model: the bytes are the text, cut to the token budget."""

        def read(self, images, kinds, tokens):
            return [b.decode("utf-8", "replace")[: 4 * n] for b, n in zip(images, tokens)]

    class Fails:
        def read(self, images, kinds, tokens):
            raise ValueError("no model")

    rows = [("r", 1, i, "printed", 2, b"hello world") for i in range(3)]
    crops = spark.createDataFrame(rows, "run_id string, page int, crop_id int, kind string, tokens int, image binary")
    assert {r.text for r in recognise.recognise(crops, EchoRecogniser).collect()} == {"hello wo"}
    assert all(r.error.startswith("ValueError") for r in recognise.recognise(crops, Fails).collect())
    assert not recognise.available("no_such_engine")


def test_page_texts_keep_order_and_drop_junk(spark):
    rows = [(1, "r", 1, "handwriting", 0, "h", None, None), (2, "r", 1, "printed", 1, "b", None, None), (3, "r", 1, "printed", 0, "a", None, None), (4, "r", 1, "printed", 2, "x", (True, False), None), (5, "r", 1, "printed", 3, " ", None, None)]
    df = spark.createDataFrame(rows, "ocr_id int, run_id string, page int, kind string, block_id int, text string, flags struct<placeholder: boolean, is_form: boolean>, placeholder boolean")
    assert records.page_texts(df).first().text == "a\nb\nh"
