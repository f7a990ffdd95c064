"""Queries over run reports, text sinks, adapters and the scalar functions of the record format, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalar as S
from ..functions import text as X
from ..operators import metrics as M
from ..operators import recognise as Z
from ..operators import records as R
from ..operators import segment as G
from ..session import table, work_dir
from ..sources import files
from . import record_queries as Q


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def category_counts_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts whose definitions differ: modes over summaries only (hard), kinds without embedded text (core), scripts as found in the text (core)."""
    s, b = _t(spark, sf_dir, "page_summary", "ocr_block")
    what = lambda df, w, c: M.category_counts(df, "run_id", c).withColumn("what", F.lit(w))
    mode = F.nullif(F.lower(F.trim("mode")), F.lit(""))
    kind = F.lower(F.trim("kind"))
    modes = what(s.where(mode.isNotNull()), "hard_mode", mode)
    kinds = what(b.where(F.coalesce(kind, F.lit("")) != "embedded"), "core_kind", kind)
    return modes.unionByName(kinds).unionByName(what(b, "core_script", X.primary_script(F.col("text"))))


def _record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, s, e = _t(spark, sf_dir, "ocr_block", "page_summary", "page_error")
    rows = b.select("run_id", "page", "kind", "mode", "script", "text", "flags", "placeholder", F.lit("block").alias("type"))
    rows = rows.unionByName(s.select("run_id", "page", "mode", "script", "latency_ms", F.lit("page_summary").alias("type")), allowMissingColumns=True)
    return R.to_lines(rows.unionByName(e.select("run_id", "page", "error", F.lit("page_error").alias("type")), allowMissingColumns=True))


def report_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON lines of mixed types, one scan, split by type into the wrapper's metrics."""
    folder = work_dir(spark, "lines")
    _record_lines(spark, sf_dir).write.text(folder)
    records, _ = files.read_records(spark, folder)
    parts = R.by_type(records)
    out = M.hard_metrics(parts["block"], parts["page_summary"], parts["page_error"])
    return out.withColumns({c: F.round(c, 6) for c in ("latency_mean", "latency_p95", "placeholder_rate", "error_rate")})


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text sink: each run's pages in order under their banners, by its length and hash."""
    b, s, h = _t(spark, sf_dir, "ocr_block", "page_summary", "run_header")
    modes = s.groupBy("run_id", "page").agg(F.min(F.lower(F.trim("mode"))).alias("mode"))
    docs = R.text_documents(R.page_texts(b).join(modes, ["run_id", "page"], "left"), h)
    return docs.select("run_id", F.char_length("out").alias("chars"), F.md5(F.col("out").cast("binary")).alias("hash"))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, failed pages and exit code of each run."""
    return R.run_summary(*_t(spark, sf_dir, "page_summary", "page_error"))


def page_error_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors left by the pages, and those made up for pages without any output."""
    h, s, e = _t(spark, sf_dir, "run_header", "page_summary", "page_error")
    missing = R.merge_page_outputs(h, s, e)
    return R.union_errors(e, missing).groupBy("run_id", "error").agg(F.count(F.lit(1)).alias("n"))


def placeholder_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each block's text goes into page text, by the junk rules instead of the stored flag."""
    b = table(spark, sf_dir, "ocr_block")
    return b.select("ocr_id", X.kept_text(F.col("text"), X.is_placeholder(F.col("text"))).alias("kept"))


def config_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every knob with its value, one set and two beyond their clamps."""
    config = Config.read({"OCR_MAX_CROPS": "90", "OCR_PREFETCH": "99", "OCR_BATCH": "0", "JOB_TIMEOUT": " "})
    return spark.createDataFrame(config.rows(), "knob string, value string")


_SCALARS = [(0, 2.5, "x" * 4100, 0), (1, 0.00125, "abc", 7), (2, -3.5, "", 123456), (3, 1234.56785, "e" + chr(0x301), 40)]


def scalar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and names as the record format writes them, ends of texts, clamps, and boxes grown, cut and turned into pixels."""
    df = spark.createDataFrame(_SCALARS, "id int, x double, t string, n int")
    box = F.struct(F.col("n").alias("x0"), F.lit(2).alias("y0"), (F.col("n") + 10).alias("x1"), F.lit(50).alias("y1"))
    pad = S.padded_box(box, 3, F.lit(60), F.lit(52))
    quad = S.quad_box(F.array(F.col("x"), F.lit(1.9), F.lit(4.0), F.lit(0.5)), F.array(F.lit(3.7), F.col("x"), F.lit(9.2), F.lit(2.0)))
    rel = S.relative_box(F.lit(0.1), F.lit(0.259), F.lit(0.5), F.lit(0.75), F.lit(100), F.col("n"))
    corner = lambda name, b: [b[c].alias(f"{name}_{c}") for c in ("x0", "y0", "x1", "y1")]
    return df.select(
        "id", S.fixed(F.col("x"), 0).alias("whole"), S.fixed(F.col("x"), 4).alias("four"), F.char_length(S.last_chars(F.col("t"))).alias("tail"), S.page_name(F.col("n")).alias("name"),
        S.clamp(F.col("n"), 1, 32).alias("clamped"), F.round("x", 3).alias("third"), *corner("pad", pad), *corner("quad", quad), *corner("rel", rel), S.valid_block(F.col("t"), pad).alias("valid"),
        S.page_banner(F.col("n"), F.lit(9), F.lit("form")).alias("banner"), S.iso_text(F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")).alias("iso"),
        S.epoch_seconds(F.lit("2026-01-02 03:04:05.5").cast("timestamp_ntz")).alias("epoch"),
    )


def fullpage_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What full-page engines give, as blocks: quadrilaterals of one kind, relative boxes of the other; lines without text or area go."""
    quads = [(1, [1.5, 9.0, 9.2, 1.0], [2.0, 2.5, 8.9, 8.0], "one", 0.5), (1, [3.0, 3.4], [1.0, 5.0], "no width", 0.9), (2, [0.0, 5.0], [0.0, 5.0], "", 0.9), (2, [0.0, 5.0], [0.0, 5.0], None, 0.1)]
    shares = [(1, ["two", "words"], 0.1, 0.2, 0.5, 0.4, 200, 100), (2, [" "], 0.1, 0.2, 0.5, 0.4, 200, 100), (3, ["x"], 0.5, 0.2, 0.5, 0.4, 200, 100)]
    a = Z.blocks_of_quads(spark.createDataFrame(quads, "page int, xs array<double>, ys array<double>, text string, conf double"))
    b = Z.blocks_of_shares(spark.createDataFrame(shares, "page int, words array<string>, x0 double, y0 double, x1 double, y1 double, width int, height int"))
    return a.unionByName(b).select("page", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("box"), "text", "conf", "engine")


def decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device, number type, batch and decoding options with and without a GPU, and the cap of handwriting crops on forms."""
    d = Z.Decoding()
    rows = [(gpu, *Z.device(gpu), d.beams, d.no_repeat_ngram, d.repetition_penalty, G.form_cap(180 if gpu else 90)) for gpu in (False, True)]
    return spark.createDataFrame(rows, "gpu boolean, device string, numbers string, batch int, beams int, no_repeat int, penalty double, form_cap int")


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page paired by position with the next page's blocks; what one page has more is left out."""
    b = table(spark, sf_dir, "ocr_block").where("run_id is not null and page is not null")
    w = Q.Window.partitionBy("run_id", "page").orderBy("ocr_id")
    left = b.select("run_id", "page", "ocr_id", F.row_number().over(w).alias("at"))
    right = left.select("run_id", (F.col("page") - 1).alias("page"), "at", F.col("ocr_id").alias("other"))
    return G.zip_positions(left, right, ["run_id", "page"], "at").groupBy("run_id", "page").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("other") - F.col("ocr_id")).alias("apart"))


_NAMES = (
    "category_counts_forms report_from_lines text_documents run_summaries page_error_union placeholder_kept config_knobs scalar_forms fullpage_blocks decoding positional_zip"
)
QUERIES = {n: globals()[n] for n in _NAMES.split()}
_KNOBS = ", ".join(f"('{k}', '{ {'OCR_MAX_CROPS': '90', 'OCR_PREFETCH': '8', 'OCR_BATCH': '1'}.get(k, v) }')" for k, v in Config().rows())
ORACLES = {
    "category_counts_forms": f"""WITH s AS (SELECT run_id, {Q._SCRIPT_COUNTS} FROM ocr_block)
SELECT run_id, lower(trim(mode)) AS category, count(*) AS n, 'hard_mode' AS what FROM page_summary WHERE trim(mode) <> '' GROUP BY ALL
UNION ALL SELECT run_id, lower(trim(kind)), count(*), 'core_kind' FROM ocr_block WHERE coalesce(lower(trim(kind)), '') <> 'embedded' GROUP BY ALL
UNION ALL SELECT run_id, {Q._SCRIPT} AS c, count(*), 'core_script' FROM s GROUP BY ALL""",
    "report_from_lines": Q.ORACLES["hard_metrics"],
    "text_documents": f"""WITH t AS (SELECT run_id, page, string_agg(text, chr(10) ORDER BY CASE WHEN lower(kind) = 'handwriting' THEN 1 ELSE 0 END, coalesce(block_id, -1), ocr_id) AS text FROM ocr_block
WHERE {Q._C} <> '' AND NOT coalesce({Q._FLAG}, false) GROUP BY run_id, page), m AS (SELECT run_id, page, min(lower(trim(mode))) AS mode FROM page_summary GROUP BY ALL),
p AS (SELECT t.run_id, t.page, '=== PAGE ' || t.page || ' / ' || coalesce(h.pages, t.page) || ' (' || coalesce(m.mode, 'printed') || ') ===' || chr(10) || chr(10) || t.text AS out
FROM t LEFT JOIN m ON m.run_id = t.run_id AND m.page = t.page LEFT JOIN run_header h ON h.run_id = t.run_id), o AS (SELECT run_id, string_agg(out, chr(10) || chr(10) ORDER BY page, out) AS out FROM p GROUP BY run_id)
SELECT run_id, length(out)::INT AS chars, md5(out) AS hash FROM o""",
    "run_summaries": """WITH s AS (SELECT run_id, count(*) AS d FROM page_summary GROUP BY 1), e AS (SELECT run_id, count(*) AS f FROM page_error GROUP BY 1)
SELECT run_id, coalesce(d, 0) + coalesce(f, 0) AS pages, coalesce(f, 0) AS failed, CASE WHEN coalesce(f, 0) > 0 THEN 10 ELSE 0 END AS exit_code FROM s FULL JOIN e USING (run_id)""",
    "page_error_union": """WITH p AS (SELECT run_id, unnest(range(1, pages + 1)) AS page FROM run_header WHERE pages > 0),
m AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM page_summary s WHERE s.run_id = p.run_id AND s.page = p.page) AND NOT EXISTS (SELECT 1 FROM page_error e WHERE e.run_id = p.run_id AND e.page = p.page))
SELECT run_id, error, count(*) AS n FROM (SELECT run_id, error FROM page_error UNION ALL SELECT run_id, 'no output' FROM m) GROUP BY ALL""",
    "placeholder_kept": f"WITH {Q._RULES} SELECT ocr_id, NOT ({Q._JUNK}) AS kept FROM rules",
    "config_knobs": f"SELECT * FROM (VALUES {_KNOBS}) v(knob, value)",
    "scalar_forms": """SELECT * FROM (VALUES
(0, '2', '2.5000', 4000, 'page_0000.txt', 1, 2.5::DOUBLE, 0, 0, 13, 52, 0, 2, 4, 9, 10, 0, 50, 0, true, '=== PAGE 0 / 9 (form) ===', '2026-01-02T03:04:05+00:00', 1767323045.5::DOUBLE),
(1, '0', '0.0012', 3, 'page_0007.txt', 7, 0.001, 4, 0, 20, 52, 0, 0, 4, 9, 10, 1, 50, 5, true, '=== PAGE 7 / 9 (form) ===', '2026-01-02T03:04:05+00:00', 1767323045.5),
(2, '-4', '-3.5000', 0, 'page_123456.txt', 32, -3.5, 123453, 0, 60, 52, -3, -3, 4, 9, 10, 31975, 50, 92592, false, '=== PAGE 123456 / 9 (form) ===', '2026-01-02T03:04:05+00:00', 1767323045.5),
(3, '1235', '1234.5678', 2, 'page_0040.txt', 32, 1234.568, 37, 0, 53, 52, 0, 2, 1234, 1234, 10, 10, 50, 30, true, '=== PAGE 40 / 9 (form) ===', '2026-01-02T03:04:05+00:00', 1767323045.5))
v(id, whole, four, tail, name, clamped, third, pad_x0, pad_y0, pad_x1, pad_y1, quad_x0, quad_y0, quad_x1, quad_y1, rel_x0, rel_y0, rel_x1, rel_y1, valid, banner, iso, epoch)""",
    "fullpage_blocks": "SELECT * FROM (VALUES (1, '1,2,9,8', 'one', 0.5::DOUBLE, 'paddleocr'), (1, '20,20,100,40', 'two words', NULL, 'doctr')) v(page, box, text, conf, engine)",
    "decoding": "SELECT * FROM (VALUES (false, 'cpu', 'float32', 2, 1, 3, 1.12::DOUBLE, 60), (true, 'cuda', 'float16', 6, 1, 3, 1.12, 90)) v(gpu, device, numbers, batch, beams, no_repeat, penalty, form_cap)",
    "positional_zip": """WITH b AS (SELECT run_id, page, ocr_id, row_number() OVER (PARTITION BY run_id, page ORDER BY ocr_id) AS n FROM ocr_block WHERE run_id IS NOT NULL AND page IS NOT NULL)
SELECT x.run_id, x.page, count(*) AS pairs, sum(y.ocr_id - x.ocr_id)::BIGINT AS apart FROM b x JOIN b y ON y.run_id = x.run_id AND y.page = x.page + 1 AND y.n = x.n GROUP BY ALL""",
}
