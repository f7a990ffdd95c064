"""Queries over records: text rules, scripts, page texts, metrics, drift; each with its SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions import scalar as S
from ..functions import text as X
from ..operators import drift as D
from ..operators import metrics as M
from ..operators import records as R
from ..operators import segment as G
from ..session import table

# ---- SQL fragments, written on their own: RE2 classes and unnested tokens

_SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_T = f"trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g'))"
_C = f"regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')"


def _class_sql(ranges) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


_SCRIPT_COUNTS = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{_class_sql(r)}')) AS n_{name}" for name, r in X.SCRIPT_RANGES)
_TOP = "greatest(" + ", ".join(f"n_{name}" for name, _ in X.SCRIPT_RANGES) + ")"
_SCRIPT = f"CASE WHEN {_TOP} = 0 THEN 'unknown' " + " ".join(f"WHEN n_{name} = {_TOP} THEN '{name}'" for name, _ in X.SCRIPT_RANGES) + " END"

_RULES = f"""
base AS (SELECT ocr_id, {_T} AS t, {_C} AS c, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM ocr_block),
tok AS (SELECT *, string_split(t, ' ') AS k FROM base),
grams AS (
  SELECT ocr_id, max(CASE WHEN g = 2 THEN n END) AS two, max(CASE WHEN g = 3 THEN n END) AS three FROM (
    SELECT ocr_id, g, s, count(*) AS n FROM (
      SELECT ocr_id, g, list_slice(w, i, i + g - 1) AS s FROM (
        SELECT ocr_id, w, g, unnest(range(1, len(w) - g + 2)) AS i FROM tok, (VALUES (2), (3)) v(g) WHERE len(w) >= 12))
    GROUP BY ALL) GROUP BY ocr_id),
rules AS (
  SELECT tok.ocr_id,
    c = '' AS blank,
    regexp_full_match(c, '[#_\\-=|.,:;/+*()\\[\\]]{{3,}}') AS symbols,
    length(c) >= 40 AND len(list_distinct(string_split(lower(c), ''))) <= 3 AS low_diversity,
    length(t) >= 30 AND regexp_full_match(t, '\\p{{Nd}}( *000){{8,}} *\\p{{Nd}}?') AS zero_groups,
    len(k) >= 10 AND greatest(len(list_filter(k, lambda x: x = '0')), len(list_filter(k, lambda x: x = '00')), len(list_filter(k, lambda x: x = '000')),
      len(list_filter(k, lambda x: x = '0000'))) / len(k) >= 0.8 AS zero_tokens,
    regexp_full_match(t, '([A-Za-z] ){{8,}}[A-Za-z]') AS letter_soup,
    len(w) >= 12 AND (coalesce(two, 0) >= 6 OR coalesce(three, 0) >= 4) AS repetition,
    regexp_full_match(c, '0{{8,}}') AS zeros,
    regexp_full_match(c, '\\p{{Nd}}{{40,}}') AS digits
  FROM tok LEFT JOIN grams ON tok.ocr_id = grams.ocr_id)
"""
_RULE_NAMES = ("blank", "symbols", "low_diversity", "zero_groups", "zero_tokens", "letter_soup", "repetition", "zeros", "digits")
_JUNK = " OR ".join(_RULE_NAMES)
_FLAG = "coalesce(flags.placeholder, placeholder)"
_HEADER_PAGES = "SELECT run_id, doc_id, ts_utc, pages FROM run_header"


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def block_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per engine, mode and script found: blocks, flagged ones, junk by the rules, characters."""
    b = R.unify_blocks(table(spark, sf_dir, "ocr_block"))
    return b.groupBy("engine", "mode", "found_script").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if("flagged").alias("flagged_blocks"), F.count_if("junk").alias("junk_blocks"), F.sum(F.char_length("text")).alias("chars")
    )


def placeholder_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every junk rule of every block."""
    rules = X.placeholder_rules(F.col("text"))
    rows = table(spark, sf_dir, "ocr_block").select("ocr_id", *(c.alias(n) for n, c in rules.items()))
    return rows.withColumn("junk", reduce(lambda a, b: a | b, map(F.col, rules)))


def ngram_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent bigram and trigram counts of every block of twelve words or more."""
    ws = X.words(F.col("text"))
    df = table(spark, sf_dir, "ocr_block").withColumn("ws", ws).where(F.size("ws") >= 12)
    return df.select("ocr_id", X.longest_run(X.ngrams(F.col("ws"), 2)).alias("two"), X.longest_run(X.ngrams(F.col("ws"), 3)).alias("three"))


def script_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script found in each block beside its label."""
    return table(spark, sf_dir, "ocr_block").select("ocr_id", X.primary_script(F.col("text")).alias("found_script"), F.lower(F.trim("script")).alias("label"))


_LITERALS = ["", "   ", "abcабв", "مرحباhello", "___", "×÷", "12345", "日本ひらがな한글", "漢字ab", "ελληνικά", "שלוםabc", "नमस्ते", "สวัสดี", "İstanbul", "😀😀", "ab жзи", "a×b", "[\\]^_`"]


def script_adversarial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties, signs inside ranges, and texts without letters."""
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(_LITERALS)], "id int, text string")
    return rows.select("id", X.primary_script(F.col("text")).alias("found_script"))


_JUNK_LITERALS = ["##", "###", "0" * 7, "0" * 8, "a" * 39, "a" * 40, "1" + " 000" * 8 + " 5", "1" + " 000" * 7, "a b c d e f g h i", "a b c d e f g h", " ".join(["0"] * 8 + ["x"] * 2), " ".join(["0"] * 7 + ["x"] * 3),
    "7" * 39, "7" * 40, "the cat " * 6, "the cat " * 5 + "sat on", "a b c " * 4, " 　", "one two three " * 3 + "x y z", "- - -", "12 34", "abc" * 14]


def placeholder_adversarial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of every threshold of the junk rules."""
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(_JUNK_LITERALS)], "ocr_id int, text string")
    return rows.select("ocr_id", *(c.alias(n) for n, c in X.placeholder_rules(F.col("text")).items()))


def page_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts put together from kept blocks."""
    return R.page_texts(table(spark, sf_dir, "ocr_block"))


def merge_child_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every page that run headers promise."""
    return R.merge_page_outputs(*_t(spark, sf_dir, "run_header", "page_summary", "page_error")).groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("pages"))


def core_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics, pipeline definition."""
    out = M.core_metrics(*_t(spark, sf_dir, "ocr_block", "page_summary", "page_error", "run_header"))
    doubles = [f.name for f in out.schema if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.round(c, 6) for c in doubles})


def hard_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics, wrapper definition."""
    out = M.hard_metrics(*_t(spark, sf_dir, "ocr_block", "page_summary", "page_error"))
    return out.withColumns({c: F.round(c, 6) for c in ("latency_mean", "latency_p95", "placeholder_rate", "error_rate")})


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both p95 definitions of job run times, per exit code."""
    r = table(spark, sf_dir, "job_result")
    linear = r.groupBy("exit_code").agg(F.round(M.linear_quantile(F.col("runtime_s"), 0.95), 6).alias("linear"))
    lower = M.floor_quantiles(r, "exit_code", "runtime_s", 0.95).withColumnRenamed("exit_code", "code")
    both = linear.join(lower, F.col("exit_code").eqNullSafe(F.col("code")), "left")
    return both.select("exit_code", "linear", F.round("lower", 6).alias("lower"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of modes per run over summaries and errors, of kinds and scripts over blocks, as one long table."""
    s, e, b = _t(spark, sf_dir, "page_summary", "page_error", "ocr_block")
    pages = s.select("run_id", F.col("mode").alias("m")).unionByName(e.select("run_id", F.lit("error").alias("m")))
    what = lambda df, w, c: M.category_counts(df, "run_id", c).withColumn("what", F.lit(w))
    return what(pages, "mode", F.lower(F.trim("m"))).unionByName(what(b, "kind", F.lower(F.trim("kind")))).unionByName(what(b, "script", F.lower(F.trim("script"))))


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.category_counts(table(spark, sf_dir, "page_summary"), "run_id", F.coalesce(F.lower(F.trim("script")), F.lit("none")))


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.category_counts(table(spark, sf_dir, "page_summary"), "run_id", F.coalesce(F.lower(F.trim("mode")), F.lit("none")))


def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of script and mode mixes of each later run of a document from its first, both definitions."""
    pairs = D.baselines(table(spark, sf_dir, "run_header"))
    of = lambda what, c: D.divergences(pairs, c, c, "run_id").withColumn("what", F.lit(what))
    both = of("script", _scripts(spark, sf_dir)).unionByName(of("mode", _modes(spark, sf_dir)))
    forms = F.array(*(F.struct(F.lit(n).alias("definition"), F.round(n, 6).alias("js")) for n in ("core", "hard")))
    return both.select("pair", "what", F.explode(forms).alias("f")).select("pair", "what", "f.*")


def _compared(spark: SparkSession, sf_dir: str, core: bool) -> DataFrame:
    pairs = D.baselines(table(spark, sf_dir, "run_header"))
    js = lambda c: D.divergence(pairs, c, c, "run_id", 0.5 if core else 0.0)
    tables = _t(spark, sf_dir, "ocr_block", "page_summary", "page_error")
    m = M.core_metrics(*tables, table(spark, sf_dir, "run_header")) if core else M.hard_metrics(*tables)
    return D.deviations(m, pairs, js(_scripts(spark, sf_dir)), js(_modes(spark, sf_dir)), core)


_DELTAS = ("js_script", "js_mode", "placeholder_rate_abs", "error_rate_abs", "latency_ratio")


def _deviation(spark: SparkSession, sf_dir: str, core: bool) -> DataFrame:
    names = _DELTAS if core else _DELTAS[:4]
    alerts = F.array_join(F.transform("alerts", lambda a: a["id"]), ",").alias("alerts")
    return _compared(spark, sf_dir, core).select("pair", "baseline_run", *(F.round(c, 6).alias(c) for c in names), alerts)


def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas and alerts of each later run of a document against its first, pipeline definition."""
    return _deviation(spark, sf_dir, True)


def drift_alerts_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, wrapper definition: no latency, errors counted, other rates."""
    return _deviation(spark, sf_dir, False)


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways to name a document, from the run headers."""
    h = table(spark, sf_dir, "run_header")
    return h.select("run_id", S.doc_slug(F.col("source_pdf")).alias("slug"), S.hash_id("doc_", F.col("doc_sha256")).alias("hash_id"), S.is_pdf(F.col("source_pdf")).alias("pdf"), S.iso_utc(F.col("ts_utc")).cast("string").alias("ts"))


def engine_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing, language pack and token budget of every block."""
    b = R.unify_blocks(table(spark, sf_dir, "ocr_block"))
    box = S.box(F.col("bbox"))
    return b.select(
        "ocr_id", S.engine_route(F.col("mode"), F.col("found_script")).alias("route"), S.language_pack(F.col("found_script")).alias("pack"),
        F.when(box.isNotNull(), S.token_budget(F.col("kind"), S.box_area(box))).alias("tokens"),
    )


def ink_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each crop shows enough ink for its kind."""
    b = table(spark, sf_dir, "ocr_block").where("features is not null")
    form = F.coalesce(F.col("flags.is_form"), F.lit(False))
    gate = S.ink_gate(F.when(form, F.lit("form")).otherwise(F.lower("kind")))
    return b.select("ocr_id", S.enough_ink(F.col("features.ink_ratio"), F.col("features.ink_pixels"), gate).alias("passes"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of each page in reading order up to the cap, with crop numbers."""
    b = table(spark, sf_dir, "ocr_block").where("bbox is not null").select("ocr_id", "run_id", "page", F.lower("kind").alias("kind"), S.box(F.col("bbox")).alias("b"))
    top = G.capped_regions(b, ["run_id", "page"], "b", Config().max_crops, "ocr_id")
    return G.crop_ids(top, ["run_id", "page"], "kind", [F.col("rank")]).select("ocr_id", "rank", "crop_id")


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive pages per run, grown by one: the segmentation of rows, on page numbers."""
    pages = table(spark, sf_dir, "page_summary").select("run_id", "page").distinct()
    return G.runs(pages, ["run_id"], "page", pad=1)


def first_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest token budget among the first eight crops of a page."""
    b = table(spark, sf_dir, "ocr_block").where("bbox is not null").select("run_id", "page", "ocr_id", F.lower("kind").alias("kind"), S.box_area(S.box(F.col("bbox"))).alias("area"))
    return G.first_max(b, ["run_id", "page"], [F.col("ocr_id")], S.token_budget(F.col("kind"), F.col("area")))


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines and read again, with bad lines among them: what comes back and what is quarantined."""
    b = table(spark, sf_dir, "ocr_block").select("run_id", "doc_id", "page", F.lit("block").alias("type"), "text", "flags", "placeholder")
    bad = spark.createDataFrame([("",), ("{\"a\": ",), ("[1]",), ("nonsense",)], "value string")
    records, quarantine = R.parse_lines(R.to_lines(b).unionByName(bad))
    got = records.select(F.lit("record").alias("what"), F.coalesce(F.col("flags.placeholder"), F.col("placeholder")).alias("flag"), F.char_length("text").alias("chars"))
    return got.unionByName(quarantine.select(F.lit("quarantine").alias("what"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("int").alias("chars"))).groupBy("what", "flag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")
    )


def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's place among the runs of its document, and the run it is compared with."""
    h = table(spark, sf_dir, "run_header")
    w = Window.partitionBy("doc_id").orderBy("ts_utc", "run_id")
    return h.select("run_id", F.row_number().over(w).alias("place"), F.first("run_id").over(w).alias("baseline_run"))


_JS_SQL = f"""
h AS ({_HEADER_PAGES}),
f AS (SELECT *, first(run_id) OVER (PARTITION BY doc_id ORDER BY ts_utc, run_id) AS a FROM h),
pairs AS (SELECT run_id AS pair, a, run_id AS b FROM f WHERE run_id <> a),
cats AS (SELECT run_id, 'script' AS what, coalesce(lower(trim(script)), 'none') AS c FROM page_summary UNION ALL SELECT run_id, 'mode', coalesce(lower(trim(mode)), 'none') FROM page_summary),
cnt AS (SELECT run_id, what, c, count(*) AS n FROM cats GROUP BY ALL),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY run_id, what) AS s FROM cnt),
kinds AS (SELECT pair, a, b, what FROM pairs, (VALUES ('script'), ('mode')) v(what)),
keys AS (SELECT DISTINCT k.pair, k.a, k.b, k.what, s.c FROM kinds k JOIN sh s ON s.what = k.what AND s.run_id IN (k.a, k.b)),
pq AS (SELECT k.pair, k.what, k.c, coalesce(x.s, 0) AS p, coalesce(y.s, 0) AS q FROM keys k LEFT JOIN sh x ON x.run_id = k.a AND x.what = k.what AND x.c = k.c LEFT JOIN sh y ON y.run_id = k.b AND y.what = k.what AND y.c = k.c),
js AS (SELECT pair, what, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js, sum(p) AS sp, sum(q) AS sq FROM pq GROUP BY ALL),
mixes AS (SELECT k.pair, k.what, CASE WHEN js.pair IS NULL THEN 0 WHEN sp = 0 OR sq = 0 THEN 0.5 ELSE js END AS core, CASE WHEN js.pair IS NULL OR sp = 0 OR sq = 0 THEN 0 ELSE js END AS hard
  FROM kinds k LEFT JOIN js ON js.pair = k.pair AND js.what = k.what)
"""
_CORE_SQL = f"""
b AS (SELECT run_id, count(*) AS blocks, count(*) FILTER (lower(mode) <> 'embedded' AND coalesce({_FLAG}, false)) AS placeholders,
  count(*) FILTER (lower(mode) <> 'embedded' AND coalesce(flags.is_form, false)) AS form_blocks, avg(features.ink_ratio) AS ink_mean,
  quantile_cont(features.ink_ratio, 0.1) AS ink_p10, quantile_cont(features.ink_ratio, 0.5) AS ink_p50, quantile_cont(features.ink_ratio, 0.9) AS ink_p90 FROM ocr_block GROUP BY run_id),
s AS (SELECT run_id, count(*) AS summaries, avg(latency_ms) FILTER (lower(trim(mode)) <> 'embedded') AS latency_mean,
  quantile_cont(latency_ms::DOUBLE, 0.95) FILTER (lower(trim(mode)) <> 'embedded') AS latency_p95 FROM page_summary GROUP BY run_id),
d AS (SELECT run_id, avg(try_cast(diagnostics['prep_ms'] AS DOUBLE)) AS prep_mean, quantile_cont(try_cast(diagnostics['prep_ms'] AS DOUBLE), 0.95) AS prep_p95, avg(try_cast(diagnostics['boxes'] AS DOUBLE)) AS boxes_mean,
  quantile_cont(try_cast(diagnostics['boxes'] AS DOUBLE), 0.95) AS boxes_p95, avg(try_cast(diagnostics['pr_crops'] AS DOUBLE)) AS printed_crops_mean, avg(try_cast(diagnostics['hw_crops'] AS DOUBLE)) AS handwriting_crops_mean
  FROM (SELECT run_id, diagnostics FROM page_summary UNION ALL SELECT run_id, diagnostics FROM page_error) GROUP BY run_id),
e AS (SELECT run_id, count(*) AS errors FROM page_error GROUP BY run_id),
core AS (SELECT h.run_id, h.doc_id, h.pages AS header_pages, coalesce(summaries, 0) AS summaries, latency_mean, latency_p95, prep_mean, prep_p95, boxes_mean, boxes_p95, printed_crops_mean, handwriting_crops_mean, coalesce(errors, 0) AS errors,
  coalesce(blocks, 0) AS blocks, coalesce(placeholders, 0) AS placeholders, coalesce(form_blocks, 0) AS form_blocks, ink_mean, ink_p10, ink_p50, ink_p90,
  coalesce(h.pages, coalesce(summaries, 0) + coalesce(errors, 0)) AS pages FROM run_header h LEFT JOIN s USING (run_id) LEFT JOIN d USING (run_id) LEFT JOIN e USING (run_id) LEFT JOIN b USING (run_id)),
cm AS (SELECT *, CASE WHEN blocks = 0 THEN 0 ELSE placeholders / blocks END AS placeholder_rate, CASE WHEN pages = 0 THEN 0 ELSE errors / pages END AS error_rate FROM core)
"""
_HARD_SQL = f"""
hb AS (SELECT run_id, count(*) AS blocks, count(*) FILTER (coalesce({_FLAG}, false)) AS placeholders FROM ocr_block GROUP BY run_id),
hl AS (SELECT run_id, list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL)) AS x, count(*) AS pages, avg(latency_ms) AS latency_mean FROM page_summary GROUP BY run_id),
hs AS (SELECT run_id, pages, latency_mean, x[1 + floor((len(x) - 1) * 0.95)::INT] AS latency_p95 FROM hl), he AS (SELECT run_id, count(*) AS errors FROM page_error GROUP BY run_id),
hj AS (SELECT run_id, coalesce(pages, 0) AS pages, latency_mean, latency_p95, coalesce(errors, 0) AS errors, coalesce(blocks, 0) AS blocks, coalesce(placeholders, 0) AS placeholders FROM hs FULL JOIN he USING (run_id) FULL JOIN hb USING (run_id)),
hm AS (SELECT *, CASE WHEN blocks = 0 THEN 0 ELSE placeholders / blocks END AS placeholder_rate, CASE WHEN pages = 0 THEN 0 ELSE errors / pages END AS error_rate FROM hj)
"""
_SHIFTS = "CASE WHEN js_script > 0.18 THEN 'P2_SCRIPT_MIX_SHIFT' END, CASE WHEN js_mode > 0.18 THEN 'P2_PAGE_MODE_SHIFT' END"
_JUNK_SPIKE = "CASE WHEN n.placeholder_rate > greatest(0.08, o.placeholder_rate * 1.8) THEN 'P1_JUNK_SPIKE' END"
_ABS = "round(n.placeholder_rate - o.placeholder_rate, 6) AS placeholder_rate_abs, round(n.error_rate - o.error_rate, 6) AS error_rate_abs, round(js_script, 6) AS js_script, round(js_mode, 6) AS js_mode"
_AREA = "((bbox[3] - bbox[1]) * (bbox[4] - bbox[2]))"
_BUDGET = f"CASE WHEN lower(kind) = 'handwriting' THEN least(196, greatest(64, {_AREA} // 2200)) ELSE least(128, greatest(48, {_AREA} // 3200)) END"
_LIT = lambda xs: ", ".join("(" + str(i) + ", '" + s.replace("'", "''") + "')" for i, s in enumerate(xs))

_NAMES = (
    "block_profile placeholder_flags placeholder_adversarial ngram_repetition script_by_block script_adversarial page_summary_text merge_child_outputs core_metrics hard_metrics quantiles category_counts "
    "js_divergence drift_alerts drift_alerts_hard document_ids engine_route ink_gate reading_order line_runs first_crops jsonl_round_trip run_order"
)
QUERIES = {n: globals()[n] for n in _NAMES.split()}
ORACLES = {
    "block_profile": f"""WITH {_RULES}, s AS (SELECT ocr_id, {_SCRIPT_COUNTS} FROM ocr_block)
SELECT engine, lower(trim(mode)) AS mode, {_SCRIPT} AS found_script, count(*) AS blocks, count(*) FILTER (coalesce({_FLAG}, false)) AS flagged_blocks, count(*) FILTER ({_JUNK}) AS junk_blocks, sum(length(text)) AS chars
FROM ocr_block JOIN rules USING (ocr_id) JOIN s USING (ocr_id) GROUP BY ALL""",
    "placeholder_flags": f"WITH {_RULES} SELECT *, ({_JUNK}) AS junk FROM rules",
    "placeholder_adversarial": "WITH ocr_block AS (SELECT * FROM (VALUES " + _LIT(_JUNK_LITERALS) + ") v(ocr_id, text)), " + _RULES + " SELECT * FROM rules",
    "ngram_repetition": f"WITH {_RULES} SELECT ocr_id, coalesce(two, 0) AS two, coalesce(three, 0) AS three FROM tok LEFT JOIN grams USING (ocr_id) WHERE len(w) >= 12",
    "script_by_block": f"WITH s AS (SELECT ocr_id, script, {_SCRIPT_COUNTS} FROM ocr_block) SELECT ocr_id, {_SCRIPT} AS found_script, lower(trim(script)) AS label FROM s",
    "script_adversarial": f"WITH l AS (SELECT * FROM (VALUES {_LIT(_LITERALS)}) v(id, text)), s AS (SELECT id, {_SCRIPT_COUNTS} FROM l) SELECT id, {_SCRIPT} AS found_script FROM s",
    "page_summary_text": f"""SELECT run_id, page, string_agg(text, chr(10) ORDER BY CASE WHEN lower(kind) = 'handwriting' THEN 1 ELSE 0 END, coalesce(block_id, -1), ocr_id) AS text, count(*)::INT AS blocks
FROM ocr_block WHERE {_C} <> '' AND NOT coalesce({_FLAG}, false) GROUP BY run_id, page""",
    "merge_child_outputs": """WITH p AS (SELECT run_id, unnest(range(1, pages + 1)) AS page FROM run_header WHERE pages > 0), s AS (SELECT DISTINCT run_id, page FROM page_summary), e AS (SELECT DISTINCT run_id, page FROM page_error)
SELECT p.run_id, CASE WHEN s.run_id IS NOT NULL THEN 'summary' WHEN e.run_id IS NOT NULL THEN 'error' ELSE 'missing' END AS outcome, count(*) AS pages
FROM p LEFT JOIN s ON s.run_id = p.run_id AND s.page = p.page LEFT JOIN e ON e.run_id = p.run_id AND e.page = p.page GROUP BY ALL""",
    "core_metrics": f"WITH {_CORE_SQL} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in 'latency_mean latency_p95 prep_mean prep_p95 boxes_mean boxes_p95 printed_crops_mean handwriting_crops_mean ink_mean ink_p10 ink_p50 ink_p90 placeholder_rate error_rate'.split())}) FROM cm",
    "hard_metrics": f"WITH {_HARD_SQL} SELECT * REPLACE (round(latency_mean, 6) AS latency_mean, round(latency_p95, 6) AS latency_p95, round(placeholder_rate, 6) AS placeholder_rate, round(error_rate, 6) AS error_rate) FROM hm",
    "quantiles": """WITH l AS (SELECT exit_code, list_sort(list(runtime_s) FILTER (runtime_s IS NOT NULL)) AS x FROM job_result GROUP BY exit_code)
SELECT l.exit_code, round(q.v, 6) AS linear, round(x[1 + floor((len(x) - 1) * 0.95)::INT], 6) AS lower
FROM l LEFT JOIN (SELECT exit_code, quantile_cont(runtime_s, 0.95) AS v FROM job_result GROUP BY exit_code) q ON l.exit_code IS NOT DISTINCT FROM q.exit_code""",
    "category_counts": """SELECT run_id, lower(trim(m)) AS category, count(*) AS n, 'mode' AS what FROM (SELECT run_id, mode AS m FROM page_summary UNION ALL SELECT run_id, 'error' FROM page_error) GROUP BY ALL
UNION ALL SELECT run_id, lower(trim(kind)), count(*), 'kind' FROM ocr_block GROUP BY ALL UNION ALL SELECT run_id, lower(trim(script)), count(*), 'script' FROM ocr_block GROUP BY ALL""",
    "js_divergence": f"WITH {_JS_SQL} SELECT pair, what, 'core' AS definition, round(core, 6) AS js FROM mixes UNION ALL SELECT pair, what, 'hard', round(hard, 6) FROM mixes",
    "drift_alerts": f"""WITH {_JS_SQL}, {_CORE_SQL}, j2 AS (SELECT pair, max(core) FILTER (what = 'script') AS js_script, max(core) FILTER (what = 'mode') AS js_mode FROM mixes GROUP BY pair)
SELECT p.pair, p.a AS baseline_run, round(CASE WHEN o.latency_mean > 0 THEN n.latency_mean / o.latency_mean END, 6) AS latency_ratio, {_ABS},
array_to_string(list_filter([CASE WHEN n.error_rate > 0 THEN 'P1_PAGE_ERRORS' END, {_JUNK_SPIKE}, CASE WHEN o.latency_mean > 0 AND n.latency_mean / o.latency_mean > 1.5 THEN 'P2_LATENCY_REGRESSION' END, {_SHIFTS}], lambda x: x IS NOT NULL), ',') AS alerts
FROM pairs p JOIN cm n ON n.run_id = p.b JOIN cm o ON o.run_id = p.a JOIN j2 ON j2.pair = p.pair""",
    "drift_alerts_hard": f"""WITH {_JS_SQL}, {_HARD_SQL}, j2 AS (SELECT pair, max(hard) FILTER (what = 'script') AS js_script, max(hard) FILTER (what = 'mode') AS js_mode FROM mixes GROUP BY pair)
SELECT p.pair, p.a AS baseline_run, {_ABS}, array_to_string(list_filter([CASE WHEN n.errors > 0 THEN 'P1_PAGE_ERRORS' END, {_JUNK_SPIKE}, {_SHIFTS}], lambda x: x IS NOT NULL), ',') AS alerts
FROM pairs p JOIN hm n ON n.run_id = p.b JOIN hm o ON o.run_id = p.a JOIN j2 ON j2.pair = p.pair""",
    "document_ids": """SELECT run_id, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_extract(source_pdf, '[^/]*$'), '(.)\\.[^.]*$', '\\1'))), '[^a-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'document') AS slug,
'doc_' || left(doc_sha256, 16) AS hash_id, coalesce(lower(source_pdf) LIKE '%.pdf', false) AS pdf, strftime(strptime(left(ts_utc, 19), '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts FROM run_header""",
    "engine_route": f"""WITH s AS (SELECT *, {_SCRIPT_COUNTS} FROM ocr_block), r AS (SELECT *, {_SCRIPT} AS f FROM s)
SELECT ocr_id, CASE WHEN lower(trim(mode)) = 'embedded' THEN 'none' WHEN lower(trim(mode)) = 'handwriting' OR f IN ('latin', 'unknown') THEN 'trocr' WHEN lower(trim(mode)) = 'form' THEN 'doctr' ELSE 'paddleocr' END AS route,
CASE f WHEN 'arabic' THEN 'ar' WHEN 'cyrillic' THEN 'ru' WHEN 'cjk' THEN 'ch' ELSE 'en' END AS pack, CASE WHEN len(bbox) = 4 THEN {_BUDGET} END AS tokens FROM r""",
    "ink_gate": """SELECT ocr_id, coalesce(CASE WHEN coalesce(flags.is_form, false) THEN features.ink_ratio >= 0.0020 AND features.ink_pixels >= 180 WHEN lower(kind) = 'handwriting' THEN features.ink_ratio >= 0.0022 AND features.ink_pixels >= 140
ELSE features.ink_ratio >= 0.0018 AND features.ink_pixels >= 160 END, false) AS passes FROM ocr_block WHERE features IS NOT NULL""",
    "reading_order": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY run_id, page ORDER BY bbox[2], bbox[1], bbox[3], bbox[4], {_AREA}, ocr_id) AS soft FROM ocr_block WHERE bbox IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id, page ORDER BY soft) AS rank FROM b WHERE soft <= 360 AND bbox[3] > bbox[1] AND bbox[4] > bbox[2])
SELECT ocr_id, rank, row_number() OVER (PARTITION BY run_id, page ORDER BY CASE WHEN lower(kind) = 'handwriting' THEN 1 ELSE 0 END, rank) - 1 AS crop_id FROM f WHERE rank <= 180""",
    "line_runs": """WITH p AS (SELECT DISTINCT run_id, page FROM page_summary), g AS (SELECT *, page - row_number() OVER (PARTITION BY run_id ORDER BY page) AS i FROM p)
SELECT run_id, greatest(min(page) - 1, 0) AS y0, max(page) + 2 AS y1 FROM g GROUP BY run_id, i""",
    "first_crops": f"""WITH b AS (SELECT run_id, page, {_BUDGET} AS v, row_number() OVER (PARTITION BY run_id, page ORDER BY ocr_id) AS n FROM ocr_block WHERE bbox IS NOT NULL)
SELECT run_id, page, max(v) AS top FROM b WHERE n <= 8 GROUP BY run_id, page""",
    "jsonl_round_trip": f"""SELECT 'record' AS what, {_FLAG} AS flag, count(*) AS n, sum(length(text)) AS chars FROM ocr_block GROUP BY ALL UNION ALL SELECT 'quarantine', NULL, 3, NULL""",
    "run_order": "SELECT run_id, row_number() OVER w AS place, first(run_id) OVER w AS baseline_run FROM run_header WINDOW w AS (PARTITION BY doc_id ORDER BY ts_utc, run_id)",
}
