"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import languages, mix, pii, residue, scans, tokens, truncation
from . import percentiles as pct

PER_MILLE = (50, 250, 500, 750, 900, 950, 990)


def _latency_summary(spark: SparkSession, sf_dir: str, digits: int | None) -> DataFrame:
    df = table(spark, sf_dir, "page_summary")
    mode = F.lower(F.trim("mode"))
    day = F.to_date(F.try_to_timestamp(F.substring("ts_utc", 1, 10), F.lit("yyyy-MM-dd")))
    return pct.summarise(df, F.col("latency_ms"), {"mode": mode, "day": day}, digits)


def _latency(spark: SparkSession, sf_dir: str, digits: int | None) -> DataFrame:
    """Per mode and day, and per mode for all days put together (day is null, scope 'all')."""
    days = materialize(_latency_summary(spark, sf_dir, digits), "latency-counts")
    every = pct.combine(days, ["mode"])
    both = days.select(F.lit("day").alias("scope"), "mode", "day", "value", "n").unionByName(
        every.select(F.lit("all").alias("scope"), "mode", F.lit(None).cast("date").alias("day"), "value", "n")
    )
    out = pct.percentiles(both, ["scope", "mode", "day"], PER_MILLE, digits)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p5_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of latency_ms."""
    return _latency(spark, sf_dir, None)


def p5_latency_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a summary of bounded size: 8 binary digits, so within 1/128 of the value."""
    return _latency(spark, sf_dir, 8)


def _latency_sql(cell: str, width: str) -> str:
    picks = ", ".join(f"max(CASE WHEN r = (n * {q} + 999) // 1000 THEN v END) AS p{q}" for q in PER_MILLE)
    bound = ", ".join(width.format(v=f"p{q}") for q in PER_MILLE)
    return f"""
WITH m AS (SELECT lower(trim(mode)) AS mode, left(ts_utc, 10) AS day, latency_ms AS x FROM page_summary WHERE latency_ms >= 0),
s AS (SELECT 'day' AS scope, mode, day, x FROM m UNION ALL SELECT 'all', mode, NULL, x FROM m),
c AS (SELECT scope, mode, day, {cell.format(v='x')} AS v FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, mode, day ORDER BY v) AS r, count(*) OVER (PARTITION BY scope, mode, day) AS n FROM c),
p AS (SELECT scope, mode, day, max(n) AS n, {picks} FROM r GROUP BY scope, mode, day)
SELECT *, greatest({bound}) AS error_bound FROM p"""


_WIDTH = "CASE WHEN {v} < 256 THEN 1 ELSE (1::BIGINT << (length(bin({v})) - 8)) END"


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the ids of byte_bpe_50k of its text."""
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the decoded ids are the text again, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    again = tokens.decode(p7_ids(spark, sf_dir))
    return docs.join(again, "doc_id").select("doc_id", (F.col("was") == F.col("text")).alias("same"))


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = materialize(tokens.count_tokens(table(spark, sf_dir, "documents"), keep=("source",)), "doc-tokens")
    return sized, materialize(mix.calibrate(sized, mix.rates(sized, table(spark, sf_dir, "mix_target"))), "mix-rates")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: each copy of each document that is in it."""
    return mix.emit(*_sized(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix.shares(*_sized(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of each text that was cut."""
    return truncation.found(table(spark, sf_dir, "documents"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts."""
    return truncation.rates(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ocr_id of each block of template residue, filler, error message or scripts-required notice."""
    return residue.found(table(spark, sf_dir, "ocr_block"))


def p1_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other blocks, unchanged."""
    return residue.content(table(spark, sf_dir, "ocr_block")).select("ocr_id", "run_id", "page", "text")


def _languages(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    rows, codes = table(spark, sf_dir, "ocr_block"), table(spark, sf_dir, "lang_code")
    return languages.blocks(rows, languages.fit(table(spark, sf_dir, "lang_sample"), rows, codes), codes, every)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ocr_id and language of each block whose labels are missing or wrong or that mixes languages."""
    per = _languages(spark, sf_dir).where("mend and lang <> 'und'").select("ocr_id", "lang")
    return per.join(p1_found(spark, sf_dir), "ocr_id", "left_anti")


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, script, number of whole sentences and confidence of every block; 'und' with confidence 0 if it has no letters."""
    return _languages(spark, sf_dir, every=True).withColumn("confidence", F.round("confidence", 4))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its language and confidence; of blocks without whole sentences their paragraphs, at least one row of each."""
    rows = table(spark, sf_dir, "ocr_block")
    return languages.segments(rows, languages.fit(table(spark, sf_dir, "lang_sample"), rows, table(spark, sf_dir, "lang_code")), every=True).drop("whole")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ocr_id and each defect of scanned text it has."""
    return scans.found(table(spark, sf_dir, "ocr_block"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block's text as continuous paragraphs."""
    return scans.repaired(table(spark, sf_dir, "ocr_block"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ocr_id, pii_kind and occ of each mention of personal information."""
    return pii.found(table(spark, sf_dir, "ocr_block"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block's text with placeholders for its mentions."""
    return pii.redacted(table(spark, sf_dir, "ocr_block"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_repaired": p3_repaired, "p4_found": p4_found, "p4_labels": p4_labels, "p4_segments": p4_segments, "p1_found": p1_found, "p1_content": p1_content, "p9_found": p9_found, "p9_rates": p9_rates, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_mix": p8_mix, "p8_shares": p8_shares, "p5_latency": p5_latency, "p5_latency_grid": p5_latency_grid}
ORACLES = {
    "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p5_latency": _latency_sql("{v}", "0 * {v}"),
    "p5_latency_grid": _latency_sql("{v} - {v} % " + _WIDTH, _WIDTH + " - 1"),
}
