"""Records: blocks of both shapes, page texts, the merge of per-page outputs, and JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso_utc, page_banner
from ..functions.text import is_placeholder, kept_text, primary_script
from ..schemas import RECORD


def is_flagged(df: DataFrame) -> Column:
    """The placeholder flag, of the nested or the top-level shape; null where neither is filled."""
    return F.coalesce(F.col("flags.placeholder"), F.col("placeholder"))


def unify_blocks(df: DataFrame) -> DataFrame:
    """Blocks with one flag, one spelling of kind and mode, a timestamp, and script and junk flag worked out anew."""
    return df.withColumns(
        {
            "flagged": F.coalesce(is_flagged(df), F.lit(False)),
            "kind": F.lower(F.trim("kind")),
            "mode": F.lower(F.trim("mode")),
            "ts": iso_utc(F.col("ts_utc")),
            "found_script": primary_script(F.col("text")),
            "junk": is_placeholder(F.col("text")),
        }
    )


def page_texts(blocks: DataFrame) -> DataFrame:
    """run_id, page, text, blocks: the kept block texts of a page, printed before handwriting, in block order, joined by line ends.

    The list a group gathers is one page's blocks, which the crop cap bounds.
    """
    kept = blocks.where(kept_text(F.col("text"), is_flagged(blocks)))
    rank = F.when(F.lower("kind") == "handwriting", 1).otherwise(0)
    item = F.struct(rank.alias("r"), F.coalesce("block_id", F.lit(-1)).alias("b"), F.col("ocr_id").alias("i"), F.col("text").alias("t"))
    pages = kept.groupBy("run_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return pages.select("run_id", "page", F.array_join(F.transform("items", lambda x: x["t"]), "\n").alias("text"), F.size("items").alias("blocks"))


def text_document(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """run_id, page, out: a page of the text sink, its banner and its text; ordered by page at the sink only."""
    both = pages.join(headers.select("run_id", F.col("pages").alias("total")), "run_id", "left")
    banner = page_banner(F.col("page"), F.coalesce("total", "page"), F.coalesce("mode", F.lit("printed")))
    return both.select("run_id", "page", F.concat(banner, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("out"))


def merge_page_outputs(headers: DataFrame, summaries: DataFrame, errors: DataFrame) -> DataFrame:
    """run_id, page, outcome ('summary', 'error', 'missing') of every page a run header promises: pages left-joined with what the
    per-page processes left; a page without output is an error of its own."""
    # runs promise few thousand pages, so the row generator stays small per run
    pages = headers.where(F.col("pages") > 0).select("run_id", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    done = summaries.select("run_id", "page").distinct().withColumn("s", F.lit(1))
    bad = errors.select("run_id", "page").distinct().withColumn("e", F.lit(1))
    both = pages.join(done, ["run_id", "page"], "left").join(bad, ["run_id", "page"], "left")
    return both.select("run_id", "page", F.when(F.col("s") == 1, "summary").when(F.col("e") == 1, "error").otherwise("missing").alias("outcome"))


def union_errors(errors: DataFrame, missing: DataFrame) -> DataFrame:
    """Errors found and errors made up for missing pages, of either shape."""
    made = missing.where("outcome = 'missing'").select("run_id", "page", F.lit("page_error").alias("rec_type"), F.lit("no output").alias("error"), F.lit("merge").alias("phase"))
    return errors.unionByName(made, allowMissingColumns=True)


def parse_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of JSON lines. Blank lines vanish; lines that are no JSON object are quarantined, not dropped."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD.fields) + ", _bad string"
    parsed = lines.where(F.trim(F.col(column)) != "").select(
        F.col(column).alias("line"), F.from_json(F.col(column), fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")
    )
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.col("line").rlike(r"\A\s*\{")
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("line")


def by_type(records: DataFrame) -> dict[str, DataFrame]:
    """The records of each type, of one scan of mixed lines."""
    return {t: records.where(F.col("type") == t) for t in ("run_header", "block", "page_summary", "page_error")}


def text_documents(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """run_id, out: the whole text of each run, its pages in order under their banners. What is gathered is one document's pages."""
    rows = text_document(pages, headers)
    ordered = F.array_sort(F.collect_list(F.struct("page", "out")))
    return rows.groupBy("run_id").agg(ordered.alias("p")).select("run_id", F.array_join(F.transform("p", lambda x: x["out"]), "\n\n").alias("out"))


def run_summary(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """run_id, pages, failed, exit_code of each run: 0 if no page failed, else 10."""
    e = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("failed"))
    p = pages.groupBy("run_id").agg(F.count(F.lit(1)).alias("done"))
    both = p.join(e, "run_id", "full").fillna({"done": 0, "failed": 0})
    return both.select("run_id", (F.col("done") + F.col("failed")).alias("pages"), "failed", F.when(F.col("failed") > 0, 10).otherwise(0).alias("exit_code"))


def to_lines(df: DataFrame) -> DataFrame:
    """value: each row as one line of JSON, nulls left out, nothing escaped beyond need."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value"))
