"""Sources and sinks over files: JSON lines, pages of binary files, baselines that are written once, job folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..operators.records import parse_lines, to_lines


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined lines) of JSON-lines files. Lines end at line feeds only."""
    return parse_lines(spark.read.option("lineSep", "\n").text(path))


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines through Spark's commit protocol: readers see all of it or none."""
    to_lines(df).write.mode("overwrite").text(path)


def write_partitioned_events(df: DataFrame, path: str) -> None:
    """Append-only events, a folder a day, so that a job's or a day's history is read without the rest."""
    df.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """A baseline's metrics; None if it is absent or unreadable, which disables the comparison."""
    try:
        df = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
        if "_corrupt_record" in df.columns or not df.columns:
            return None
        return df
    except Exception:  # noqa: BLE001  (Spark has several exceptions for a missing path)
        return None


def create_baseline(df: DataFrame, path: str) -> None:
    """Writes a baseline only if there is none."""
    df.write.mode("ignore").json(path)


def read_hashes(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, sha256 of files, without their content leaving the JVM."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_pages(spark: SparkSession, path: str, decode: Callable[[bytes], list[str | None]], pattern: str = "*.pdf", least: int = 10) -> DataFrame:
    """path, page, text: the embedded text of each page by a plugged-in decoder, null where it is shorter than least characters. A
    decoder that fails gives page null with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(p, i, t, None) for i, t in enumerate(decode(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    pages = files.mapInPandas(run, "path string, page int, text string, error string")
    text = strip_ws(F.col("text"))
    return pages.withColumn("text", F.when(F.char_length(text) >= least, text))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "true").load(path)
