"""From page images to gated, capped and numbered crops.

Pixels go through Python once a resolution: the coarse image of every page without embedded text gives the page's features and its
regions, the fine image of handwritten pages a row projection and that of forms further regions. What is decided from these (mode,
row runs, reading order, caps, ink gates, crop numbers) is DataFrame work.

Pages: doc_id, page, embedded, low and high as struct<height: int, width: int, data: binary> of gray pixels. Defined cases: embedded
text of 10 signs or more needs no pixels; a null or broken image gives mode 'error' and no crops; a page without regions has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import strip_ws
from ..session import materialize
from . import imaging as I
from . import segment as G

REGION = "struct<x0: int, y0: int, x1: int, y1: int, area: int, pixels: int, size: int>"
#: Pixels a region grows by on all sides; what inks is counted in the grown region.
REGION_PAD = 3
LEAST_EMBEDDED = 10
KEYS = ["doc_id", "page"]


def _regions(ink: np.ndarray, mode: str) -> list[tuple]:
    h, w = ink.shape
    out = []
    for x0, y0, x1, y1, area in I.text_regions(ink, mode):
        a, b, c, d = max(0, x0 - REGION_PAD), max(0, y0 - REGION_PAD), min(w, x1 + REGION_PAD), min(h, y1 + REGION_PAD)
        part = ink[b:d, a:c]
        out.append((x0, y0, x1, y1, int(area), int(part.sum()), int(part.size)))
    return out


def _gray(image) -> np.ndarray:
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"]).astype(float)


def coarse(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, page, mode, ink_ratio, grid_ratio, small, error, regions, width, height of the coarse images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, image in zip(pdf["doc_id"], pdf["page"], pdf["low"]):
                try:
                    ink = I.binarize(_gray(image))
                    found = I.components(ink)
                    small, grid, ratio = sum(10 <= c[4] <= 120 for c in found), I.grid_ratio(ink), float(ink.mean())
                    form = grid >= config.grid_ratio_form
                    hand = not form and ratio >= config.page_ink_handwriting and small >= config.small_handwriting
                    regions = _regions(I.without_rules(ink) if form else ink, "handwriting" if hand else "printed")
                    rows.append((doc, page, ratio, grid, small, None, regions, ink.shape[1], ink.shape[0]))
                except Exception as e:  # noqa: BLE001  (any failure of a page is a record)
                    rows.append((doc, page, None, None, None, f"{type(e).__name__}: {e}"[:500], [], None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ink_ratio", "grid_ratio", "small", "error", "regions", "width", "height"]).astype({"small": "Int32", "width": "Int32", "height": "Int32"})

    schema = f"doc_id string, page int, ink_ratio double, grid_ratio double, small int, error string, regions array<{REGION}>, width int, height int"
    out = pages.select("doc_id", "page", "low").mapInPandas(run, schema)
    by_features = F.when(F.col("grid_ratio") >= config.grid_ratio_form, "form").when(
        (F.col("ink_ratio") >= config.page_ink_handwriting) & (F.col("small") >= config.small_handwriting), "handwriting"
    )
    return out.withColumn("mode", F.when(F.col("error").isNotNull(), "error").otherwise(by_features.otherwise("printed")))


def fine(pages: DataFrame) -> DataFrame:
    """doc_id, page, width, height, rows (ink of each pixel row), regions of the fine images of handwritten pages and forms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, mode, image in zip(pdf["doc_id"], pdf["page"], pdf["mode"], pdf["high"]):
                ink = I.binarize(_gray(image))
                if mode == "form":
                    rows.append((doc, page, ink.shape[1], ink.shape[0], [], _regions(I.without_rules(ink), "handwriting")))
                else:
                    rows.append((doc, page, ink.shape[1], ink.shape[0], ink.sum(axis=1).astype(int).tolist(), []))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "width", "height", "rows", "regions"])

    return pages.select("doc_id", "page", "mode", "high").mapInPandas(run, f"doc_id string, page int, width int, height int, rows array<int>, regions array<{REGION}>")


def _gated(df: DataFrame, ratio: Column | float, pixels: Column | int) -> DataFrame:
    share = F.coalesce(F.try_divide(F.col("ink_pixels").cast("double"), F.col("size")), F.lit(0.0))
    return df.withColumn("ink_ratio", share).where((F.col("ink_ratio") >= ratio) & (F.col("ink_pixels") >= pixels))


def _of_regions(df: DataFrame, cap: int, kind: str, dpi: int) -> DataFrame:
    """The first regions of each page in reading order, grown and cut to the page."""
    flat = df.select(*KEYS, "mode", "width", "height", F.posexplode("regions").alias("at", "b"))
    top = G.capped_regions(flat, KEYS, "b", cap, "at")
    box = F.struct(
        F.greatest(F.col("b.x0") - REGION_PAD, F.lit(0)).alias("x0"), F.greatest(F.col("b.y0") - REGION_PAD, F.lit(0)).alias("y0"),
        F.least(F.col("b.x1") + REGION_PAD, F.col("width")).alias("x1"), F.least(F.col("b.y1") + REGION_PAD, F.col("height")).alias("y1"),
    )
    return top.select(*KEYS, "mode", F.lit(kind).alias("kind"), F.lit(dpi).alias("dpi"), box.alias("bbox"), F.col("b.pixels").alias("ink_pixels"), F.col("b.size").alias("size"), "rank")


def _lines(df: DataFrame, dpi: int) -> DataFrame:
    """Lines of handwriting: runs of inked pixel rows, grown and cut to the page; as many as there are."""
    rows = df.select(*KEYS, "width", "height", F.posexplode("rows").alias("y", "ink"))
    inked = G.inked_rows(rows, "ink", "width")
    # the run's end stands one row short of what runs() gives, as the last inked row itself is grown from
    runs = G.runs(inked, KEYS, "y").withColumn("y1", F.col("y1") - 1)
    both = runs.join(df.select(*KEYS, "mode", "width", "height", "rows"), KEYS)
    end = F.least(F.col("y1"), F.col("height"))
    box = F.struct(F.lit(0).alias("x0"), F.col("y0"), F.col("width").alias("x1"), end.cast("int").alias("y1"))
    ink = F.aggregate(F.slice("rows", F.col("y0") + 1, end - F.col("y0")), F.lit(0), lambda a, x: a + x)
    return both.select(*KEYS, "mode", F.lit("handwriting").alias("kind"), F.lit(dpi).alias("dpi"), box.alias("bbox"), ink.alias("ink_pixels"), ((end - F.col("y0")) * F.col("width")).alias("size"), F.col("y0").alias("rank"))


def prepare(pages: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(pages with mode, text, error and counts, crops): the branches of embedded, handwritten, printed and form pages."""
    text = strip_ws(F.col("embedded"))
    known = pages.withColumn("text", F.when(F.char_length(text) >= LEAST_EMBEDDED, text))
    # the pixels of a page pass through Python once a resolution: what comes of them is written
    seen = materialize(coarse(known.where("text is null"), config), "coarse-pages")
    low = seen.where(F.col("mode").isin("printed", "form"))
    printed = _of_regions(low, config.max_crops, "printed", config.low_dpi)
    is_form = F.col("mode") == "form"
    least = lambda a, b: F.when(is_form, a).otherwise(b)
    printed = _gated(printed, least(config.form_min_ratio, config.printed_min_ratio), least(config.form_min_pixels, config.printed_min_pixels))
    high = fine(known.join(seen.where(F.col("mode").isin("handwriting", "form")).select(*KEYS, "mode"), KEYS))
    high = materialize(high.join(seen.select(*KEYS, "mode"), KEYS), "fine-pages")
    lines = _gated(_lines(high.where("mode = 'handwriting'"), config.high_dpi), config.handwriting_min_ratio, config.handwriting_min_pixels)
    fields = _of_regions(high.where("mode = 'form'"), G.form_cap(config.max_crops), "handwriting", config.high_dpi)
    fields = _gated(fields, config.form_handwriting_min_ratio, config.form_handwriting_min_pixels)
    columns = [*KEYS, "kind", "dpi", "bbox", "ink_ratio", "ink_pixels", is_form.alias("is_form"), "rank"]
    crops = printed.select(*columns).unionByName(lines.select(*columns)).unionByName(fields.select(*columns))
    crops = G.crop_ids(crops, KEYS, "kind", [F.col("rank")]).drop("rank")
    counts = crops.groupBy(*KEYS).agg(F.count_if(F.col("kind") == "printed").alias("printed_crops"), F.count_if(F.col("kind") == "handwriting").alias("handwriting_crops"))
    boxes = F.least(F.size("regions"), F.lit(config.max_crops))
    states = known.select(*KEYS, "text").join(seen.select(*KEYS, "mode", "error", boxes.alias("boxes")), KEYS, "left").join(counts, KEYS, "left")
    storm = F.coalesce(F.col("boxes") >= config.max_crops, F.lit(False))
    out = states.select(*KEYS, F.coalesce("mode", F.lit("embedded")).alias("mode"), "text", "error", "boxes", storm.alias("storm"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("printed_crops", "handwriting_crops")))
    return out, crops
