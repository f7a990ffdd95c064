"""Queries over page images drawn by rule, so that what must come out is known from the drawing."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import imaging as I
from ..operators import prepare as P
from ..session import work_dir

IMAGE = "struct<height: int, width: int, data: binary>"
#: Gray paper and ink.
PAPER, INK = 240, 20


def _paper(h: int, w: int) -> np.ndarray:
    return np.full((h, w), PAPER, np.uint8)


def _letters(a: np.ndarray, y: int, x: int, n: int) -> None:
    """n letters in a row: marks of 4 x 6 pixels, 3 apart."""
    for k in range(n):
        a[y : y + 6, x + 7 * k : x + 7 * k + 4] = INK


def printed_page() -> np.ndarray:
    """Three lines of print, a speck below the least area and two letters that are too little ink for a crop."""
    a = _paper(300, 400)
    for y in (40, 100, 160):
        _letters(a, y, 60, 30)
    a[220:223, 60:63] = INK
    _letters(a, 250, 60, 2)
    return a


def form_page() -> np.ndarray:
    """A ruled grid with two filled fields."""
    a = _paper(300, 400)
    for y in range(20, 290, 60):
        a[y : y + 2, 20:380] = INK
    for x in range(20, 390, 90):
        a[20:262, x : x + 2] = INK
    _letters(a, 46, 40, 8)
    _letters(a, 106, 130, 8)
    return a


def handwritten_page() -> np.ndarray:
    """Six lines of a hundred small marks."""
    a = _paper(300, 640)
    for line in range(6):
        for k in range(100):
            a[30 + 40 * line : 35 + 40 * line, 20 + 6 * k : 23 + 6 * k] = INK
    return a


DRAWN = {1: None, 2: printed_page, 3: form_page, 4: handwritten_page, 5: None}


def pages(spark: SparkSession) -> DataFrame:
    """An embedded page, a printed one, a form, a handwritten one, and one whose image is broken."""
    rows = []
    for page, draw in DRAWN.items():
        image = None
        if draw:
            a = draw()
            image = (a.shape[0], a.shape[1], a.tobytes())
        rows.append(("drawn", page, "The embedded text of the page." if page == 1 else " short ", image if page != 5 else (10, 10, b"x"), image))
    return spark.createDataFrame(rows, f"doc_id string, page int, embedded string, low {IMAGE}, high {IMAGE}")


def png(gray: np.ndarray) -> bytes:
    """A gray image as PNG."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = gray.shape
    lines = b"".join(b"\0" + gray[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def page_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode, boxes and crops of the drawn pages."""
    done, _ = P.prepare(pages(spark))
    return done.select("page", "mode", F.col("error").isNotNull().alias("failed"), "boxes", "storm", "printed_crops", "handwriting_crops")


def page_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crops of the drawn pages."""
    _, crops = P.prepare(pages(spark))
    return crops.select("page", "crop_id", "kind", "dpi", "is_form", *(F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


def page_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a cap of two crops, which handwritten lines don't know."""
    done, _ = P.prepare(pages(spark), Config(max_crops=2))
    return done.select("page", "storm", "printed_crops", "handwriting_crops")


def image_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and mode of the drawn pages as PNG files through the image source."""
    folder = work_dir(spark, "images")
    rows = [(f"{page}.png", png(draw())) for page, draw in DRAWN.items() if draw]
    files = spark.createDataFrame(rows, "name string, content binary")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, content in files.collect():  # three drawings
        out = fs.create(hadoop.Path(f"{folder}/{name}"))
        out.write(bytearray(content))
        out.close()
    found = I.page_features(spark.read.format("image").load(folder))
    name = F.regexp_extract("path", r"(\d+)\.png\z", 1).cast("int")
    return found.select(name.alias("page"), "width", "height", "mode", (F.col("small") >= 400).alias("many_small"), (F.col("grid_ratio") >= 0.012).alias("ruled"))


QUERIES = {"page_preparation": page_preparation, "page_crops": page_crops, "page_caps": page_caps, "image_modes": image_modes}

# what the drawings must give: regions are the drawn letters, closed along the line and grown by the pad
_HAND = ", ".join(f"(4, {i}, 'handwriting', 300, false, 0, {23 + 40 * i}, 640, {41 + 40 * i})" for i in range(6))
ORACLES = {
    "page_preparation": """SELECT * FROM (VALUES (1, 'embedded', false, NULL, false, 0, 0), (2, 'printed', false, 4, false, 3, 0), (3, 'form', false, 2, false, 2, 2), (4, 'handwriting', false, 6, false, 0, 6), (5, 'error', true, 0, false, 0, 0))
v(page, mode, failed, boxes, storm, printed_crops, handwriting_crops)""",
    "page_crops": f"""SELECT * FROM (VALUES (2, 0, 'printed', 200, false, 57, 37, 272, 51), (2, 1, 'printed', 200, false, 57, 97, 272, 111), (2, 2, 'printed', 200, false, 57, 157, 272, 171),
(3, 0, 'printed', 200, true, 37, 43, 98, 57), (3, 1, 'printed', 200, true, 127, 103, 188, 117), (3, 2, 'handwriting', 300, true, 37, 42, 98, 56), (3, 3, 'handwriting', 300, true, 127, 102, 188, 116), {_HAND})
v(page, crop_id, kind, dpi, is_form, x0, y0, x1, y1)""",
    "page_caps": "SELECT * FROM (VALUES (1, false, 0, 0), (2, true, 2, 0), (3, true, 2, 2), (4, true, 0, 6), (5, false, 0, 0)) v(page, storm, printed_crops, handwriting_crops)",
    "image_modes": "SELECT * FROM (VALUES (2, 400, 300, 'printed', false, false), (3, 400, 300, 'form', false, true), (4, 640, 300, 'handwriting', true, false)) v(page, width, height, mode, many_small, ruled)",
}
