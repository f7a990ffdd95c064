"""Scalar functions of the record format: identities, paths, budgets, routes and geometry. Column -> Column, all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws


def iso_utc(ts: Column) -> Column:
    """A timestamp (without zone, UTC) of either ISO spelling, '+00:00' or 'Z'; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(strip_ws(ts), r"(Z|\+00:00)\z", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def file_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+", "/"), "/", -1)


def file_stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*\z", "")


def doc_slug(path: Column) -> Column:
    """Document id of a path: the stem in lower case, other signs than a-z, 0-9, _ and - as one _, none at the ends."""
    s = F.lower(strip_ws(file_stem(path)))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_-]+", "_"), "_+", "_")
    s = F.regexp_replace(s, r"\A_+|_+\z", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("document"))


def hash_id(prefix: str, sha256_hex: Column) -> Column:
    """prefix and the first 16 hexadecimal digits of a content hash."""
    return F.concat(F.lit(prefix), F.substring(sha256_hex, 1, 16))


def content_id(prefix: str, content: Column) -> Column:
    return hash_id(prefix, F.sha2(content.cast("binary"), 256))


def output_path(out_dir: Column, out_name: Column, pdf_path: Column, suffix: str) -> Column:
    """out_dir/name + suffix, where an empty name falls back to the stem of the file."""
    name = F.coalesce(F.nullif(strip_ws(out_name), F.lit("")), file_stem(pdf_path))
    return F.concat(F.regexp_replace(out_dir, r"/+\z", ""), F.lit("/"), name, F.lit(suffix))


# What can be downloaded of a job, and the suffix that stands for .txt.
DOWNLOADS = {"txt": ".txt", "jsonl": ".jsonl", "metrics": ".metrics.json", "deviation": ".deviation.json"}


def download_path(out_txt: Column, kind: str) -> Column:
    """The file of a kind beside the text of a job."""
    return F.concat(F.regexp_replace(out_txt, r"\.txt\z", ""), F.lit(DOWNLOADS[kind]))


def is_pdf(path: Column) -> Column:
    return F.coalesce(F.lower(path).endswith(".pdf"), F.lit(False))


def last_chars(text: Column, n: int = 4000) -> Column:
    return F.right(text, F.lit(n))


def page_banner(page: Column, pages: Column, mode: Column) -> Column:
    return F.format_string("=== PAGE %d / %d (%s) ===", page, pages, mode)


def page_name(page: Column, suffix: str = ".txt") -> Column:
    """The file of one page, its number padded with zeros to four places."""
    return F.format_string("page_%04d" + suffix, page)


def iso_text(ts: Column) -> Column:
    """A timestamp without zone, taken as UTC, in ISO seconds."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def epoch_seconds(ts: Column) -> Column:
    """A timestamp, taken as UTC, in seconds since 1970 with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def fixed(x: Column, places: int) -> Column:
    """A number as text with so many places, halves to the even neighbour, as the record format writes diagnostics."""
    return F.format_string(f"%.{places}f", F.bround(x, places))


def token_budget(kind: Column, area: Column) -> Column:
    """Decoder tokens a crop may take: by area, clamped, handwriting more generously."""
    hand = F.least(F.lit(196), F.greatest(F.lit(64), F.floor(area / 2200).cast("int")))
    printed = F.least(F.lit(128), F.greatest(F.lit(48), F.floor(area / 3200).cast("int")))
    return F.when(kind == "handwriting", hand).otherwise(printed)


def language_pack(script: Column) -> Column:
    """Recogniser language pack of a script."""
    return F.when(script == "arabic", "ar").when(script == "cyrillic", "ru").when(script == "cjk", "ch").otherwise("en")


def engine_route(mode: Column, script: Column) -> Column:
    """The documented routing: embedded text needs no engine, handwriting and latin print take the line model, the rest a full-page engine."""
    return (
        F.when(mode == "embedded", "none").when(mode == "handwriting", "trocr").when(script.isin("latin", "unknown"), "trocr").when(mode == "form", "doctr").otherwise("paddleocr")
    )


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def box(bbox: Column) -> Column:
    """struct<x0, y0, x1, y1> of an array of four, null otherwise."""
    return F.when(F.size(bbox) == 4, F.struct(*(bbox[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))))


def box_area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def padded_box(b: Column, pad: int, width: Column, height: Column) -> Column:
    """The box grown by pad on all sides, inside the page."""
    return F.struct(
        F.greatest(b["x0"] - pad, F.lit(0)).alias("x0"),
        F.greatest(b["y0"] - pad, F.lit(0)).alias("y0"),
        F.least(b["x1"] + pad, width).alias("x1"),
        F.least(b["y1"] + pad, height).alias("y1"),
    )


def quad_box(xs: Column, ys: Column) -> Column:
    """Bounding box of a quadrilateral, cut to integers."""
    return F.struct(*(f(v).cast("int").alias(n) for f, v, n in ((F.array_min, xs, "x0"), (F.array_min, ys, "y0"), (F.array_max, xs, "x1"), (F.array_max, ys, "y1"))))


def relative_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """The box of relative coordinates in pixels, cut to integers."""
    return F.struct(*((v * size).cast("int").alias(n) for v, size, n in ((x0, width, "x0"), (y0, height, "y0"), (x1, width, "x1"), (y1, height, "y1"))))


def valid_block(text: Column, b: Column) -> Column:
    """An engine's block counts if it has text and an area."""
    return F.coalesce((strip_ws(text) != "") & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]), F.lit(False))


def ink_gate(kind: Column) -> Column:
    """struct<ratio, pixels>: the least ink a crop of this kind must show."""
    rows = {"handwriting": (0.0022, 140), "form": (0.0020, 180), "printed": (0.0018, 160)}
    pick = None
    for k, (ratio, pixels) in rows.items():
        value = F.struct(F.lit(ratio).alias("ratio"), F.lit(pixels).alias("pixels"))
        pick = F.when(kind == k, value) if pick is None else pick.when(kind == k, value)
    return pick.otherwise(F.struct(F.lit(0.0018).alias("ratio"), F.lit(160).alias("pixels")))


def enough_ink(ratio: Column, pixels: Column, gate: Column) -> Column:
    return F.coalesce((ratio >= gate["ratio"]) & (pixels >= gate["pixels"]), F.lit(False))


def page_mode(grid_ratio: Column, ink_ratio: Column, small: Column) -> Column:
    """Ruled pages are forms, inky ones with many small components handwriting, the others printed."""
    return F.when(grid_ratio >= 0.012, "form").when((ink_ratio >= 0.020) & (small >= 400), "handwriting").otherwise("printed")
