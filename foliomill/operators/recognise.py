"""Recognition behind an interface: models plug in, the engine batches, times out and records failures."""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quad_box, relative_box, valid_block
from ..functions.text import strip_ws


class Recogniser(Protocol):
    """Made once per Python worker by a factory; reads a batch of crops."""

    def read(self, images: list[bytes], kinds: list[str], tokens: list[int]) -> list[str]: ...


@dataclass(frozen=True)
class Decoding:
    """How a line model decodes: greedily, with repeats held down. Fixed values of the record format."""

    beams: int = 1
    no_repeat_ngram: int = 3
    repetition_penalty: float = 1.12


def device(has_gpu: bool) -> tuple[str, str, int]:
    """(device, number type, batch) for what there is."""
    return ("cuda", "float16", 6) if has_gpu else ("cpu", "float32", 2)


def blocks_of_quads(lines: DataFrame) -> DataFrame:
    """page, bbox, text, conf, engine of a full-page engine that gives quadrilaterals: page, xs, ys, text, conf. Lines without text or area
    are left out."""
    box = quad_box(F.col("xs"), F.col("ys"))
    return _kept(lines.select("page", box.alias("b"), "text", F.col("conf").cast("double").alias("conf"), F.lit("paddleocr").alias("engine")))


def blocks_of_shares(lines: DataFrame) -> DataFrame:
    """The same of an engine that gives words and boxes relative to the page: page, words, x0, y0, x1, y1, width, height; it has no confidence."""
    box = relative_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")))
    text = strip_ws(F.array_join("words", " "))
    return _kept(lines.select("page", box.alias("b"), text.alias("text"), F.lit(None).cast("double").alias("conf"), F.lit("doctr").alias("engine")))


def _kept(rows: DataFrame) -> DataFrame:
    box = F.array(*(F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1")))
    return rows.where(valid_block(F.col("text"), F.col("b"))).select("page", box.alias("bbox"), "text", "conf", "engine")


def available(module: str) -> bool:
    """Whether an optional engine is installed."""
    return importlib.util.find_spec(module) is not None


def recognise(crops: DataFrame, factory, batch: int = 6, page_seconds: float = 0.0) -> DataFrame:
    """crop key, text, error of crops (run_id, page, crop_id, kind, tokens, image).

    An exception becomes an error row instead of failing the task. With page_seconds set, the time a page has taken is checked
    before each batch, and what is left of it becomes error rows too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        spent: dict[tuple, float] = {}
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                keys = list(zip(part["run_id"], part["page"], part["crop_id"]))
                late = [page_seconds > 0 and spent.get(k[:2], 0.0) > page_seconds for k in keys]
                live = [i for i, x in enumerate(late) if not x]
                began = time.monotonic()
                try:
                    texts = model.read([bytes(part["image"].iloc[i]) for i in live], [part["kind"].iloc[i] for i in live], [int(part["tokens"].iloc[i]) for i in live]) if live else []
                    done = {i: (t, None) for i, t in zip(live, texts)}
                except Exception as e:  # noqa: BLE001  (any failure of a model is a record)
                    done = {i: (None, f"{type(e).__name__}: {e}"[:500]) for i in live}
                took = time.monotonic() - began
                for i, k in enumerate(keys):
                    if i in done:
                        spent[k[:2]] = spent.get(k[:2], 0.0) + took / max(len(live), 1)
                    out.append((*k, *done.get(i, (None, "TimeoutError: page budget used up"))))
            yield pd.DataFrame(out, columns=["run_id", "page", "crop_id", "text", "error"])

    rows = crops.select("run_id", "page", "crop_id", "kind", "tokens", "image").where(F.col("image").isNotNull())
    return rows.mapInPandas(run, "run_id string, page int, crop_id int, text string, error string")
