"""Every knob in one frozen object, read once from a mapping of environment names and passed explicitly."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


def _knob(env: str, default):
    from dataclasses import field

    return field(default=default, metadata={"env": env})


@dataclass(frozen=True)
class Config:
    # Names and defaults of the knobs.
    model_printed: str = _knob("OCR_MODEL_PRINTED", "printed")
    model_handwritten: str = _knob("OCR_MODEL_HANDWRITTEN", "handwritten")
    grid_ratio_form: float = _knob("OCR_GRID_RATIO_FORM", 0.012)
    page_ink_handwriting: float = _knob("OCR_PAGE_INK_HW", 0.020)
    small_handwriting: int = _knob("OCR_CC_SMALL_HW", 400)
    handwriting_min_ratio: float = _knob("OCR_HW_MIN_RATIO", 0.0022)
    handwriting_min_pixels: int = _knob("OCR_HW_MIN_PIXELS", 140)
    form_min_ratio: float = _knob("OCR_FORM_MIN_RATIO", 0.0020)
    form_min_pixels: int = _knob("OCR_FORM_MIN_PIXELS", 180)
    printed_min_ratio: float = _knob("OCR_PR_MIN_RATIO", 0.0018)
    printed_min_pixels: int = _knob("OCR_PR_MIN_PIXELS", 160)
    form_handwriting_min_ratio: float = _knob("OCR_FORM_HW_MIN_RATIO", 0.0022)
    form_handwriting_min_pixels: int = _knob("OCR_FORM_HW_MIN_PIXELS", 160)
    low_dpi: int = _knob("OCR_LOW_DPI", 200)
    high_dpi: int = _knob("OCR_HIGH_DPI", 300)
    max_crops: int = _knob("OCR_MAX_CROPS", 180)
    engine: str = _knob("OCR_ENGINE_PREF", "auto")
    page_timeout_s: float = _knob("OCR_PAGE_TIMEOUT_SECONDS", 0.0)
    workers: int = _knob("OCR_WORKERS", 4)
    prefetch: int = _knob("OCR_PREFETCH", 2)
    batch: int = _knob("OCR_BATCH", 2)
    hard_page_timeout_s: float = _knob("OCR_HARD_PAGE_TIMEOUT", 0.0)
    max_retries: int = _knob("JOB_MAX_RETRIES", 2)
    job_timeout_s: float = _knob("JOB_TIMEOUT", 3600.0)
    data_in: str = _knob("OCR_DATA_IN", "/data/in")
    data_out: str = _knob("OCR_DATA_OUT", "/data/out")

    @classmethod
    def read(cls, env: Mapping[str, str]) -> Config:
        """Values that are absent or blank keep their defaults; what can't be read as its type is an error that names the knob. Prefetch
        and batch are clamped to 1-8 and 1-32."""
        values = {}
        for f in fields(cls):
            name, kind = f.metadata["env"], type(f.default)
            text = env.get(name, "").strip()
            if text:
                try:
                    values[f.name] = kind(text)
                except ValueError as e:
                    raise ValueError(f"{name}: {text!r} is no {kind.__name__}") from e
        out = cls(**values)
        clamped = {"prefetch": min(8, max(1, out.prefetch)), "batch": min(32, max(1, out.batch))}
        return cls(**{**{f.name: getattr(out, f.name) for f in fields(cls)}, **clamped})

    def rows(self) -> list[tuple[str, str]]:
        """(environment name, value as text) of every knob."""
        return [(f.metadata["env"], str(getattr(self, f.name))) for f in fields(self)]
