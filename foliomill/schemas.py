"""One explicit schema per record type, and the superset that ingestion reads. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_MAP = T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


BOX = _struct(x0=_I, y0=_I, x1=_I, y1=_I)
FLAGS = _struct(placeholder=_B, is_form=_B)
FEATURES = _struct(ink_ratio=_D, ink_pixels=_I)
RUN_HEADER = _struct(ts_utc=_S, type=_S, run_id=_S, doc_id=_S, source_pdf=_S, doc_sha256=_S, device=_S, pages=_I, hard_timeout=_B, page_timeout_s=_D)
#: Every field of every record type; the box of a block may be a struct or an array of four.
RECORD = T.StructType(
    [
        *RUN_HEADER.fields,
        *_struct(page=_I, mode=_S, block_id=_I, kind=_S, dpi=_I, bbox=_S, script=_S, text=_S, flags=FLAGS, placeholder=_B, engine=_S, features=FEATURES, diagnostics=_MAP, latency_ms=_L, error=_S, phase=_S).fields,
    ]
)
JOB = _struct(job_id=_S, pdf_path=_S, out_dir=_S, out_name=_S, attempt=_I)
RESULT = _struct(job_id=_S, status=_S, exit_code=_I, out_txt=_S, out_jsonl=_S, stdout=_S, stderr=_S, attempt=_I, runtime_s=_D)
EVENT = _struct(ts=_D, type=_S, job_id=_S, payload=_S)
