"""Helpers shared by the operators: bounded Arrow slices, a per-worker cache, written intermediates."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import materialize, read_table

__all__ = ["bounded", "materialize", "read_table", "utf8_buffers", "worker_cache", "SPACES"]

#: Fixed value: the white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def bounded(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of at most ``max_bytes`` of text (one row at least), so that what
    a worker holds depends on the longest text and not on how Spark sized its batches."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < n:
            base = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's ``[start, end)`` as offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.string())
    if column.offset or len(column) == 0:
        column = pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1).astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[: int(offsets[-1])], offsets


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker (functions pickled by value have globals
    of their own in each task). Holds only what a retried task would build again: tables and memos."""
    return sys.modules.setdefault("_loam_llm_cache", types.ModuleType("_loam_llm_cache")).__dict__


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns cannot clash."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])
