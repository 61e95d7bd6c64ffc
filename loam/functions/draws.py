"""Deterministic, engine-portable draws from ``md5('<seed>:<field>:<id>')``.

``rand()`` and ``xxhash64`` differ between engines and between runs on
different partitionings; an md5 of the key does not, so a draw can be checked
against SQL and repeats on retry after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_of(text: Column) -> Column:
    """Uniform in ``[0, 1)`` from the first 8 hex digits of the text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def shuffle_key(seed, key: Column) -> Column:
    """Sort key of a seeded shuffle: ``md5('<seed>:<id>')`` (hex string)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def digest256(seed, field: str, key: Column) -> Column:
    """``sha256('<seed>:<field>:<id>')`` as hex: eight independent 32-bit draws."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(field), key.cast("string")), 256)


def draw_at(digest: Column, k: int) -> Column:
    """The ``k``-th 32-bit draw (0..7) of a 256-bit hex digest."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
