"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

RANGE = 1 << 30


def bounded_sample(df: DataFrame, key: str, columns: list[str], where: str, size: int, salt: int) -> list[Row]:
    """About ``size`` rows that satisfy ``where``, never more than a quarter above it, chosen by a hash of the key.

    The hash range is set from the table's row count, so the tasks send about ``size``
    rows in all, however many tasks there are (an ordered limit would send that many a task).
    """
    total = df.count()
    share = min(1.0, 1.1 * size / max(1, total))
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(RANGE))
    rows = df.filter(h < int(share * RANGE)).filter(where).select(*columns, h.alias("__h"), F.col(key).alias("__k")).limit(size + size // 4).collect()
    return sorted(rows, key=lambda r: (r["__h"], str(r["__k"])))
