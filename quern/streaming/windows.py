"""Event-time aggregates, the same for tables and for streams.

An extension beyond the builders: tumbling, sliding and session windows with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(rows: DataFrame, time: str, length: str, keys: list[str], aggregates: dict[str, str], *, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by key and window; window_start and window_end beside them. Rows later than `late` are dropped by a stream."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return _grouped(rows, time, window, keys, aggregates, late)


def sessions(rows: DataFrame, time: str, gap: str, keys: list[str], aggregates: dict[str, str], *, late: str | None = None) -> DataFrame:
    """Aggregates by key and session, which ends after a gap without rows."""
    return _grouped(rows, time, F.session_window(time, gap), keys, aggregates, late)


def _grouped(rows: DataFrame, time: str, window: Column, keys: list[str], aggregates: dict[str, str], late: str | None) -> DataFrame:
    kind = rows.schema[time].dataType
    if late:  # watermarks stand on timestamps of a zone only
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    found = rows.groupBy(window.alias("w"), *keys).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])
    ends = [F.col(f"w.{side}").cast(kind).alias(f"window_{side}") for side in ("start", "end")]
    return found.select(*ends, *keys, *aggregates)
