"""Column expressions that map event time to slides, panes and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepane.spec import WindowSpec

ORIGIN = "origin_ms"


def floor_div(numerator: Column, width: int) -> Column:
    """Flooring division as BIGINT; a cast would truncate times before the origin toward zero.

    Exact for |numerator| < 2**53, which covers any millisecond timestamp.
    """
    if width == 1:
        return numerator.cast("long")
    return F.floor(numerator / F.lit(width))


def origin_of(spec: WindowSpec) -> Column:
    if spec.origin_from_data:
        return F.col(ORIGIN)
    return F.lit(0 if spec.origin == "epoch" else int(spec.origin)).cast("long")


def slide_of(ms: Column, spec: WindowSpec) -> Column:
    return floor_div(ms - origin_of(spec), spec.slide_ms)


def pane_of(ms: Column, spec: WindowSpec) -> Column:
    return floor_div(ms - origin_of(spec), spec.pane_ms)


def first_window_of(pane: Column, spec: WindowSpec) -> Column:
    """First window (by the index of its last slide) that contains the pane."""
    return floor_div(pane * spec.pane_ms, spec.slide_ms)


def last_window_of(pane: Column, spec: WindowSpec) -> Column:
    return floor_div(pane * spec.pane_ms + spec.window_ms, spec.slide_ms) - 1


def slide_end(index: Column, spec: WindowSpec) -> Column:
    return F.timestamp_millis(origin_of(spec) + (index + 1) * spec.slide_ms)


def window_start(index: Column, spec: WindowSpec) -> Column:
    return F.timestamp_millis(origin_of(spec) + (index + 1) * spec.slide_ms - spec.window_ms)


def epoch_millis(df: DataFrame, name: str) -> Column:
    """Event time as epoch milliseconds from TIMESTAMP, TIMESTAMP_NTZ (session zone) or BIGINT."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_millis(F.col(name).cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(F.col(name))
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return F.col(name).cast("long")
    raise TypeError(f"event time column {name} has type {kind.simpleString()}")
