"""Event-time progress, slide and epoch assignment, and the lateness filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepane.functions.slides import ORIGIN, slide_of
from tidepane.operators.running import (
    BUCKET_BITS,
    HOT_ROWS,
    LEVELS,
    carry_first,
    carry_max,
    find_cuts,
    find_hot_keys,
    running_extreme,
)
from tidepane.sources.arrivals import SEQ, TS
from tidepane.spec import WindowSpec

START = "_start_ms"


def with_progress(
    rows: DataFrame,
    spec: WindowSpec,
    keys: Sequence[str] = (),
    *,
    heads: DataFrame | None = None,
    bits: int = BUCKET_BITS,
    levels: int | None = None,
    hot_rows: int = HOT_ROWS,
    cuts: list[float] | None = None,
) -> DataFrame:
    """Add ``progress_ms`` (running max of event time by arrival), ``lateness_ms``, ``slide``
    (where the row belongs) and ``epoch`` (the slide that was open when it arrived).

    With ``origin='first'`` the key's first event time is added as ``origin_ms``. ``heads`` holds
    ``keys, progress_ms[, origin_ms]`` reached by an earlier part of the stream.

    Without keys the stream is cut into arrival buckets (see :func:`running_extreme`); with keys,
    those with more than ``hot_rows`` rows are. Where arrival numbers are sparse the borders of the
    buckets are quantiles. Giving ``levels`` fixes the number of bucket levels for all keys (and
    ``cuts`` the borders) and saves counting.
    """
    hot = None
    if levels is None:
        levels, hot = find_hot_keys(rows, keys, hot_rows) if keys else (LEVELS, None)
        cuts = find_cuts(rows, SEQ, bits) if levels else None
    carries = {"progress_ms": carry_max(TS)}
    seeds = heads
    if seeds is not None:
        seeds = seeds.withColumn(TS, F.col("progress_ms"))
    if spec.origin_from_data:
        rows = rows.withColumn(START, F.col(TS))
        carries[ORIGIN] = carry_first(START)
        if seeds is not None:
            seeds = seeds.withColumn(START, F.col(ORIGIN))
    reached = running_extreme(
        rows, SEQ, carries, keys, seeds=seeds, bits=bits, levels=levels, hot=hot, cuts=cuts
    ).drop(START)
    return reached.withColumns({
        "lateness_ms": F.col("progress_ms") - F.col(TS),
        "slide": slide_of(F.col(TS), spec),
        "epoch": slide_of(F.col("progress_ms"), spec),
    })


def accepted(progressed: DataFrame, spec: WindowSpec) -> DataFrame:
    """Rows within the allowed lateness (inclusive)."""
    return progressed.filter(F.col("lateness_ms") <= spec.lateness_ms)


def dropped(progressed: DataFrame, spec: WindowSpec) -> DataFrame:
    """Rows over the allowed lateness: the audit of what :func:`accepted` leaves out."""
    return progressed.filter(F.col("lateness_ms") > spec.lateness_ms)
