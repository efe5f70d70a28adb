"""The same windows through Spark's own ``window`` function, for comparison and upsert feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepane.functions.aggregates import Aggregate, updates
from tidepane.spec import WindowSpec


def native_windows(
    df: DataFrame,
    spec: WindowSpec,
    aggs: Sequence[Aggregate],
    keys: Sequence[str] = (),
    *,
    ts: str = "ts",
) -> DataFrame:
    """Aggregate per ``window(ts, W, S)``: each row is copied into every window it belongs to
    before aggregating. Windows are not bounded by the progress of the stream."""
    if spec.origin_from_data:
        raise ValueError("the window function needs a fixed origin")
    # Windows are aligned by their ends, Spark's by their starts.
    origin = 0 if spec.origin == "epoch" else int(spec.origin)
    start = (origin - spec.window_ms) % spec.slide_ms
    spans = [f"{ms} milliseconds" for ms in (spec.window_ms, spec.slide_ms, start)]
    return (
        df.groupBy(*keys, F.window(F.col(ts), *spans).alias("span"))
        .agg(F.count(F.lit(1)).alias("n"), *updates(aggs))
        .select(
            *keys,
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "n",
            *[agg.result() for agg in aggs],
        )
    )
