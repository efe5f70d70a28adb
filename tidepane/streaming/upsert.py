"""Upsert feed: every trigger re-emits the windows it changed.

Late rows update their past windows, but which late rows are still accepted follows Spark's
watermark: it looks at window ends and advances between micro-batches. Use
:class:`tidepane.streaming.ExactStream` where the lateness rule must hold row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepane.functions.aggregates import Aggregate, merges, state_of, updates
from tidepane.functions.slides import first_window_of, last_window_of, pane_of, slide_end, window_start
from tidepane.plans.native import native_windows
from tidepane.spec import WindowSpec


def upsert_feed(
    stream: DataFrame,
    spec: WindowSpec,
    aggs: Sequence[Aggregate],
    keys: Sequence[str] = (),
    *,
    ts: str = "ts",
) -> DataFrame:
    """A streaming DataFrame for ``outputMode('update')``; ``ts`` must be TIMESTAMP."""
    marked = stream.withWatermark(ts, f"{spec.lateness_ms} milliseconds")
    return native_windows(marked, spec, aggs, keys, ts=ts)


def pane_feed(
    stream: DataFrame,
    spec: WindowSpec,
    aggs: Sequence[Aggregate],
    keys: Sequence[str] = (),
    *,
    ts: str = "ts",
) -> DataFrame:
    """The feed by panes: a row is kept in one pane, not in every window it belongs to, so state
    is smaller by the number of slides in a window, and so is what a trigger emits.

    ``windows_of_panes`` makes windows of what was written. A row is late when its pane, not the
    last of its windows, has ended before the watermark.
    """
    if spec.origin_from_data:
        raise ValueError("the window function needs a fixed origin")
    origin = 0 if spec.origin == "epoch" else int(spec.origin)
    spans = [f"{ms} milliseconds" for ms in (spec.pane_ms, spec.pane_ms, origin % spec.pane_ms)]
    marked = stream.withWatermark(ts, f"{spec.lateness_ms} milliseconds")
    return (
        marked.groupBy(*keys, F.window(F.col(ts), *spans).alias("span"))
        .agg(F.count(F.lit(1)).alias("n"), *updates(aggs))
        .select(*keys, F.col("span.start").alias("pane_start"), "n", *state_of(aggs))
    )


def windows_of_panes(
    changes: DataFrame, spec: WindowSpec, aggs: Sequence[Aggregate], keys: Sequence[str] = ()
) -> DataFrame:
    """Windows from the panes of a feed read back with its ``batch`` column: of each pane the
    newest state counts, in every window that it is part of."""
    columns = ["n", *state_of(aggs)]
    newest = (
        changes.groupBy(*keys, "pane_start").agg(F.max_by(F.struct(*columns), "batch").alias("_newest"))
        .select(*keys, "pane_start", "_newest.*").withColumn("pane", pane_of(F.unix_millis("pane_start"), spec))
    )
    inside = F.sequence(first_window_of(F.col("pane"), spec), last_window_of(F.col("pane"), spec))
    return (
        newest.withColumn("w", F.explode(inside)).groupBy(*keys, "w").agg(F.sum("n").alias("n"), *merges(aggs))
        .select(
            *keys, window_start(F.col("w"), spec).alias("window_start"), slide_end(F.col("w"), spec).alias("window_end"),
            "n", *[agg.result() for agg in aggs],
        )
    )


def start_upsert_feed(feed: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each micro-batch to ``path/batch=<id>``; a replayed batch replaces its own output."""

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        feed.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(write)
        .start()
    )


def latest(changes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The most recent row per window of an upsert feed read back with its ``batch`` column."""
    window = [*keys, "window_start", "window_end"]
    rest = [name for name in changes.columns if name not in (*window, "batch")]
    newest = changes.groupBy(*window).agg(F.max_by(F.struct(*rest), "batch").alias("_newest"))
    return newest.select(*window, "_newest.*")
