"""Pane partials: accepted rows reduced to one row per (key, pane, epoch)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.functions.aggregates import Aggregate, merges, updates
from tidepane.functions.slides import ORIGIN, pane_of
from tidepane.sources.arrivals import TS
from tidepane.spec import WindowSpec


def group_keys(spec: WindowSpec, keys: Sequence[str]) -> list[str]:
    """The columns that identify one stream; a data-dependent origin travels with its key."""
    return [*keys, ORIGIN] if spec.origin_from_data else list(keys)


def merge_columns(aggs: Iterable[Aggregate]) -> list[Column]:
    """Merge of every state column of a pane table, including its bookkeeping columns."""
    return [
        F.sum("n").alias("n"),
        F.min("opened_ms").alias("opened_ms"),
        F.max("reached_ms").alias("reached_ms"),
        *merges(aggs),
    ]


def build_panes(
    kept: DataFrame, spec: WindowSpec, aggs: Iterable[Aggregate], keys: Sequence[str] = ()
) -> DataFrame:
    """Aggregate accepted rows per pane and arrival epoch.

    This is where the row count collapses: the hash aggregate combines map-side, so what is
    shuffled is at most (panes x epochs a pane is fed in) per task, also for a hot key.
    ``opened_ms`` and ``reached_ms`` are the least and greatest progress seen by the rows.
    """
    return (
        kept.withColumn("pane", pane_of(F.col(TS), spec))
        .groupBy(*group_keys(spec, keys), "pane", "epoch")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("progress_ms").alias("opened_ms"),
            F.max("progress_ms").alias("reached_ms"),
            *updates(aggs),
        )
    )
