"""End-to-end batch queries: arrivals -> progress -> lateness filter -> panes -> windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidepane.functions.aggregates import Aggregate
from tidepane.operators.panes import build_panes
from tidepane.operators.progress import accepted, with_progress
from tidepane.operators.windows import current_windows, final_windows, window_versions
from tidepane.sources.shared import stage
from tidepane.spec import WindowSpec


def sliding_panes(
    rows: DataFrame,
    spec: WindowSpec,
    aggs: Sequence[Aggregate],
    keys: Sequence[str] = (),
    *,
    staged: bool = True,
    **progress_options,
) -> DataFrame:
    """The pane table of ``rows`` (see :func:`tidepane.sources.arrivals`).

    Window plans read panes more than once (windows, bounds, closing times). The table is as
    small as the event-time axis is long in slides, so it is written once to the shared folder
    instead of scanning and ordering the input again for each use.
    """
    kept = accepted(with_progress(rows, spec, keys, **progress_options), spec)
    panes = build_panes(kept, spec, aggs, keys)
    return stage(panes, "panes") if staged else panes


def sliding_current(
    rows: DataFrame, spec: WindowSpec, aggs: Sequence[Aggregate], keys: Sequence[str] = (), **options
) -> DataFrame:
    """One row per closed window: the result when the window closed."""
    return current_windows(sliding_panes(rows, spec, aggs, keys), spec, aggs, keys, **options)


def sliding_versions(
    rows: DataFrame, spec: WindowSpec, aggs: Sequence[Aggregate], keys: Sequence[str] = (), **options
) -> DataFrame:
    """Current results and all revisions by late rows."""
    return window_versions(sliding_panes(rows, spec, aggs, keys), spec, aggs, keys, **options)


def sliding_revised(
    rows: DataFrame, spec: WindowSpec, aggs: Sequence[Aggregate], keys: Sequence[str] = (), **options
) -> DataFrame:
    """Only the revisions: updated results of past windows."""
    return sliding_versions(rows, spec, aggs, keys, **options).filter("kind = 'revised'")


def sliding_final(
    rows: DataFrame, spec: WindowSpec, aggs: Sequence[Aggregate], keys: Sequence[str] = ()
) -> DataFrame:
    """The last version of each closed window."""
    return final_windows(sliding_panes(rows, spec, aggs, keys), spec, aggs, keys)
