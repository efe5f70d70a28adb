"""Window results from panes: current, revised (all versions) and final."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepane.functions.aggregates import Aggregate, Fold, state_of
from tidepane.functions.slides import first_window_of, floor_div, last_window_of, slide_end, window_start
from tidepane.operators import intervals
from tidepane.operators.intervals import (
    COPY_BLOCK,
    PLACE,
    Folds,
    by_block,
    copied_over_intervals,
    merge_over_intervals,
    shuffle_partitions,
)
from tidepane.operators.panes import group_keys
from tidepane.operators.running import carry_min, null_safe, running_extreme
from tidepane.spec import WindowSpec

BOUNDS = ("first_epoch", "emit_from", "open_epoch")
# Up to this many epochs of one global stream are ordered in a single task.
ONE_TASK_EPOCHS = 1 << 16
# Slides filled in by one row of a dense result.
FILL = 4096


def stream_bounds(panes: DataFrame, spec: WindowSpec, keys: Sequence[str] = ()) -> DataFrame:
    """First and still open epoch of each stream, from its pane table."""
    return panes.groupBy(*group_keys(spec, keys)).agg(
        F.min("epoch").alias("first_epoch"),
        F.min("epoch").alias("emit_from"),
        F.max("epoch").alias("open_epoch"),
    )


def stream_epochs(panes: DataFrame, spec: WindowSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct epochs of each stream with the progress that opened them."""
    return panes.groupBy(*group_keys(spec, keys), "epoch").agg(F.min("opened_ms").alias("opened_ms"))


def match_keys(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Equi-join that also matches NULL keys, since a NULL key is a stream like any other."""
    renamed = right.withColumnsRenamed({name: f"_r_{name}" for name in names})
    return left.join(renamed, null_safe(names, "_r_"), how).drop(*[f"_r_{name}" for name in names])


def closed_in_place(versions: DataFrame, closed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``versions`` with the closing time of their ``e``, from rows that lie in the same task already:
    a join would shuffle both sides by all of its keys."""
    both = versions.unionByName(closed, allowMissingColumns=True)
    same = W.partitionBy(*PLACE, *groups, "e")
    return both.withColumn("emitted_at_ms", F.max("emitted_at_ms").over(same)).filter(F.col("w").isNotNull())


@dataclass(frozen=True)
class Bounds:
    """First epoch, first epoch to emit and open epoch: three numbers for one global stream,
    a table with a row per key otherwise."""

    table: DataFrame | None = None
    numbers: dict[str, int | None] | None = None

    @classmethod
    def of(cls, table: DataFrame, groups: Sequence[str]) -> Bounds:
        if groups:
            return cls(table=table)
        row = table.select(*BOUNDS).first()
        return cls(numbers=row.asDict() if row else dict.fromkeys(BOUNDS))

    def attach(self, df: DataFrame, groups: Sequence[str]) -> DataFrame:
        if self.table is not None:
            return match_keys(df, self.table, groups, "inner")
        return df.withColumns({k: F.lit(v).cast("long") for k, v in self.numbers.items()})

    def epochs_at_most(self, count: int) -> bool:
        """Whether the stream is known to have no more than ``count`` epochs."""
        if self.numbers is None:
            return False
        first, last = self.numbers["first_epoch"], self.numbers["open_epoch"]
        return first is None or last - first < count


def last_epoch(spec: WindowSpec) -> Column:
    """The last epoch that counts as closed."""
    return F.col("open_epoch") if spec.flush else F.col("open_epoch") - 1


def closings(
    epochs: DataFrame, bounds: Bounds, spec: WindowSpec, groups: Sequence[str], dense: bool, place: Sequence[str] = ()
) -> DataFrame:
    """When each slide was closed: ``groups, e, emitted_at_ms``, NULL for one closed by flush.

    With ``place`` each slide goes to every block with a window that it can close or revise, no
    further back than the allowed lateness; slides are shuffled as spans and listed in the block.

    A slide is closed by the first row of the next epoch that has any row, so all slides from
    one such epoch to the next share their closing time. Without ``dense`` a long gap is only
    filled as far as windows can still hold rows, one window length.
    """
    turned = epochs.withColumn("_turned", -F.col("epoch"))
    followed = running_extreme(
        turned, "_turned",
        {"_next": carry_min("epoch"), "emitted_at_ms": carry_min("opened_ms")},
        groups, inclusive=False, levels=0 if bounds.epochs_at_most(ONE_TASK_EPOCHS) else 1,
    )
    limited = bounds.attach(followed, groups).filter(F.col("epoch") <= last_epoch(spec))
    until = F.coalesce(F.col("_next") - 1, last_epoch(spec))
    if not dense:
        until = F.least(until, F.col("epoch") + spec.slides_per_window)
    since = F.greatest(F.col("epoch"), F.col("emit_from"))
    spans = limited.select(
        *groups, "emitted_at_ms", since.alias("_since"), until.alias("_until")
    ).filter(F.col("_since") <= F.col("_until"))
    if dense:
        # A gap can be long: cut it into pieces first, which other tasks can fill.
        spans = (
            spans.withColumn("_since", F.explode(F.sequence("_since", "_until", F.lit(FILL))))
            .withColumn("_until", F.least("_until", F.col("_since") + FILL - 1))
            .repartition(shuffle_partitions(epochs))
        )
    if place:
        block, reach = COPY_BLOCK * spec.slides_per_window, spec.retained_slides
        first, last = floor_div(F.col("_since") - reach, block), floor_div(F.col("_until"), block)
        spans = spans.withColumn("_block", F.explode(F.sequence(first, last)))
        at = F.col("_block") * block
        spans = by_block(spans.withColumns({
            "_since": F.greatest("_since", at), "_until": F.least("_until", at + (block - 1 + reach)),
        }), groups)
    return spans.select(
        *groups, *place, F.explode(F.sequence("_since", "_until")).alias("e"), "emitted_at_ms"
    )


def window_folds(aggs: Iterable[Aggregate]) -> Folds:
    """How the columns of a window merge: its row count and its states."""
    return {"n": Fold(F.sum), **{name: part.fold for name, (_, part) in state_of(aggs).items()}}


def fold_columns(folds: Folds) -> list[Column]:
    return [fold.grouped(F.col(name)).alias(name) for name, fold in folds.items()]


def empty_windows(closed: DataFrame, like: DataFrame, groups: Sequence[str]) -> DataFrame:
    """A row with no content for every closed slide, shaped as ``like``."""
    fixed = {"w": F.col("e"), "e": F.col("e"), "n": F.lit(0).cast("long")}
    return closed.select(*[
        F.col(field.name) if field.name in groups
        else fixed.get(field.name, F.lit(None).cast(field.dataType)).alias(field.name)
        for field in like.schema.fields
    ])


def present(
    merged: DataFrame,
    spec: WindowSpec,
    aggs: Iterable[Aggregate],
    keys: Sequence[str],
    closed: DataFrame | None,
    kind: Column | None,
    place: Sequence[str] = (),
) -> DataFrame:
    """Turn merged window state (``w``, ``e``, ``n``, state columns) into the result schema."""
    columns = [
        *keys,
        window_start(F.col("w"), spec).alias("window_start"),
        slide_end(F.col("w"), spec).alias("window_end"),
    ]
    if kind is not None:
        columns.append(slide_end(F.col("e"), spec).alias("epoch_end"))
    if closed is not None:
        if place:
            merged = closed_in_place(merged, closed, group_keys(spec, keys))
        else:
            merged = match_keys(merged, closed, [*group_keys(spec, keys), "e"], "left")
        columns.append(F.timestamp_millis("emitted_at_ms").alias("emitted_at"))
    if kind is not None:
        columns.append(kind.alias("kind"))
    return merged.select(*columns, "n", *[agg.result() for agg in aggs])


def one_version(
    panes: DataFrame,
    spec: WindowSpec,
    aggs: Sequence[Aggregate],
    keys: Sequence[str],
    since: Column,
    until: Column,
    emitted_at: bool,
    empty_until: Column,
) -> DataFrame:
    """One row per window, from the panes that count for it between ``since`` and ``until``."""
    groups, folds = group_keys(spec, keys), window_folds(aggs)
    bounds = Bounds.of(stream_bounds(panes, spec, keys), groups)
    parts = merge_over_intervals(
        bounds.attach(panes, groups), groups, since, until, spec.slides_per_window, folds, "w"
    )
    closed = None
    if emitted_at or spec.emit_empty:
        epochs = stream_epochs(panes, spec, keys)
        closed = closings(epochs, bounds, spec, groups, dense=spec.emit_empty)
    if spec.emit_empty:
        everywhere = bounds.attach(closed, groups).filter(F.col("e") <= empty_until)
        parts = parts.unionByName(empty_windows(everywhere, parts, groups))
    merged = parts.groupBy(*groups, "w").agg(*fold_columns(folds)).withColumn("e", F.col("w"))
    return present(merged, spec, aggs, keys, closed if emitted_at else None, kind=None)


def current_windows(
    panes: DataFrame,
    spec: WindowSpec,
    aggs: Sequence[Aggregate],
    keys: Sequence[str] = (),
    *,
    emitted_at: bool = True,
    lead_in_only: bool = False,
) -> DataFrame:
    """The result of each window at the moment its last slide closed.

    A pane fed in epoch ``a`` counts from window ``a`` on; what arrived later is a revision and
    needs no part in this plan. ``lead_in_only`` keeps the windows that reach back before the
    first slide of the stream.
    """
    since = F.greatest(first_window_of(F.col("pane"), spec), F.col("epoch"), F.col("first_epoch"))
    newest = last_epoch(spec)
    if lead_in_only:
        newest = F.least(newest, F.col("first_epoch") + spec.slides_per_window - 2)
    until = F.least(last_window_of(F.col("pane"), spec), newest)
    return one_version(panes, spec, aggs, keys, since, until, emitted_at, newest)


def final_windows(
    panes: DataFrame, spec: WindowSpec, aggs: Sequence[Aggregate], keys: Sequence[str] = ()
) -> DataFrame:
    """The last version of each closed window, in one aggregation without the versions between."""
    closed = F.col("epoch") <= last_epoch(spec)
    since = F.when(closed, F.greatest(first_window_of(F.col("pane"), spec), F.col("first_epoch")))
    until = F.least(last_window_of(F.col("pane"), spec), last_epoch(spec))
    return one_version(panes, spec, aggs, keys, since, until, False, last_epoch(spec))


def window_changes(
    panes: DataFrame,
    spec: WindowSpec,
    groups: Sequence[str],
    since: Column,
    until: Column,
    folds: Folds,
) -> DataFrame:
    """What each epoch ``e`` adds to each window ``w``; a pane counts from its own epoch on and
    revises the windows that were closed before. Copied windows have their ``PLACE`` and are whole:
    one row per window and epoch."""
    width = spec.slides_per_window
    if width <= intervals.COPY_WIDTH:
        copies = copied_over_intervals(panes, groups, since, until, width, "w")
        return copies.withColumn("e", F.greatest("w", "epoch")).groupBy(*groups, *PLACE, "w", "e").agg(*fold_columns(folds))
    on_time = merge_over_intervals(
        panes, groups, F.greatest(since, "epoch"), until, width, folds, "w"
    ).withColumn("e", F.col("w"))
    # Revised windows are counted back from the epoch: 0 is the one closed last.
    late = panes.withColumn("e", F.col("epoch"))
    newest = F.col("epoch") - 1
    revising = merge_over_intervals(
        late, [*groups, "e"], F.greatest(newest - until, F.lit(0)), newest - since, width, folds, "_back"
    ).withColumn("w", F.col("e") - 1 - F.col("_back")).drop("_back")
    return on_time.unionByName(revising)


def window_versions(
    panes: DataFrame,
    spec: WindowSpec,
    aggs: Sequence[Aggregate],
    keys: Sequence[str] = (),
    *,
    emitted_at: bool = True,
    bounds: DataFrame | None = None,
    epochs: DataFrame | None = None,
) -> DataFrame:
    """Every result a stream processor would emit: ``kind`` is 'current' when the window closes,
    'revised' for each later epoch in which late rows fell into it.

    The change a version makes is the merge of the panes that reached its window in that epoch;
    the version is the running merge of these changes, over the few epochs of one window.
    ``bounds`` and ``epochs`` let a streaming caller emit only what its batch has closed.
    """
    groups, folds = group_keys(spec, keys), window_folds(aggs)
    continued = bounds is not None
    bounds = Bounds.of(bounds if continued else stream_bounds(panes, spec, keys), groups)
    if epochs is None:
        epochs = stream_epochs(panes, spec, keys)
    if continued:
        folds["emit_from"] = Fold(F.max)
    closed_panes = bounds.attach(panes, groups).filter(
        (F.col("epoch") <= last_epoch(spec)) & (F.col("emit_from") <= last_epoch(spec))
    )
    # Windows further back than the allowed lateness cannot change in the epochs to be emitted.
    oldest = F.greatest(F.col("first_epoch"), F.col("emit_from") - spec.retained_slides)
    since = F.greatest(first_window_of(F.col("pane"), spec), oldest)
    until = F.least(last_window_of(F.col("pane"), spec), last_epoch(spec))
    changes = window_changes(closed_panes, spec, groups, since, until, folds)
    # Copied windows that get closing times stay in the task of their block; others come together by window.
    place = PLACE if emitted_at and spec.slides_per_window <= intervals.COPY_WIDTH and not spec.emit_empty else []
    closed = None
    if emitted_at or spec.emit_empty:
        closed = closings(epochs, bounds, spec, groups, dense=spec.emit_empty, place=place)
    if place:
        merged = changes
    else:
        changes = changes.drop(*PLACE)
        if spec.emit_empty:
            changes = changes.unionByName(empty_windows(closed, changes, groups))
        # Grouping and running merge both work inside a (key, window), so one shuffle serves both.
        merged = (
            changes.repartition(shuffle_partitions(panes), *groups, "w")
            .groupBy(*groups, "w", "e")
            .agg(*fold_columns(folds))
        )
    so_far = W.partitionBy(*groups, *place, "w").orderBy("e").rowsBetween(W.unboundedPreceding, 0)
    versions = merged.withColumns({
        name: fold.over(F.col(name), so_far) for name, fold in folds.items()
    })
    if continued:
        versions = versions.filter(
            F.col("emit_from").isNull() | (F.col("e") >= F.col("emit_from"))
        )
    kind = F.when(F.col("e") == F.col("w"), F.lit("current")).otherwise(F.lit("revised"))
    return present(versions, spec, aggs, keys, closed if emitted_at else None, kind, place)
