"""Mergeable aggregates: partial state per pane, merge across panes, finish per window.

Every part is a Column function, so a user-defined aggregate runs as the built-in ones do.
``update`` and ``merge`` must be commutative and associative because rows arrive out of order.
State columns are either independent of each other, each merged by an aggregate function, or one
struct that is merged as a whole, two states at a time (:meth:`Partial.joint`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import WindowSpec as Frame


@dataclass(frozen=True)
class Fold:
    """How states become one: an aggregate function, and what is made of its result."""

    gather: Callable[[Column], Column]
    join: Callable[[Column], Column] | None = None

    def grouped(self, state: Column) -> Column:
        return self._joined(self.gather(state))

    def over(self, state: Column, frame: Frame) -> Column:
        return self._joined(self.gather(state).over(frame))

    def _joined(self, gathered: Column) -> Column:
        return gathered if self.join is None else self.join(gathered)


@dataclass(frozen=True)
class Partial:
    """One column of partial state. ``update`` folds input values, ``merge`` folds partials."""

    kind: str
    update: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    join: Callable[[Column], Column] | None = None

    @classmethod
    def joint(
        cls, kind: str, update: Callable[[Column], Column], merge_two: Callable[[Column, Column], Column]
    ) -> Partial:
        """A struct of values that only make sense together, merged by ``merge_two(state, state)``.

        The states of a group are gathered and merged one after the other; a group has as many as
        a window has panes and epochs, whatever the number of rows. They are sorted first, so that
        rounding does not depend on the order in which tasks end.
        """

        def join(states: Column) -> Column:
            ordered = F.array_sort(states)
            rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
            return F.when(F.size(ordered) > 0, F.aggregate(rest, F.get(ordered, F.lit(0)), merge_two))

        return cls(kind, update, F.collect_list, join)

    @property
    def fold(self) -> Fold:
        return Fold(self.merge, self.join)


@dataclass(frozen=True)
class Aggregate:
    """A named result: its partials and how to finish them (one argument per partial)."""

    name: str
    partials: tuple[Partial, ...]
    finish: Callable[..., Column]
    column: str = "value"

    def on(self, column: str) -> Aggregate:
        return replace(self, column=column)

    def named(self, name: str) -> Aggregate:
        return replace(self, name=name)

    def state_columns(self) -> list[str]:
        return [f"{self.column}__{part.kind}" for part in self.partials]

    def result(self) -> Column:
        return self.finish(*[F.col(name) for name in self.state_columns()]).alias(self.name)


def state_of(aggs: Iterable[Aggregate]) -> dict[str, tuple[str, Partial]]:
    """State column -> (input column, partial); aggregates that need the same partial share it."""
    state: dict[str, tuple[str, Partial]] = {}
    for agg in aggs:
        for name, part in zip(agg.state_columns(), agg.partials):
            state.setdefault(name, (agg.column, part))
    return state


def updates(aggs: Iterable[Aggregate]) -> list[Column]:
    return [part.update(F.col(column)).alias(name) for name, (column, part) in state_of(aggs).items()]


def merges(aggs: Iterable[Aggregate]) -> list[Column]:
    return [part.fold.grouped(F.col(name)).alias(name) for name, (_, part) in state_of(aggs).items()]


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


def mean(count: Column, total: Column) -> Column:
    return F.when(count > 0, total.cast("double") / count)


def moments(value: Column) -> Column:
    """Count, mean and summed squares of the distances from the mean."""
    value = value.cast("double")
    count, zero = F.count(value), F.lit(0.0)
    return F.struct(
        count.alias("n"), F.coalesce(F.avg(value), zero).alias("mean"),
        F.coalesce(F.var_pop(value) * count, zero).alias("squares"),
    )


def merge_moments(a: Column, b: Column) -> Column:
    """Means are compared, never squared, so nothing cancels however far from zero values lie."""
    n = a["n"] + b["n"]
    share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
    apart = b["mean"] - a["mean"]
    # A state without values has no mean to compare.
    mean = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + apart * share)
    between = F.when((a["n"] > 0) & (b["n"] > 0), apart * apart * a["n"] * share).otherwise(F.lit(0.0))
    return F.struct(n.alias("n"), mean.alias("mean"), (a["squares"] + b["squares"] + between).alias("squares"))


def population_std(count: Column, total: Column, squares: Column) -> Column:
    average = total.cast("double") / count
    variance = squares.cast("double") / count - average * average
    return F.when(count > 0, F.sqrt(F.greatest(variance, F.lit(0.0))))


COUNT_STATE = Partial("count", F.count, F.sum)
SUM_STATE = Partial("sum", F.sum, F.sum)
SUMSQ_STATE = Partial("sumsq", lambda v: F.sum(v * v), F.sum)
MIN_STATE = Partial("min", F.min, F.min)
MAX_STATE = Partial("max", F.max, F.max)
PRODUCT_STATE = Partial("product", F.product, F.product)
POSITIVES_STATE = Partial("positives", lambda v: F.count(positive(v)), F.sum)
MOMENTS_STATE = Partial.joint("moments", moments, merge_moments)
LOGSUM_STATE = Partial("logsum", lambda v: F.sum(F.ln(positive(v).cast("double"))), F.sum)

COUNT = Aggregate("count", (COUNT_STATE,), lambda n: F.coalesce(n, F.lit(0).cast("long")))
SUM = Aggregate("sum", (SUM_STATE,), lambda s: s)
SUMSQ = Aggregate("sumsq", (SUMSQ_STATE,), lambda q: q)
MIN = Aggregate("min", (MIN_STATE,), lambda lo: lo)
MAX = Aggregate("max", (MAX_STATE,), lambda hi: hi)
PRODUCT = Aggregate("product", (PRODUCT_STATE,), lambda p: p)
AVG = Aggregate("avg", (COUNT_STATE, SUM_STATE), mean)
STD = Aggregate("std", (MOMENTS_STATE,), lambda m: F.when(m["n"] > 0, F.sqrt(m["squares"] / m["n"])))
# For integers and decimals: sums without rounding, independent of each other and of their order.
EXACT_STD = Aggregate("std", (COUNT_STATE, SUM_STATE, SUMSQ_STATE), population_std)
RANGE = Aggregate("range", (MIN_STATE, MAX_STATE), lambda lo, hi: hi - lo)
GEOMEAN = Aggregate(
    "geomean", (POSITIVES_STATE, LOGSUM_STATE), lambda n, logs: F.when(n > 0, F.exp(logs / n))
)
