"""Running extremes over an ordered column, for streams too long for one ordered partition."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepane.sources.shared import stage

BUCKET_BITS = 16
LEVELS = 2
# A key with more rows than this is cut into buckets; others are ordered as a whole in one task.
HOT_ROWS = 1 << 20
# The largest number of hot keys that is broadcast.
HOT_KEYS = 100_000
# With a larger share of rows in hot keys than this, all keys are cut.
MOSTLY_HOT = 0.9
# Order values are sparse if they span more than this many times the number of rows.
SPARSE = 4
# Most buckets of sparse order values; the table above them is ordered in one task.
MOST_CUTS = 1 << 13


@dataclass(frozen=True)
class Carry:
    """What is carried along the order: how a bucket folds it and how a window continues it."""

    column: str
    fold: Callable[[Column, Column], Column]
    over: Callable[[Column], Column]


def carry_max(column: str) -> Carry:
    return Carry(column, lambda value, order: F.max(value), F.max)


def carry_min(column: str) -> Carry:
    return Carry(column, lambda value, order: F.min(value), F.min)


def carry_first(column: str) -> Carry:
    return Carry(column, F.min_by, lambda value: F.first(value, ignorenulls=True))


def null_safe(names: Sequence[str], prefix: str) -> Column:
    """Equality of all ``names`` with their prefixed copies; NULL equals NULL."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(prefix + name))
    return condition


def mark_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_hot``; the caller has checked that ``hot`` is small enough to broadcast."""
    listed = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot"))
    return df.join(F.broadcast(listed), null_safe(keys, "_h_"), "left").drop(
        *[f"_h_{k}" for k in keys]
    )


def find_hot_keys(
    rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS
) -> tuple[int, DataFrame | None]:
    """Levels of buckets a keyed stream needs, and which keys to cut (None: all of them).

    Keys are counted exactly, with map-side combine. No hot key: no buckets. Hot keys beside many
    others: only those are cut. Hardly any other rows, or more hot keys than can be broadcast:
    every key is, which spares the look-up.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    is_hot = F.col("_rows") > hot_rows
    seen = Observation()
    counted = counts.observe(
        seen,
        F.sum("_rows").alias("rows"),
        F.sum(F.when(is_hot, F.col("_rows"))).alias("hot_rows"),
        F.sum(F.when(is_hot, 1)).alias("hot_keys"),
    )
    hot = stage(counted.filter(is_hot).select(*keys), "hot-keys")
    found = seen.get
    if not found["hot_keys"]:
        return 0, None
    cut_all = found["hot_keys"] > hot_keys or found["hot_rows"] > MOSTLY_HOT * found["rows"]
    return LEVELS, None if cut_all else hot


def find_cuts(
    rows: DataFrame, order: str, bits: int = BUCKET_BITS, most: int = MOST_CUTS
) -> list[float] | None:
    """Borders between buckets of about ``2**bits`` rows if the values of ``order`` are sparse, None
    if equal ranges of them will do.

    The borders are quantiles, as a range partitioning would sample them, so buckets are even
    however the values are spread: ids with a time in their upper bits, offsets with gaps, a
    few values far out.
    """
    seen = rows.agg(F.count(order).alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).first()
    if not seen["n"] or seen["high"] - seen["low"] < SPARSE * seen["n"]:
        return None
    buckets = min(most, -(-seen["n"] // (1 << bits)))
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return []
    found = rows.agg(F.percentile_approx(order, shares, 10 * buckets).alias("cuts")).first()["cuts"]
    # Compared as doubles, as the bucketing does; equal ones make one border.
    return sorted({float(cut) for cut in found})


def in_buckets(df: DataFrame, name: str, order: str, bits: int, cuts: list[float] | None) -> DataFrame:
    """Add ``name``, a bucket number that follows ``order``: equal ranges, or borders at ``cuts``."""
    if cuts is None:
        return df.withColumn(name, F.shiftright(F.col(order), bits))
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("long"))
    # A long keeps its place among others when it becomes a double, so buckets follow the order; at
    # most 1024 neighbouring values become the same one.
    placed = df.withColumn("_place", F.col(order).cast("double"))
    borders = [-float("inf"), *cuts, float("inf")]
    found = Bucketizer(splits=borders, inputCol="_place", outputCol=name, handleInvalid="keep").transform(placed)
    return found.withColumn(name, F.col(name).cast("long")).drop("_place")


def running_extreme(
    df: DataFrame,
    order: str,
    carries: dict[str, Carry],
    keys: Sequence[str] = (),
    *,
    inclusive: bool = True,
    seeds: DataFrame | None = None,
    bits: int = BUCKET_BITS,
    levels: int = LEVELS,
    hot: DataFrame | None = None,
    cuts: list[float] | None = None,
) -> DataFrame:
    """Add ``out``, the carried value over all rows of the key up to this one, per carry.

    ``order`` is BIGINT, not null and unique per key. ``inclusive=False`` leaves the row itself
    out. ``seeds`` has ``keys`` and the carried columns and stands before the first row of its key.

    A plain window would put a whole key, or without keys the whole stream, into one task. Here
    rows are cut into buckets of ``2**bits`` consecutive order values, so no task has to sort a
    larger group (values should be dense, or ``cuts`` given). What is carried into a bucket comes from the same function applied to the
    bucket table, one level up, and enters as a marker row that sorts first. Rows are shuffled and
    sorted once; ``levels`` bounds the topmost table. With ``hot`` only those keys are cut.
    ``cuts`` (see :func:`find_cuts`) are borders of buckets in place of equal ranges; their number
    bounds the table above, so one level is enough.
    """
    if cuts is not None:
        levels = min(levels, 1) if cuts else 0
    columns = list(dict.fromkeys(carry.column for carry in carries.values()))
    if seeds is not None:
        seeds = seeds.select(*keys, *columns)
    if levels == 0:
        group, helpers = list(keys), []
        rows = df if seeds is None else df.unionByName(seeds, allowMissingColumns=True)
    else:
        bucket = f"_bucket{levels}"
        group, helpers = [*keys, bucket], [bucket]
        df = in_buckets(df, bucket, order, bits, cuts)
        cut, cut_seeds, whole_seeds = df, seeds, None
        if hot is not None:
            df = mark_hot(df, hot, keys)
            cut = df.filter("_hot")
            df = df.withColumn(bucket, F.when(F.col("_hot"), F.col(bucket)))
            helpers.append("_hot")
            if seeds is not None:
                marked = mark_hot(seeds, hot, keys)
                cut_seeds, whole_seeds = marked.filter("_hot"), marked.filter("_hot IS NULL")
        folded = cut.groupBy(*group).agg(
            *[c.fold(F.col(c.column), F.col(order)).alias(c.column) for c in carries.values()]
        )
        before = running_extreme(
            folded, bucket, carries, keys,
            inclusive=False, seeds=cut_seeds, bits=bits, levels=levels - 1,
        )
        markers = before.select(
            *group, *[F.col(out).alias(carry.column) for out, carry in carries.items()]
        )
        rows = df.unionByName(markers, allowMissingColumns=True)
        if whole_seeds is not None:
            rows = rows.unionByName(whole_seeds, allowMissingColumns=True)
    frame = (
        W.partitionBy(*group)
        .orderBy(F.col(order).asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        rows.withColumns({out: c.over(F.col(c.column)).over(frame) for out, c in carries.items()})
        .filter(F.col(order).isNotNull())
        .drop(*helpers)
    )
