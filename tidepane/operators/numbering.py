"""One arrival order over several ordered partitions, such as those of a Kafka topic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepane.operators.running import BUCKET_BITS, find_cuts, in_buckets
from tidepane.sources.arrivals import SEQ, arrivals
from tidepane.sources.shared import stage

# Columns of a record: when it came to its partition, which partition, and where in it.
STAMP, PARTITION, OFFSET = "stamp_ms", "partition", "offset"


def number_in_order(
    rows: DataFrame, order: Sequence[str], first: int = 0, bits: int = BUCKET_BITS
) -> DataFrame:
    """Add ``seq``: numbers without gaps from ``first`` on, in the order of all columns ``order``,
    the first of which is BIGINT.

    Rows are cut into buckets by the first column (quantiles where its values are sparse), sorted
    within them, and counted on from the rows of the buckets before, which one task adds up over the
    table of buckets. Rows with equal first columns are sorted in one task, which spills.
    """
    placed = in_buckets(rows, "_bucket", order[0], bits, find_cuts(rows, order[0], bits))
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_bucket", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + first).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    return (
        placed.withColumn("_inside", inside).join(offsets, "_bucket")
        .withColumn(SEQ, F.col("_before") + F.col("_inside") - 1).drop("_bucket", "_inside", "_before")
    )


def complete_until(rows: DataFrame, partitions: int) -> int | None:
    """The stamp below which every partition has delivered all it has; None while one is missing.

    Stamps do not fall within a partition, so the partition that is furthest behind decides.
    """
    last = rows.groupBy(PARTITION).agg(F.max(STAMP).alias("last"))
    seen = last.agg(F.count(F.lit(1)).alias("n"), F.min("last").alias("until")).first()
    return seen["until"] if seen["n"] >= partitions else None


def partition_arrivals(
    partitions: int,
    *,
    ts: str = "ts",
    values: str | dict[str, str | Column] = "value",
    keys: Sequence[str] = (),
    parse: Callable[[DataFrame], DataFrame] | None = None,
) -> Callable[[DataFrame, int, DataFrame | None], tuple[DataFrame, int, DataFrame]]:
    """How records of several partitions become arrivals, batch by batch (``prepare`` of an exact stream).

    Records have ``stamp_ms`` (when they came to their partition, not falling within it),
    ``partition`` and ``offset``; arrivals follow each other by these three. A record is held back
    until every one of the ``partitions`` has gone beyond its stamp, so no record of a slower
    partition can still come before it. The newest record of each partition is always held back, and
    a partition that stays silent holds back all others. ``parse`` may add event time and values.
    """

    def prepare(rows: DataFrame, first: int, held: DataFrame | None) -> tuple[DataFrame, int, DataFrame]:
        known = stage(rows if held is None else held.unionByName(rows), "records")
        until = complete_until(known, partitions)
        ready = known.where(F.lit(False) if until is None else F.col(STAMP) < until)
        count = ready.count()
        numbered = number_in_order(ready, [STAMP, PARTITION, OFFSET], first)
        shaped = arrivals(parse(numbered) if parse else numbered, ts=ts, values=values, keys=keys)
        return shaped, first + count, known.where(F.lit(True) if until is None else F.col(STAMP) >= until)

    return prepare
