"""Merging states that each cover an interval of positions, in constant work per state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepane.functions.aggregates import Fold
from tidepane.functions.slides import floor_div

Folds = dict[str, Fold]

# Up to this width a state is simply copied to its positions: sorting would cost more.
COPY_WIDTH = 256
# Width of a block of neighbouring positions when copying, in interval widths.
COPY_BLOCK = 4
# What says where a copy is: the hash that deals out groups and blocks, and the block.
PLACE = ["_part", "_block"]


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_block(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """All rows of a group and ``_block`` in one task, dealt by ``_part``: it is never null, so grouping
    and joins that have it among their keys need no further shuffle."""
    return df.withColumn(PLACE[0], F.xxhash64(*groups, "_block")).repartition(shuffle_partitions(df), PLACE[0])


def copied_over_intervals(
    df: DataFrame, groups: Sequence[str], since: Column, until: Column, width: int, position: str
) -> DataFrame:
    """One row of ``df`` per position it covers, with the ``_part`` and ``_block`` it was copied in.

    Intervals are cut at the borders of blocks and brought together by block before they are copied,
    so one row per state (two at a border) is shuffled, and all copies of a position are in one task.
    """
    block = COPY_BLOCK * width
    kept = df.withColumns({"_from": since, "_to": until}).filter(F.col("_from") <= F.col("_to"))
    kept = kept.withColumn("_block", F.explode(F.sequence(floor_div(F.col("_from"), block), floor_div(F.col("_to"), block))))
    at = F.col("_block") * block
    cut = kept.withColumns({"_from": F.greatest("_from", at), "_to": F.least("_to", at + block - 1)})
    return by_block(cut, groups).withColumn(position, F.explode(F.sequence("_from", "_to")))


def merge_over_intervals(
    df: DataFrame,
    groups: Sequence[str],
    since: Column,
    until: Column,
    width: int,
    folds: Folds,
    position: str,
) -> DataFrame:
    """Rows ``groups, position, *folds`` whose fold by ``groups, position`` is the merge of all
    rows of ``df`` with ``since <= position <= until``; no interval is longer than ``width``.

    Copying each row to all its positions costs ``width`` rows per row, which is only done for
    small widths. Otherwise positions are cut into blocks of ``width``, so an interval reaches over at most one block border:
    up to the end of its first block and from the start of its last one. Sorted by where they
    begin (or, backwards, by where they stop), the states of one block and side accumulate, and
    each running merge holds until the next one begins. That is two rows per input row and at most
    two per position, whatever the width. Only intervals strictly inside a block, those cut
    short by lateness or the ends of the stream, are copied to their positions.
    """
    if width <= COPY_WIDTH:
        copies = copied_over_intervals(df, groups, since, until, width, position)
        return copies.select(*groups, *folds, position)
    placed = df.select(*groups, *folds, since.alias("_from"), until.alias("_to")).filter(
        F.col("_from") <= F.col("_to")
    )
    start, stop = F.col("_from"), F.col("_to")
    first, last = floor_div(start, width), floor_div(stop, width)
    starts_block = F.pmod(start, F.lit(width)) == 0
    ends_block = F.pmod(stop + 1, F.lit(width)) == 0
    inside = (first == last) & ~starts_block & ~ends_block

    def piece(side: int, block: Column, at: Column) -> Column:
        return F.struct(F.lit(side).alias("_side"), block.alias("_block"), at.alias("_at"))

    forward, backward = piece(1, first, start), piece(-1, last, -stop)
    pieces = (
        F.when(first != last, F.array(forward, backward))
        .when(starts_block, F.array(backward))
        .otherwise(F.array(forward))
    )
    cut = (
        placed.filter(~inside)
        .select(*groups, *folds, F.explode(pieces).alias("_piece"))
        .select(*groups, *folds, "_piece.*")
        .repartition(shuffle_partitions(df), *groups, "_block")
    )
    side = [*groups, "_block", "_side"]
    steps = cut.groupBy(*side, "_at").agg(
        *[fold.grouped(F.col(c)).alias(c) for c, fold in folds.items()]
    )
    order = W.partitionBy(*side).orderBy("_at")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    block_end = F.when(F.col("_side") == 1, (F.col("_block") + 1) * width - 1).otherwise(
        -F.col("_block") * width
    )
    held = steps.withColumns({
        "_upto": F.coalesce(F.lead("_at").over(order) - 1, block_end),
        **{c: fold.over(F.col(c), so_far) for c, fold in folds.items()},
    })
    accumulated = held.withColumn("_x", F.explode(F.sequence("_at", "_upto"))).select(
        *groups, *folds, (F.col("_side") * F.col("_x")).alias(position)
    )
    short = placed.filter(inside).select(
        *groups, *folds, F.explode(F.sequence("_from", "_to")).alias(position)
    )
    return accumulated.unionByName(short)
