"""Text streams of ``timestamp,value`` lines: reading, arrival numbering and parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepane.sources.arrivals import arrivals
from tidepane.sources.shared import stage

# The two timestamp forms of an input line.
EPOCH_MS = "epoch_ms"
DOCUMENTED_PATTERN = "yyyy.M.d HH:mm:ss"


# How files follow each other, within a batch read or a micro-batch.
FILE_ORDER = {"time": ["file_modification_time", "file_path"], "path": ["file_path"]}
SPLIT = "split"


def _split(file_order: str) -> Column:
    """The part of a file that a line was read from; parts compare in the order of their lines."""
    names = [*FILE_ORDER[file_order], "file_block_start"]
    return F.struct(*[F.col(f"_metadata.{name}").alias(name) for name in names]).alias(SPLIT)


def read_lines(
    spark: SparkSession,
    source: str = "text",
    *,
    streaming: bool = True,
    file_order: str = "time",
    **options: str,
) -> DataFrame:
    """Lines as ``value STRING`` (plus ``seq`` where the source knows the arrival order, and
    ``split`` in a text stream, from which :func:`line_arrivals` makes arrival numbers).

    ``text`` takes ``path``; ``socket`` takes ``host`` and ``port`` (streaming only); ``kafka``
    takes its usual options and uses the record offset as ``seq``, which orders one partition; the
    columns ``stamp_ms, partition, offset`` give several partitions one order (see
    :func:`tidepane.operators.numbering.partition_arrivals`).
    Batch text files are numbered by line, file after file in ``file_order``: modification
    ``time`` (as a file stream takes them) or ``path``.
    """
    if source == "socket" and not streaming:
        raise ValueError("the socket source only exists as a stream")
    reader = (spark.readStream if streaming else spark.read).format(source)
    lines = reader.options(**options).load()
    if source == "kafka":
        return lines.select(
            F.col("offset").alias("seq"), "partition", "offset", F.unix_millis("timestamp").alias("stamp_ms"),
            F.col("value").cast("string"),
        )
    if source != "text":
        return lines.select("value")
    placed = lines.select("value", _split(file_order))
    return placed if streaming else number_lines(placed)


def number_lines(lines: DataFrame) -> DataFrame:
    """``seq, value``: the line number over all files, from ``value, split``.

    Lines are counted per split; split offsets are prefix sums over the split table, which has one
    row per split of the input, and are joined back (lines only move if that table is beyond the
    broadcast threshold). Within a split, Spark's own increasing id gives the position.
    """
    numbered = lines.withColumn("_id", F.monotonically_increasing_id())
    return _numbered(numbered, _offsets(numbered))


def _offsets(numbered: DataFrame) -> DataFrame:
    counts = numbered.groupBy(SPLIT).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = W.orderBy(SPLIT).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def _numbered(numbered: DataFrame, offsets: DataFrame, first: int = 0) -> DataFrame:
    number = F.col("_offset") + F.col("_id") - F.col("_first") + first
    return numbered.join(offsets, SPLIT).select(number.alias("seq"), "value")


def line_arrivals(
    ts_format: str = EPOCH_MS, mode: str = "failfast", values: str | dict[str, str | Column] = "value"
) -> Callable[[DataFrame, int, DataFrame | None], tuple[DataFrame, int, None]]:
    """How a stream of lines becomes arrivals, batch by batch (``prepare`` of an exact stream).

    Lines are numbered on from the last batch by split and place within it, before lines that
    cannot be read are left out or refused.
    """

    def prepare(lines: DataFrame, first: int, held: DataFrame | None) -> tuple[DataFrame, int, None]:
        numbered = lines.select("value", SPLIT).withColumn("_id", F.monotonically_increasing_id())
        offsets = stage(_offsets(numbered), "line-offsets")
        count = offsets.agg(F.sum("_n")).first()[0] or 0
        parsed = parse_lines(_numbered(numbered, offsets, first), ts_format, mode)
        return arrivals(parsed, values=values), first + count, None

    return prepare


def parse_lines(
    lines: DataFrame, ts_format: str = EPOCH_MS, mode: str = "failfast", column: str = "value"
) -> DataFrame:
    """Split ``timestamp,value`` into ``ts TIMESTAMP, value DOUBLE``; other columns are kept.

    ``ts_format`` is ``'epoch_ms'`` or a Spark datetime pattern such as ``yyyy.M.d HH:mm:ss``.
    ``mode='failfast'`` raises on a malformed line, ``mode='drop'`` leaves it out.
    """
    if mode not in ("failfast", "drop"):
        raise ValueError("mode must be 'failfast' or 'drop'")
    cells = F.split(F.col(column), ",")
    raw_ts, raw_value = F.trim(F.get(cells, F.lit(0))), F.trim(F.get(cells, F.lit(1)))
    if ts_format == EPOCH_MS:
        ts = F.timestamp_millis(raw_ts.try_cast("bigint"))
    else:
        ts = F.try_to_timestamp(raw_ts, F.lit(ts_format))
    value = raw_value.try_cast("double")
    rest = [name for name in lines.columns if name != column]
    parsed = lines.select(*rest, F.col(column).alias("_line"), ts.alias("ts"), value.alias("value"))
    good = F.col("ts").isNotNull() & F.col("value").isNotNull()
    if mode == "drop":
        return parsed.filter(good).drop("_line")
    broken = F.raise_error(F.concat(F.lit("malformed line: "), F.coalesce("_line", F.lit("NULL"))))
    return parsed.select(
        *rest,
        F.when(good, F.col("ts")).otherwise(broken.cast("timestamp")).alias("ts"),
        F.when(good, F.col("value")).otherwise(broken.cast("double")).alias("value"),
    )
