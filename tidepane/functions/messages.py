"""Result rows as the two text messages of the query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The message texts.
CURRENT_TEXT = ("At time: ", ", Aggregating results: ")
REVISED_TEXT = ("Past Result of the affected window computed at: ", ", Updated result: ")


def time_text(ts: Column, ts_format: str) -> Column:
    if ts_format == "epoch_ms":
        return F.unix_millis(ts).cast("string")
    return F.date_format(ts, ts_format)


def message_text(texts: tuple[str, str], ts: str, result: str, ts_format: str) -> Column:
    shown = F.coalesce(F.col(result).cast("string"), F.lit("NULL"))
    return F.concat(F.lit(texts[0]), time_text(F.col(ts), ts_format), F.lit(texts[1]), shown)


def message(df: DataFrame, texts: tuple[str, str], ts: str, result: str, ts_format: str) -> DataFrame:
    return df.select(message_text(texts, ts, result, ts_format).alias("value"))


def format_current(results: DataFrame, result: str, ts_format: str = "epoch_ms") -> DataFrame:
    """One line per current result, stamped with the event time that closed the window
    (its end, if it was closed by ``flush``)."""
    if "kind" in results.columns:
        results = results.filter("kind = 'current'")
    stamped = results.withColumn("_at", F.coalesce("emitted_at", "window_end"))
    return message(stamped, CURRENT_TEXT, "_at", result, ts_format)


def format_revision(versions: DataFrame, result: str, ts_format: str = "epoch_ms") -> DataFrame:
    """One line per revised past window, stamped with the end of that window."""
    return message(
        versions.filter("kind = 'revised'"), REVISED_TEXT, "window_end", result, ts_format
    )


def result_messages(versions: DataFrame, result: str, ts_format: str = "epoch_ms", keys: Sequence[str] = ()) -> DataFrame:
    """Current and past results as messages in the order of a running query: ``keys, emitted_at,
    value``, range-partitioned and sorted by the time that closed the slide; the current result comes
    before the past ones it revises, older windows first."""
    current = F.col("kind") == "current"
    text = F.when(current, message_text(CURRENT_TEXT, "emitted_at", result, ts_format)).otherwise(
        message_text(REVISED_TEXT, "window_end", result, ts_format)
    )
    ordered = versions.orderBy("emitted_at", *keys, "epoch_end", ~current, "window_end")
    return ordered.select(*keys, "emitted_at", text.alias("value"))
