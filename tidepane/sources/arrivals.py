"""The typed input of every operator: keys, arrival order, event time and value columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.functions.slides import epoch_millis

SEQ = "seq"
TS = "ts_ms"


def arrivals(
    df: DataFrame,
    *,
    seq: str = "seq",
    ts: str = "ts",
    values: str | dict[str, str | Column] = "value",
    keys: Sequence[str] = (),
    nulls: str = "raise",
) -> DataFrame:
    """Select ``keys, seq BIGINT, ts_ms BIGINT, value columns`` from any event table.

    ``seq`` is the arrival order and must be unique per key (a Kafka offset, an event id, ...).
    Only the named columns are read, so the projection reaches the file scan. A row without order
    or time fails the query; with ``nulls='reject'`` such rows are left out, and
    :func:`rejected` lists them.
    """
    if nulls not in ("raise", "reject"):
        raise ValueError("nulls must be 'raise' or 'reject'")
    if isinstance(values, str):
        values = {"value": values}
    order, time = F.col(seq).cast("long"), epoch_millis(df, ts)
    if nulls == "reject":
        df = df.where(order.isNotNull() & time.isNotNull())
    else:
        order, time = _present(order, seq), _present(time, ts)
    return df.select(
        *keys,
        order.alias(SEQ),
        time.alias(TS),
        *[(F.col(v) if isinstance(v, str) else v).alias(name) for name, v in values.items()],
    )


def _present(value: Column, name: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"{name} is NULL; see nulls='reject'")).cast("long"))


def rejected(df: DataFrame, *, seq: str = "seq", ts: str = "ts") -> DataFrame:
    """The rows that ``nulls='reject'`` leaves out, with all columns and the ``reason``."""
    no_order = F.col(seq).cast("long").isNull()
    reason = F.when(no_order, F.lit("no order")).when(epoch_millis(df, ts).isNull(), F.lit("no time"))
    return df.withColumn("reason", reason).where("reason IS NOT NULL")
