"""tidepane: sliding-window aggregation over out-of-order event streams on Spark."""

from tidepane.functions.aggregates import (
    AVG,
    COUNT,
    EXACT_STD,
    GEOMEAN,
    MAX,
    MIN,
    PRODUCT,
    RANGE,
    STD,
    SUM,
    SUMSQ,
    Aggregate,
    Partial,
)
from tidepane.plans.sliding import (
    sliding_current,
    sliding_final,
    sliding_panes,
    sliding_revised,
    sliding_versions,
)
from tidepane.spec import WindowSpec

__all__ = [
    "AVG", "COUNT", "EXACT_STD", "GEOMEAN", "MAX", "MIN", "PRODUCT", "RANGE", "STD", "SUM", "SUMSQ",
    "Aggregate", "Partial", "WindowSpec",
    "sliding_current", "sliding_final", "sliding_panes", "sliding_revised", "sliding_versions",
]
