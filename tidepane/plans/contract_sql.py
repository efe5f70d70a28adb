"""The query contract as plain SQL over the ``events`` table, row by row and without panes.

These are the statements the Spark results are compared with. They follow the definition of each
result directly: every accepted row is put into each of its windows.
"""

from __future__ import annotations

from tidepane.spec import WindowSpec

# The injected disorder. Every fifth event keeps its arrival position and moves
# back in event time by up to 30 minutes.
DISORDER_SQL = (
    "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"
    " - CASE WHEN event_id % 5 = 3 THEN (event_id * 7919) % 1800000 ELSE 0 END"
)
IN_ORDER_SQL = "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"

# Aggregate -> its merged state as (expression over rows, running merge over versions, finish).
STATES = {
    "cnt": ("count(value)", "CAST(sum(cnt) OVER v AS BIGINT)"),
    "total": ("sum(value)", "sum(total) OVER v"),
    "squares": ("sum(value * value)", "sum(squares) OVER v"),
    "lo": ("min(value)", "min(lo) OVER v"),
    "hi": ("max(value)", "max(hi) OVER v"),
    "prod": ("product(CAST(value AS DOUBLE))", "product(prod) OVER v"),
    "pos": ("count(value) FILTER (WHERE value > 0)", "CAST(sum(pos) OVER v AS BIGINT)"),
    "logs": ("sum(ln(CAST(value AS DOUBLE))) FILTER (WHERE value > 0)", "sum(logs) OVER v"),
    "large": ("count(value) FILTER (WHERE value > 100)", "CAST(sum(large) OVER v AS BIGINT)"),
}
MEAN = "CAST(total AS DOUBLE) / nullif(cnt, 0)"
RESULTS = {
    "min": (["lo"], "CAST(lo AS DOUBLE)"),
    "max": (["hi"], "CAST(hi AS DOUBLE)"),
    "sum": (["total"], "CAST(total AS DOUBLE)"),
    "avg": (["cnt", "total"], MEAN),
    "std": (
        ["cnt", "total", "squares"],
        f"sqrt(greatest(CAST(squares AS DOUBLE) / nullif(cnt, 0) - ({MEAN}) * ({MEAN}), 0.0))",
    ),
    "range": (["lo", "hi"], "CAST(hi - lo AS DOUBLE)"),
    "count": (["cnt"], "coalesce(cnt, 0)"),
    "sumsq": (["squares"], "CAST(squares AS DOUBLE)"),
    "geomean": (["pos", "logs"], "round(exp(logs / nullif(pos, 0)), 6)"),
    "large_share": (["cnt", "large"], "CAST(large AS DOUBLE) / nullif(cnt, 0)"),
}


def rows_sql(spec: WindowSpec, key: str | None = None, ts: str = DISORDER_SQL) -> str:
    """CTEs ``src`` (arrivals), ``prog`` (progress, slide, epoch) and ``kept`` (accepted rows)."""
    keys = f"{key}, " if key else ""
    over = f"PARTITION BY {key} " if key else ""
    if spec.origin == "first":
        origin = f"first_value(ts_ms) OVER ({over}ORDER BY seq)"
    else:
        origin = str(0 if spec.origin == "epoch" else spec.origin)
    return f"""
src AS (SELECT {keys}event_id AS seq, {ts} AS ts_ms, CAST(value AS DECIMAL(18,2)) AS value FROM events),
run AS (SELECT *, max(ts_ms) OVER ({over}ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mx,
        CAST({origin} AS BIGINT) AS o FROM src),
prog AS (SELECT *, mx - ts_ms AS lateness_ms,
         CAST(floor((ts_ms - o) / {spec.slide_ms}) AS BIGINT) AS s,
         CAST(floor((ts_ms - o) / {spec.pane_ms}) AS BIGINT) AS q,
         CAST(floor((mx - o) / {spec.slide_ms}) AS BIGINT) AS a FROM run),
kept AS (SELECT * FROM prog WHERE lateness_ms <= {spec.lateness_ms})"""


def versions_sql(
    spec: WindowSpec,
    results: list[str],
    *,
    key: str | None = None,
    which: str = "all",
    emitted_at: bool = True,
    extra: dict[str, str] | None = None,
    extra_states: list[str] = (),
    where: str = "true",
    ts: str = DISORDER_SQL,
) -> str:
    """All, current, revised or final window versions with the named results."""
    keys = f"{key}, " if key else ""
    over = f"PARTITION BY {key} " if key else ""
    on = f"USING ({key})" if key else "ON true"
    states = list(dict.fromkeys([s for r in results for s in RESULTS[r][0]] + list(extra_states)))
    finals = {r: RESULTS[r][1] for r in results} | (extra or {})
    last = "m" if spec.flush else "m - 1"
    update = "".join(f", {STATES[s][0]} AS {s}" for s in states)
    running = "".join(f", {STATES[s][1]} AS {s}" for s in states)
    finish = "".join(f", {expr} AS {name}" for name, expr in finals.items())
    pick = {"all": "true", "current": "e = w", "revised": "e > w", "final": "newest"}[which]
    per_version = which in ("all", "revised")
    empty = ""
    if spec.emit_empty:
        blanks = "".join(f", NULL AS {s}" for s in states)
        empty = f"""
UNION ALL BY NAME SELECT {keys}o, a0, w, w AS e, 0 AS n{blanks}
FROM bounds, unnest(generate_series(a0, {last})) AS g(w)"""
    bare = ", ".join([*([key] if key else []), "o", "a0", "w", "e"])
    merged = "".join(f", {merge_again(s)} AS {s}" for s in states)
    columns = [
        *([key] if key else []),
        f"epoch_ms(o + (w + 1) * {spec.slide_ms} - {spec.window_ms}) AS window_start",
        f"epoch_ms(o + (w + 1) * {spec.slide_ms}) AS window_end",
    ]
    if per_version:
        columns.append(f"epoch_ms(o + (e + 1) * {spec.slide_ms}) AS epoch_end")
        columns.append("CASE WHEN e = w THEN 'current' ELSE 'revised' END AS kind")
    if emitted_at and which != "final":
        same = f"k.{key} IS NOT DISTINCT FROM vers.{key} AND " if key else ""
        columns.append(f"(SELECT epoch_ms(min(k.mx)) FROM epochs k WHERE {same}k.a > vers.e) AS emitted_at")
    return f"""
WITH {rows_sql(spec, key, ts)},
bounds AS (SELECT {keys}o, min(a) AS a0, max(a) AS m FROM kept GROUP BY {keys}o),
epochs AS (SELECT {keys}a, min(mx) AS mx FROM kept GROUP BY {keys}a),
placed AS (SELECT kept.*, a0, g.w AS w, greatest(g.w, a) AS e FROM kept JOIN (SELECT {keys}a0, m FROM bounds) {on},
  unnest(generate_series(CAST(floor(q * {spec.pane_ms} / {spec.slide_ms}) AS BIGINT),
    CAST(floor((q * {spec.pane_ms} + {spec.window_ms}) / {spec.slide_ms}) AS BIGINT) - 1)) AS g(w)
  WHERE g.w >= a0 AND greatest(g.w, a) <= {last}),
grouped AS (SELECT {keys}o, a0, w, e, count(*) AS n{update} FROM placed GROUP BY {bare}{empty}),
delta AS (SELECT {bare}, sum(n) AS n{merged} FROM grouped GROUP BY {bare}),
vers AS (SELECT {bare}, CAST(sum(n) OVER v AS BIGINT) AS n{running},
  e = max(e) OVER (PARTITION BY {keys}w) AS newest
  FROM delta WINDOW v AS (PARTITION BY {keys}w ORDER BY e ROWS UNBOUNDED PRECEDING))
SELECT {", ".join(columns)}, n{finish} FROM vers WHERE {pick} AND {where}"""


def merge_again(state: str) -> str:
    return {"lo": "min(lo)", "hi": "max(hi)", "prod": "product(prod)"}.get(state, f"sum({state})")
