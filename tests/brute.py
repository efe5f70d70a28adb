"""Per-record evaluation of the query contract in plain Python, for small test inputs."""

import math


def brute_force(rows, W, S, L, origin=0, flush=False):
    """``rows`` = [(seq, ts_ms, value)] of one key. Returns (versions, dropped seqs).

    versions: {(w, e): (sorted values, emitted_at)}, including revisions (e > w).
    """
    rows = sorted(rows)
    if not rows:
        return {}, []
    origin = rows[0][1] if origin == "first" else origin
    mx, kept, late = None, [], []
    for seq, ts, value in rows:
        mx = ts if mx is None else max(mx, ts)
        if mx - ts <= L:
            kept.append((ts, (mx - origin) // S, value, mx))
        else:
            late.append(seq)
    a0, M = min(k[1] for k in kept), max(k[1] for k in kept)
    last = M if flush else M - 1

    def content(w, e):
        lo, hi = origin + (w + 1) * S - W, origin + (w + 1) * S
        return sorted(v for ts, a, v, _ in kept if lo <= ts < hi and a <= e)

    def closed_at(e):
        return min((m for _, a, _, m in kept if a > e), default=None)

    out = {}
    for w in range(a0, last + 1):
        values = content(w, w)
        if values:
            out[w, w] = values, closed_at(w)
        lo, hi = origin + (w + 1) * S - W, origin + (w + 1) * S
        for e in sorted({a for ts, a, _, _ in kept if w < a <= last and lo <= ts < hi}):
            out[w, e] = content(w, e), closed_at(e)
    return out, late


def expected(values):
    n, total = len(values), math.fsum(values)
    mean = total / n
    positives = [v for v in values if v > 0]
    return {
        "n": n, "count": n, "sum": total, "min": min(values), "max": max(values), "avg": mean,
        "std": math.sqrt(math.fsum((v - mean) ** 2 for v in values) / n),
        "range": max(values) - min(values), "sumsq": math.fsum(v * v for v in values),
        "product": math.prod(values),
        "geomean": math.exp(math.fsum(map(math.log, positives)) / len(positives)) if positives else None,
    }
