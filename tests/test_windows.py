"""The batch operators against hand-checked cases and the per-record brute force."""

import random

import pytest
from brute import brute_force, expected
from pyspark.sql import functions as F

from tidepane import (
    Aggregate, AVG, COUNT, GEOMEAN, MAX, MIN, Partial, PRODUCT, RANGE, STD, SUM, SUMSQ, WindowSpec,
    sliding_current, sliding_final, sliding_panes, sliding_revised, sliding_versions,
)
from tidepane.plans.native import native_windows
from tidepane.operators import accepted, dropped, intervals, running, window_versions, windows, with_progress
from tidepane.sources import arrivals

ALL = [MIN, MAX, SUM, AVG, STD, RANGE, COUNT, SUMSQ, PRODUCT, GEOMEAN]
DEFAULT = WindowSpec.of("32 s", "2 s", "24 s")


def ms(stamp):
    return None if stamp is None else round(stamp.timestamp() * 1000)


def make(spark, rows, keyed=False):
    schema = "seq long, ts long, value double" + (", k string" if keyed else "")
    return arrivals(spark.createDataFrame(rows, schema), keys=["k"] if keyed else [])


def seconds(spark, pairs):
    return make(spark, [(i, int(t * 1000), float(v)) for i, (t, v) in enumerate(pairs)])


def by_end(df, column="sum", **where):
    rows = [r for r in df.collect() if all(r[k] == v for k, v in where.items())]
    return {ms(r["window_end"]) // 1000: r[column] for r in rows}


def test_each_row_counts_once(spark):
    got = by_end(sliding_current(seconds(spark, [(0, 5), (2, 7), (4, 1)]), DEFAULT, [SUM]))
    assert got == {2: 5, 4: 12}


def test_lateness_bound_is_inclusive(spark):
    rows = seconds(spark, [(0, 1), (30, 1), (6, 9), (32, 1)])
    versions = sliding_versions(rows, DEFAULT, [SUM]).cache()
    assert by_end(versions, kind="current")[32] == 11
    assert by_end(versions, kind="revised") == {end: 10 for end in range(8, 31, 2)}


def test_row_over_the_bound_is_dropped(spark):
    rows = seconds(spark, [(0, 1), (30, 1), (5.999, 9), (32, 1)])
    assert by_end(sliding_versions(rows, DEFAULT, [SUM]), kind="current")[32] == 2
    assert sliding_revised(rows, DEFAULT, [SUM]).count() == 0
    audit = dropped(with_progress(rows, DEFAULT), DEFAULT).collect()
    assert [(r["seq"], r["lateness_ms"]) for r in audit] == [(2, 24001)]
    assert accepted(with_progress(rows, DEFAULT), DEFAULT).count() == 3


def test_revision(spark):
    versions = sliding_versions(
        seconds(spark, [(0, 1), (2, 2), (4, 3), (3, 10), (6, 4)]), DEFAULT, [SUM]
    ).cache()
    assert by_end(versions, kind="current") == {2: 1, 4: 3, 6: 16}
    assert by_end(versions, kind="revised") == {4: 13}
    assert by_end(versions, "epoch_end", kind="revised")[4].timestamp() == 6
    assert by_end(versions, "emitted_at", kind="revised")[4].timestamp() == 6


def test_negative_maximum(spark):
    got = by_end(sliding_current(seconds(spark, [(0, -5), (2, -3), (4, -9)]), DEFAULT, [MAX]), "max")
    assert got == {2: -5, 4: -3}


def test_gap_closes_all_slides_at_once(spark):
    current = sliding_current(seconds(spark, [(0, 1), (100, 2), (102, 3)]), DEFAULT, [SUM]).cache()
    assert by_end(current) == {**{end: 1 for end in range(2, 33, 2)}, 102: 2}
    closed_at = {end: ms(at) for end, at in by_end(current, "emitted_at").items()}
    assert closed_at == {**{end: 100000 for end in range(2, 33, 2)}, 102: 102000}


def test_late_inside_open_slide_is_no_revision(spark):
    rows = seconds(spark, [(0, 1), (1.5, 2), (0.5, 3), (2, 4)])
    assert by_end(sliding_current(rows, DEFAULT, [SUM])) == {2: 6}
    assert sliding_revised(rows, DEFAULT, [SUM]).count() == 0


def test_late_row_before_the_first_slide(spark):
    rows = seconds(spark, [(10, 1), (4, 5), (12, 1), (14, 1)])
    assert by_end(sliding_current(rows, DEFAULT, [SUM])) == {12: 6, 14: 7}


def test_empty_input(spark):
    rows = seconds(spark, [(0, 1)]).filter("seq < 0")
    for query in (sliding_current, sliding_versions, sliding_final):
        assert query(rows, DEFAULT, [SUM]).count() == 0


def test_emit_empty(spark):
    spec = DEFAULT.with_options(window_ms=4000, emit_empty=True)
    rows = seconds(spark, [(0, 1), (20, 2), (22, 3)])
    current = sliding_current(rows, spec, [SUM, COUNT, AVG, STD]).cache()
    assert by_end(current) == {2: 1, 4: 1, **{e: None for e in range(6, 21, 2)}, 22: 2}
    assert by_end(current, "count")[8] == 0
    assert by_end(current, "avg")[8] is None and by_end(current, "std")[8] is None
    late = seconds(spark, [(0, 1), (10, 2), (7, 9), (12, 1), (14, 1)])
    versions = sliding_versions(late, spec, [SUM]).cache()
    assert by_end(versions, kind="current") == {2: 1, 4: 1, 6: None, 8: None, 10: None, 12: 2, 14: 3}
    assert by_end(versions, kind="revised") == {8: 9, 10: 9}
    assert by_end(sliding_final(late, spec, [SUM])) == {2: 1, 4: 1, 6: None, 8: 9, 10: 9, 12: 2, 14: 3}


def random_rows(seed, count, mean_gap=700, late_share=0.3, max_delay=40000):
    rng = random.Random(seed)
    now, rows = rng.randrange(10**6), []
    for seq in range(count):
        now += rng.randrange(2 * mean_gap) if rng.random() > 0.01 else rng.randrange(90000)
        delay = rng.randrange(max_delay) if rng.random() < late_share else 0
        rows.append((seq * 3 + 7, now - delay, round(rng.uniform(-1, 2), 2)))
    return rows


CASES = [
    (WindowSpec.of("32 s", "2 s", "24 s"), 600),
    (WindowSpec.of("32 s", "2 s", "24 s", origin="first"), 600),
    (WindowSpec.of("33 s", "6 s", "24 s"), 600),
    (WindowSpec.of("10 s", "4 s", 0), 300),
    (WindowSpec.of("7 s", "3 s", "15 s", origin="first", flush=True), 300),
    (WindowSpec.of("5 s", "5 s", "60 s", origin=1234, flush=True), 300),
]


# Each case with states merged over intervals (0), some also with states copied to windows.
@pytest.mark.parametrize("case,copy_width", [*((c, 0) for c in range(len(CASES))), (1, 64), (2, 64), (4, 64)])
def test_versions_equal_brute_force(spark, case, copy_width, monkeypatch):
    monkeypatch.setattr(intervals, "COPY_WIDTH", copy_width)
    monkeypatch.setattr(windows, "ONE_TASK_EPOCHS", 1 if copy_width else 1 << 16)
    spec, count = CASES[case]
    rows = random_rows(case, count)
    want, late = brute_force(
        rows, spec.window_ms, spec.slide_ms, spec.lateness_ms,
        0 if spec.origin == "epoch" else spec.origin, spec.flush,
    )
    frame = make(spark, rows).repartition(5)
    got = sliding_versions(frame, spec, ALL).collect()
    origin = rows[0][1] if spec.origin == "first" else 0 if spec.origin == "epoch" else spec.origin

    def index(stamp):
        return (ms(stamp) - origin) // spec.slide_ms - 1

    assert {(index(r["window_end"]), index(r["epoch_end"])) for r in got} == set(want)
    assert len(got) == len(want)
    for r in got:
        w, e = index(r["window_end"]), index(r["epoch_end"])
        values, emitted = want[w, e]
        assert r["kind"] == ("current" if e == w else "revised")
        assert ms(r["window_start"]) == ms(r["window_end"]) - spec.window_ms
        assert ms(r["emitted_at"]) == emitted
        for name, value in expected(values).items():
            assert r[name] == (value if value is None else pytest.approx(value, rel=1e-9, abs=1e-7)), name
    assert sorted(r["seq"] for r in dropped(with_progress(frame, spec), spec).collect()) == late

    current = sliding_current(frame, spec, [SUM, STD]).collect()
    assert {index(r["window_end"]): (r["n"], r["emitted_at"]) for r in current} == {
        index(r["window_end"]): (r["n"], r["emitted_at"]) for r in got if r["kind"] == "current"
    }
    last = {}
    for r in sorted(got, key=lambda r: r["epoch_end"]):
        last[r["window_end"]] = (r["n"], pytest.approx(r["sum"], abs=1e-7))
    final = sliding_final(frame, spec, [SUM]).collect()
    assert {r["window_end"]: (r["n"], r["sum"]) for r in final} == last


# Splitting nothing, only the hot key, and (two hot keys but one may be broadcast) every key.
@pytest.mark.parametrize("hot_rows,hot_keys", [(10**6, 10), (100, 10), (50, 1)])
@pytest.mark.parametrize("origin", ["first", "epoch"])
def test_keys_with_null_and_hot_key(spark, origin, hot_rows, hot_keys, monkeypatch):
    monkeypatch.setattr(running.find_hot_keys, "__defaults__", (hot_rows, hot_keys))
    spec = WindowSpec.of("32 s", "2 s", "24 s", origin=origin)
    by_key = {"hot": random_rows(1, 500), "b": random_rows(2, 60), None: random_rows(3, 60)}
    rows = [(*row, key) for key, part in by_key.items() for row in part]
    frame = make(spark, rows, keyed=True).repartition(6)
    got = sliding_panes_then_versions(frame, spec, hot_rows)
    for key, part in by_key.items():
        start = part[0][1] if origin == "first" else 0
        want, _ = brute_force(part, spec.window_ms, spec.slide_ms, spec.lateness_ms, start)
        assert {
            (ms(r["window_end"]), ms(r["epoch_end"])):
                (r["n"], pytest.approx(r["sum"], abs=1e-7), ms(r["emitted_at"]))
            for r in got if r["k"] == key
        } == {
            (start + (w + 1) * 2000, start + (e + 1) * 2000): (len(values), sum(values), at)
            for (w, e), (values, at) in want.items()
        }


def sliding_panes_then_versions(frame, spec, hot_rows):
    panes = sliding_panes(frame, spec, [SUM], ["k"], bits=4, hot_rows=hot_rows)
    return window_versions(panes, spec, [SUM], ["k"]).collect()


@pytest.mark.parametrize("bits,levels", [(1, 1), (3, 2), (2, 3), (16, 0)])
def test_bucketed_progress_equals_plain_running_max(spark, bits, levels):
    rows = random_rows(11, 400)
    frame = make(spark, rows).repartition(7)
    got = with_progress(frame, DEFAULT, bits=bits, levels=levels).collect()
    mx, want = None, {}
    for seq, ts, _ in rows:
        mx = ts if mx is None else max(mx, ts)
        want[seq] = mx
    assert {r["seq"]: r["progress_ms"] for r in got} == want


@pytest.mark.parametrize("spread", [lambda seq: seq << 40, lambda seq: seq if seq < 600 else (seq << 12) + (1 << 62), lambda seq: 3**35 + seq * seq * 1000])
def test_progress_of_sparse_arrival_numbers(spark, spread):
    """Even buckets however numbers are spread, and a table above them that holds one row each."""
    rows = [(spread(seq), ts, value) for seq, ts, value in random_rows(14, 400)]
    frame = make(spark, rows).repartition(5)
    cuts = running.find_cuts(frame, "seq", bits=4)
    assert 20 <= len(cuts) <= 25
    placed = running.in_buckets(frame, "b", "seq", 4, cuts).groupBy("b").count().collect()
    assert max(r["count"] for r in placed) <= 40
    got = {r["seq"]: r["progress_ms"] for r in with_progress(frame, DEFAULT, bits=4).collect()}
    mx, want = None, {}
    for seq, ts, _ in rows:
        mx = ts if mx is None else max(mx, ts)
        want[seq] = mx
    assert got == want
    assert running.find_cuts(make(spark, random_rows(14, 400)), "seq") is None
    assert len(running.find_cuts(frame, "seq", bits=4, most=8)) == 7


def test_order_inside_an_epoch_does_not_matter(spark):
    rows = random_rows(5, 300)
    epochs, mx = {}, None
    for seq, ts, value in rows:
        mx = ts if mx is None else max(mx, ts)
        epochs.setdefault(mx // 2000, []).append((seq, ts, value))
    rng, shuffled = random.Random(1), []
    for part in epochs.values():
        # The row that opens the epoch stays first, otherwise its rows would be reassigned.
        head, rest = part[0], part[1:]
        tops = [r for r in rest if r[1] >= head[1]]
        others = [r for r in rest if r[1] < head[1]]
        rng.shuffle(others)
        ordered = [head, *others, *tops]
        shuffled += [(s[0], r[1], r[2]) for s, r in zip(part, ordered)]
    spec = DEFAULT.with_options(lateness_ms=10**9)
    results = [
        {(r["window_end"], r["epoch_end"]): (r["n"], round(r["sum"], 6))
         for r in sliding_versions(make(spark, part), spec, [SUM], emitted_at=False).collect()}
        for part in (rows, shuffled)
    ]
    assert results[0] == results[1]


def test_without_lateness_bound_final_equals_native_window(spark):
    spec = WindowSpec.of("33 s", "6 s", 10**9, flush=True)
    frame = make(spark, random_rows(8, 300))
    final = {r["window_end"]: (r["n"], round(r["sum"], 6)) for r in sliding_final(frame, spec, [SUM]).collect()}
    timed = frame.selectExpr("timestamp_millis(ts_ms) AS ts", "value")
    native = {
        r["window_end"]: (r["n"], round(r["sum"], 6))
        for r in native_windows(timed, spec, [SUM]).collect()
    }
    assert final == {end: native[end] for end in native if min(final) <= end <= max(final)}
    rows = random_rows(8, 300)
    assert ms(min(final)) == (rows[0][1] // 6000 + 1) * 6000
    assert ms(max(final)) == (max(ts for _, ts, _ in rows) // 6000 + 1) * 6000


@pytest.mark.parametrize("copy_width", [0, 64])
def test_deviation_far_from_zero(spark, copy_width, monkeypatch):
    """Doubles a billion away from zero, nulls among them; sums of squares would cancel."""
    monkeypatch.setattr(intervals, "COPY_WIDTH", copy_width)
    rows = random_rows(21, 300)
    moved = [(seq, ts, None if seq % 11 == 0 else 1e9 + value) for seq, ts, value in rows]
    want, _ = brute_force([(s, t, -1 if v is None else v) for s, t, v in moved], 32000, 2000, 24000)
    got = sliding_versions(make(spark, moved), DEFAULT, [STD]).collect()
    assert len(got) == len(want)
    for r in got:
        values = [v - 1e9 for v in want[ms(r["window_end"]) // 2000 - 1, ms(r["epoch_end"]) // 2000 - 1][0] if v != -1]
        assert r["std"] == (pytest.approx(expected(values)["std"], abs=1e-6) if values else None)
    two = sliding_current(seconds(spark, [(0, 1e9), (1, 1e9 + 1), (2, 0)]), DEFAULT, [STD])
    assert by_end(two, "std")[2] == 0.5


def test_joint_state_of_a_user(spark):
    """The value seen first, with its time: both parts of the state only mean something together."""
    first = Aggregate(
        "opening",
        (Partial.joint(
            "opening", lambda v: F.struct(F.min("seq").alias("seq"), F.min_by(v, "seq").alias("value")),
            lambda a, b: F.when(a["seq"] <= b["seq"], a).otherwise(b),
        ),),
        lambda state: state["value"],
    )
    rows = random_rows(22, 200)
    got = sliding_current(make(spark, rows), DEFAULT, [first]).collect()
    order = {(ts, value): seq for seq, ts, value in rows}
    mx, kept = None, []
    for seq, ts, value in rows:
        mx = ts if mx is None else max(mx, ts)
        if mx - ts <= 24000:
            kept.append((seq, ts, value, mx // 2000))
    assert got and len(order) == len(rows)
    for r in got:
        w = ms(r["window_end"]) // 2000 - 1
        inside = [(seq, value) for seq, ts, value, a in kept if (w + 1) * 2000 - 32000 <= ts < (w + 1) * 2000 and a <= w]
        assert r["opening"] == min(inside)[1]


@pytest.mark.parametrize("width", [4, 30])
def test_copied_windows_stay_in_the_task_of_their_block(spark, width):
    """Versions at and across the borders of blocks, by key (one null), with no shuffle of the copies."""
    rng, spec = random.Random(width), WindowSpec.of(f"{width} s", "1 s", "12 s")
    now, rows = -200.0, []
    for seq in range(600):
        now += rng.choice([0, 0.4, 1.7, 2, 9])
        rows.append((seq, int((now - rng.choice([0, 0, 3, 11.9, 12, 14])) * 1000), float(rng.randint(1, 99)), rng.choice(["a", "b", None])))
    versions = sliding_versions(make(spark, rows, keyed=True), spec, [SUM, MAX], ["k"])
    got = {
        (r["k"], ms(r["window_end"]) // 1000 - 1, ms(r["epoch_end"]) // 1000 - 1): (r["n"], r["sum"], r["max"], ms(r["emitted_at"]))
        for r in versions.collect()
    }
    want = {}
    for key in ("a", "b", None):
        found, _ = brute_force([(s, t, v) for s, t, v, k in rows if k == key], width * 1000, 1000, 12000)
        want |= {(key, w, e): (len(x), sum(x), max(x), at) for (w, e), (x, at) in found.items()}
    assert got == want and versions.count() == len(want)
    plan = versions._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "w#" in plan and "Exchange" not in plan.split("Generate")[0]
