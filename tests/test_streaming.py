"""Streaming over several micro-batch splittings equals the batch query."""

import random

import pytest
from test_windows import make, random_rows

from tidepane import RANGE, STD, SUM, WindowSpec, sliding_versions
from tidepane.functions.messages import result_messages
from tidepane.operators.numbering import number_in_order, partition_arrivals
from tidepane.sources import line_arrivals, read_lines
from tidepane.streaming import ExactStream, latest, pane_feed, start_upsert_feed, upsert_feed, windows_of_panes

SPEC = WindowSpec.of("32 s", "2 s", "24 s")
AGGS = [SUM, STD, RANGE]


def split_feed(spark, frame, cuts, path):
    """One file per arrival range, written in order, so file times follow ``seq``."""
    edges = [-(10**9), *cuts, 10**9]
    for low, high in zip(edges, edges[1:]):
        part = frame.filter(f"seq >= {low} AND seq < {high}")
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rounded(rows):
    return sorted(
        tuple(
            round(v, 6) if isinstance(v, float) else str(v) for v in r.asDict().values()
        )
        for r in rows
    )


@pytest.mark.parametrize(
    "seed,spec,keyed",
    [
        (1, SPEC, False),
        (2, WindowSpec.of("33 s", "6 s", "15 s", origin="first"), False),
        (3, SPEC, True),
        (4, WindowSpec.of("10 s", "5 s", "40 s", origin="first", emit_empty=True), True),
    ],
)
def test_exact_stream_equals_batch(spark, tmp_path, seed, spec, keyed):
    rows, keys = random_rows(seed, 300), ["k"] if keyed else []
    if keyed:
        names = ["a", "b", None]
        rows = [(*row, names[row[0] % 7 % 3]) for row in rows]
    frame = make(spark, rows, keyed).cache()
    rng = random.Random(seed)
    # Uneven batches; two neighbouring cuts can even give a batch without any row.
    cuts = sorted(rng.sample([row[0] for row in rows], 4))
    cuts = [cuts[0], cuts[0] + 1, *cuts[1:]]
    feed = split_feed(spark, frame, cuts, str(tmp_path / "feed"))
    job = ExactStream(spec, AGGS, keys, state_dir=str(tmp_path / "state"), out_dir=str(tmp_path / "out"))
    job.start(feed, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    got = job.results(spark).drop("batch").collect()
    want = sliding_versions(frame, spec, AGGS, keys).collect()
    assert rounded(got) == rounded(want)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = random_rows(9, 120)
    frame = make(spark, rows)
    job = ExactStream(SPEC, AGGS, state_dir=str(tmp_path / "state"), out_dir=str(tmp_path / "out"))
    middle, later = rows[50][0], rows[90][0]
    batches = [f"seq < {middle}", f"seq >= {middle} AND seq < {later}", f"seq >= {later}"]
    for batch_id, condition in enumerate(batches):
        part = frame.filter(condition)
        job.process(part, batch_id)
        job.process(part, batch_id)
    want = sliding_versions(frame, SPEC, AGGS).collect()
    assert rounded(job.results(spark).drop("batch").collect()) == rounded(want)
    with pytest.raises(RuntimeError, match="state in"):
        job.process(frame, 5)


def test_state_keeps_only_reachable_panes(spark, tmp_path):
    frame = make(spark, random_rows(4, 400, mean_gap=2000))
    job = ExactStream(SPEC, [SUM], state_dir=str(tmp_path / "state"), out_dir=str(tmp_path / "out"))
    job.process(frame, 0)
    panes = job.state(spark, 0, "panes").collect()
    open_epoch = max(r["epoch"] for r in panes)
    reach = SPEC.slides_per_window + SPEC.retained_slides
    assert 0 < len(panes) <= 2 * (reach + 1)
    assert all(open_epoch - r["pane"] <= reach for r in panes)


def test_state_of_another_query_is_refused(spark, tmp_path):
    frame = make(spark, random_rows(3, 40))
    dirs = {"state_dir": f"{tmp_path}/state", "out_dir": f"{tmp_path}/out"}
    ExactStream(SPEC, AGGS, **dirs).process(frame.filter("seq < 20"), 0)
    for other in (ExactStream(WindowSpec.of("32 s", "4 s", "24 s"), AGGS, **dirs), ExactStream(SPEC, [SUM], **dirs)):
        with pytest.raises(RuntimeError, match="of the query"):
            other.process(frame.filter("seq >= 20"), 1)
    ExactStream(SPEC, AGGS, **dirs).process(frame.filter("seq >= 20"), 1)


def test_flush_is_refused():
    with pytest.raises(ValueError):
        ExactStream(SPEC.with_options(flush=True), [SUM], state_dir="s", out_dir="o")


def test_upsert_feed_in_order(spark, tmp_path):
    rows = random_rows(6, 200, late_share=0)
    frame = make(spark, rows).selectExpr("seq", "timestamp_millis(ts_ms) AS ts", "value")
    feed = split_feed(spark, frame, [rows[70][0], rows[140][0]], str(tmp_path / "feed"))
    query = start_upsert_feed(
        upsert_feed(feed, SPEC, [SUM]), str(tmp_path / "out"), str(tmp_path / "checkpoint"),
        availableNow=True,
    )
    query.awaitTermination()
    got = {
        (int(r["window_end"].timestamp() * 1000)): round(r["sum"], 6)
        for r in latest(spark.read.parquet(str(tmp_path / "out"))).collect()
    }
    want = {}
    for _, ts, value in rows:
        for end in range(ts // 2000 * 2000 + 2000, ts // 2000 * 2000 + 2000 + 32000, 2000):
            want[end] = want.get(end, 0) + value
    assert got == {end: pytest.approx(value, abs=1e-5) for end, value in want.items()}


def many_keys(count, each):
    rows, at = [], 0
    for step in range(each):
        for key in range(count):
            rows.append((at, step * 3000 + key % 7 * 100, float(key + step), f"k{key}" if key else None))
            at += 1
    return rows


def files_of(folder):
    return {(str(p.relative_to(folder)), p.stat().st_mtime_ns) for p in folder.rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    rows = many_keys(12, 6)
    frame = make(spark, rows, keyed=True)
    job = ExactStream(
        SPEC, [SUM, STD], ["k"], state_dir=str(tmp_path / "state"), out_dir=str(tmp_path / "out"), buckets=8, deltas=2
    )
    half = len(rows) // 2
    # All keys at first, then again and again one key, so its bucket is written anew, then all.
    batches = [frame.filter(f"seq < {half}")]
    batches += [frame.filter(f"seq >= {half} AND k = 'k3' AND seq < {half + 12 * (i + 1)} AND seq >= {half + 12 * i}") for i in range(3)]
    batches += [frame.filter(f"seq >= {half} AND (k <> 'k3' OR k IS NULL)")]
    heads = tmp_path / "state" / "run=direct" / "heads"
    at_first = None
    for batch_id, part in enumerate(batches):
        job.process(part, batch_id)
        at_first = at_first or files_of(heads / "batch=0")
        if 0 < batch_id < 4:
            assert len({name.split("/")[0] for name, _ in files_of(heads / f"batch={batch_id}")}) == 1
            assert files_of(heads / "batch=0") == at_first
        if batch_id:
            job.process(part, batch_id)  # again, after a failure
    keys = {r["k"] for r in job.state(spark, 4, "heads").collect()}
    assert keys == {None, *(f"k{i}" for i in range(1, 12))}
    assert len(job.state(spark, 4, "heads").collect()) == 12
    want = sliding_versions(frame, SPEC, [SUM, STD], ["k"]).collect()
    assert rounded(job.results(spark).drop("batch").collect()) == rounded(want)


def test_versions_no_longer_needed_are_emptied(spark, tmp_path):
    frame = make(spark, random_rows(4, 200))
    job = ExactStream(SPEC, [SUM], state_dir=str(tmp_path / "state"), out_dir=str(tmp_path / "out"))
    for batch_id in range(4):
        job.process(frame.filter(f"seq >= {150 * batch_id + 7} AND seq < {150 * batch_id + 157}"), batch_id)
    panes = tmp_path / "state" / "run=direct" / "panes"
    assert [spark.read.parquet(str(panes / f"batch={i}")).columns == ["gone"] for i in range(4)] == [True, True, False, False]


def test_idle_keys_leave_when_their_bucket_is_written_anew(spark, tmp_path):
    rows = [(0, 0, 1.0, "idle"), (1, 0, 1.0, "busy"), *((i, i * 100_000, 1.0, "busy") for i in range(2, 6))]
    frame = make(spark, rows, keyed=True)
    dirs = {"state_dir": str(tmp_path / "state"), "out_dir": str(tmp_path / "out")}
    job = ExactStream(SPEC, [SUM], ["k"], **dirs, buckets=1, deltas=2, idle_ms=60_000)
    for batch_id in range(5):
        low, high = (0, 2) if batch_id == 0 else (batch_id + 1, batch_id + 2)
        job.process(frame.filter(f"seq >= {low} AND seq < {high}"), batch_id)
        known = {r["k"] for r in job.state(spark, batch_id, "heads").collect()}
        assert known == ({"idle", "busy"} if batch_id < 2 else {"busy"})


def test_falling_arrival_numbers_are_refused(spark, tmp_path):
    frame = make(spark, many_keys(3, 4), keyed=True)
    job = ExactStream(SPEC, [SUM], ["k"], state_dir=str(tmp_path / "state"), out_dir=str(tmp_path / "out"))
    job.process(frame.filter("seq < 6"), 0)
    with pytest.raises(ValueError, match="comes after"):
        job.process(frame.filter("seq >= 5"), 1)
    job.process(frame.filter("seq >= 6"), 1)
    alone = ExactStream(SPEC, [SUM], state_dir=str(tmp_path / "state2"), out_dir=str(tmp_path / "out2"))
    alone.process(frame.filter("seq >= 6"), 0)
    with pytest.raises(ValueError, match="comes after"):
        alone.process(frame.filter("seq < 6"), 1)


def test_runs_do_not_mix(spark, tmp_path):
    frame = make(spark, random_rows(5, 100))
    dirs = {"state_dir": str(tmp_path / "state"), "out_dir": str(tmp_path / "out")}
    first = ExactStream(SPEC, [SUM], **dirs, run="first")
    for batch_id, condition in enumerate(["seq < 100", "seq >= 100"]):
        first.process(frame.filter(condition), batch_id)
    second = ExactStream(SPEC, [SUM], **dirs, run="second")
    second.process(frame.filter("seq < 50"), 0)
    want = sliding_versions(frame.filter("seq < 50"), SPEC, [SUM]).collect()
    assert rounded(second.results(spark).drop("batch").collect()) == rounded(want)
    with pytest.raises(RuntimeError, match="has no batch"):
        second.process(frame, 2)


def test_lines_without_arrival_numbers(spark, tmp_path):
    """Two batches of several files and splits; lines that cannot be read count, but say nothing."""
    rows = [(seq, ts, float(round(100 * value))) for seq, ts, value in random_rows(12, 240)]
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    job = ExactStream(
        SPEC, [SUM], state_dir=str(tmp_path / "state"), out_dir=str(tmp_path / "out"), messages="sum",
        prepare=line_arrivals(mode="drop"),
    )
    try:
        for part in range(4):
            text = "".join(f"{ts},{value}\n" + "?\n" * (seq % 5 == 0) for seq, ts, value in rows[60 * part : 60 * part + 60])
            (tmp_path / "in" / f"part-{part}.txt").write_text(text)
            if part % 2:
                feed = read_lines(spark, "text", file_order="path", path=str(tmp_path / "in"))
                job.start(feed, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sliding_versions(make(spark, rows), SPEC, [SUM])
    assert rounded(job.results(spark).drop("batch").collect()) == rounded(want.collect())
    said = job.message_lines(spark)
    assert sorted(r["value"] for r in said.collect()) == sorted(r["value"] for r in result_messages(want, "sum").collect())
    assert {r["batch"] for r in said.select("batch").collect()} == {0, 1}
    assert job._commit(spark, 1).next_seq == len(rows) + sum(seq % 5 == 0 for seq, _, _ in rows)


def test_messages_in_order_and_once(spark, tmp_path):
    rows = random_rows(13, 150)
    frame = make(spark, rows)
    job = ExactStream(SPEC, [SUM], state_dir=str(tmp_path / "state"), out_dir=str(tmp_path / "out"), messages="sum")
    for batch_id, condition in enumerate(["seq < 200", "seq < 200", "seq >= 200", "seq >= 200"]):
        job.process(frame.filter(condition), batch_id // 2)
    said = job.message_lines(spark).collect()
    want = sliding_versions(frame, SPEC, [SUM]).collect()
    assert len(said) == len(want)
    folder = tmp_path / "out" / "run=direct" / "messages" / "batch=0"
    in_files = [r for f in sorted(folder.glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    order = [(r["emitted_at"], r["epoch_end"], r["kind"] != "current", r["window_end"]) for r in want]
    assert [r["emitted_at"] for r in in_files] == sorted(x[0] for x in order)[: len(in_files)]
    assert in_files[0]["value"].startswith("At time: ")
    with pytest.raises(ValueError, match="no result"):
        ExactStream(SPEC, [SUM], state_dir="s", out_dir="o", messages="avg")


def test_pane_feed_with_rows_behind_the_watermark(spark, tmp_path):
    spec = WindowSpec.of("33 s", "6 s", "5 s")
    rows = [(seq, ts, float(round(100 * value))) for seq, ts, value in random_rows(15, 240, mean_gap=200)]
    frame = make(spark, rows).selectExpr("seq", "timestamp_millis(ts_ms) AS ts", "value")
    cuts = [rows[60][0], rows[120][0], rows[180][0]]
    feed = split_feed(spark, frame, cuts, str(tmp_path / "feed"))
    aggs = [SUM, STD]
    query = start_upsert_feed(
        pane_feed(feed, spec, aggs), str(tmp_path / "out"), str(tmp_path / "checkpoint"), availableNow=True
    )
    query.awaitTermination()
    got = windows_of_panes(spark.read.parquet(str(tmp_path / "out")), spec, aggs).collect()
    # Without a pause between batches, a batch filters by the watermark that the one before it ran with.
    kept, reached = [], [None, None]
    for low, high in zip([0, 60, 120, 180], [60, 120, 180, 240]):
        part = [(ts, value) for _, ts, value in rows[low:high]]
        kept += [(ts, v) for ts, v in part if reached[-2] is None or (ts // 3000 + 1) * 3000 > reached[-2] - 5000]
        reached.append(max([ts for ts, _ in part] + [reached[-1] or 0]))
    assert len(kept) < len(rows)
    want = {}
    for ts, value in kept:
        for end in range(ts // 6000 * 6000 + 6000, ts + 33001, 6000):
            if end - 33000 <= ts < end:
                want.setdefault(end, []).append(value)
    assert {round(r["window_end"].timestamp() * 1000): (r["n"], r["sum"]) for r in got} == {
        end: (len(values), sum(values)) for end, values in want.items()
    }


def records(count):
    """Records of three partitions whose stamps tie and whose event times are in disorder."""
    rng, rows = random.Random(17), []
    for partition in range(3):
        stamp = 1000
        for offset in range(count):
            stamp += rng.choice([0, 0, 1, 700])
            rows.append((stamp, partition, offset, stamp * 10 - rng.randrange(30000), float(rng.randrange(100))))
    return rows


RECORD = "stamp_ms long, partition int, offset long, ts long, value double"


def test_records_get_one_order(spark):
    rows = records(120)
    frame = spark.createDataFrame(rows, RECORD).repartition(5)
    got = number_in_order(frame, ["stamp_ms", "partition", "offset"], first=7, bits=4).collect()
    assert {(r["stamp_ms"], r["partition"], r["offset"]): r["seq"] for r in got} == {
        row[:3]: number for number, row in enumerate(sorted(rows), 7)
    }
    assert number_in_order(frame.limit(0), ["stamp_ms"]).count() == 0


def test_records_are_held_back_until_all_partitions_are_there(spark, tmp_path):
    rows = records(60)
    frame = spark.createDataFrame(rows, RECORD)
    job = ExactStream(
        SPEC, [SUM], state_dir=str(tmp_path / "state"), out_dir=str(tmp_path / "out"), prepare=partition_arrivals(3)
    )
    # The last partition says nothing at first, then the others are ahead of it.
    parts = ["partition < 2 AND offset < 30", "partition = 2 AND offset < 10", "partition = 2 AND offset >= 10", "partition < 2 AND offset >= 30"]
    for batch_id, condition in enumerate(parts):
        job.process(frame.filter(condition), batch_id)
        if batch_id % 2:
            job.process(frame.filter(condition), batch_id)
        assert (job._commit(spark, batch_id).next_seq > 0) == (batch_id > 0)
    until = min(max(r[0] for r in rows if r[1] == p) for p in range(3))
    ready = [(seq, ts, value) for seq, (stamp, _, _, ts, value) in enumerate(sorted(rows)) if stamp < until]
    assert job._commit(spark, 3).next_seq == len(ready) < len(rows)
    want = sliding_versions(make(spark, ready), SPEC, [SUM]).collect()
    assert rounded(job.results(spark).drop("batch").collect()) == rounded(want)
