"""Durations, line parsing, numbering and messages."""

from datetime import timedelta

import pytest

from tidepane import SUM, WindowSpec, sliding_current, sliding_versions
from tidepane.functions.messages import format_current, format_revision
from tidepane.sources import arrivals, parse_lines, read_lines
from tidepane.sources.lines import DOCUMENTED_PATTERN
from tidepane.spec import duration_ms


@pytest.mark.parametrize(
    "text,ms",
    [("32 seconds", 32000), ("2 min", 120000), ("1 hour 30 minutes", 5400000), ("250ms", 250),
     (1500, 1500), (timedelta(seconds=3), 3000)],
)
def test_duration(text, ms):
    assert duration_ms(text) == ms


@pytest.mark.parametrize("text", ["", "32", "2 parsecs", "x 2 s"])
def test_bad_duration(text):
    with pytest.raises(ValueError):
        duration_ms(text)


@pytest.mark.parametrize("args", [(0, 1), (10, 0), (10, 11), (10, 5, -1)])
def test_bad_spec(args):
    with pytest.raises(ValueError):
        WindowSpec.of(*args)


def test_spec_derived_values():
    spec = WindowSpec.of("33 s", "6 s", "25 s")
    assert (spec.pane_ms, spec.slides_per_window, spec.retained_slides) == (3000, 6, 5)


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, value string")


def test_parse_both_formats(spark):
    got = parse_lines(lines(spark, "1715516052000,856.45", "-1500, -2")).collect()
    assert [(r["seq"], r["ts"].timestamp(), r["value"]) for r in got] == [
        (0, 1715516052.0, 856.45), (1, -1.5, -2.0)
    ]
    got = parse_lines(lines(spark, "2024.5.12 12:14:12, 856.45"), DOCUMENTED_PATTERN).collect()
    assert got[0]["ts"].timestamp() == 1715516052.0 and got[0]["value"] == 856.45


def test_malformed_lines(spark):
    broken = lines(spark, "abc,1", "1000,2", "1000", "1000,x", "")
    assert [r["seq"] for r in parse_lines(broken, mode="drop").collect()] == [1]
    with pytest.raises(Exception, match="malformed line: abc,1"):
        parse_lines(broken.filter("seq = 0")).collect()
    with pytest.raises(ValueError):
        parse_lines(broken, mode="ignore")


def test_batch_lines_are_numbered_in_file_order(spark, tmp_path):
    texts = [[f"{1000 * (100 * f + i)},{f + i / 1000}" for i in range(50)] for f in range(3)]
    for number, part in enumerate(texts):
        (tmp_path / f"part-{number}.txt").write_text("\n".join(part) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = read_lines(spark, "text", streaming=False, file_order="path", path=str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in sorted(got, key=lambda r: r["seq"])] == sum(texts, [])
    assert sorted(r["seq"] for r in got) == list(range(150))


def test_text_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("0,5\n2000,7\n")
    stream = parse_lines(read_lines(spark, "text", path=str(tmp_path / "in")))
    query = (
        stream.writeStream.format("memory").queryName("parsed").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    )
    query.awaitTermination()
    assert sorted(r["value"] for r in spark.table("parsed").collect()) == [5.0, 7.0]


def test_socket_is_a_stream_only(spark):
    with pytest.raises(ValueError):
        read_lines(spark, "socket", streaming=False)


def test_messages(spark):
    spec = WindowSpec.of("32 s", "2 s", "24 s")
    parsed = parse_lines(lines(spark, "0,1", "2000,2", "4000,3", "3000,10", "6000,4"))
    rows = arrivals(parsed)
    current = format_current(sliding_current(rows, spec, [SUM]), "sum").collect()
    assert sorted(r["value"] for r in current) == [
        "At time: 2000, Aggregating results: 1.0",
        "At time: 4000, Aggregating results: 3.0",
        "At time: 6000, Aggregating results: 16.0",
    ]
    revised = format_revision(sliding_versions(rows, spec, [SUM]), "sum", DOCUMENTED_PATTERN)
    assert [r["value"] for r in revised.collect()] == [
        "Past Result of the affected window computed at: 1970.1.1 00:00:04, Updated result: 13.0"
    ]


def test_rows_without_order_or_time(spark):
    from tidepane.sources import arrivals, rejected

    df = spark.createDataFrame([(1, 1000, 1.0), (None, 10**12, 2.0), (3, None, 3.0), (4, 3000, 4.0)], "seq bigint, ts bigint, value double")
    with pytest.raises(Exception, match="is NULL"):
        arrivals(df).collect()
    assert [r.seq for r in arrivals(df, nulls="reject").orderBy("seq").collect()] == [1, 4]
    assert sorted((r.value, r.reason) for r in rejected(df).collect()) == [(2.0, "no order"), (3.0, "no time")]
