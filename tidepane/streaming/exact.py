"""Contract-exact streaming: each micro-batch emits the versions of the epochs it has closed."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from tidepane.functions.aggregates import Aggregate
from tidepane.functions.messages import result_messages
from tidepane.operators.panes import build_panes, group_keys, merge_columns
from tidepane.operators.progress import accepted, with_progress
from tidepane.operators.running import find_cuts
from tidepane.operators.windows import match_keys, stream_epochs, window_versions
from tidepane.sources.arrivals import SEQ
from tidepane.sources.shared import emptied, stage
from tidepane.spec import WindowSpec

BUCKET = "_bucket_no"
# Changed keys of a bucket are added to it this often before the bucket is written anew.
DELTAS = 8

COMMIT = (
    "batch_id bigint, query string, next_seq bigint, reached_ms bigint, heads string, panes string, held string, "
    "buckets array<struct<bucket:int,versions:array<bigint>>>, retired array<bigint>"
)

Prepare = Callable[[DataFrame, int, DataFrame | None], tuple[DataFrame, int, DataFrame | None]]


@dataclass
class Commit:
    """What a finished batch leaves: where the state of each bucket is, and how far the stream is."""

    batch_id: int = -1
    next_seq: int = 0
    reached_ms: int | None = None
    #: Schemas of the state tables, as JSON.
    heads: str = ""
    panes: str = ""
    held: str = ""
    buckets: dict[int, list[int]] = field(default_factory=dict)
    #: Versions that the batch before this one still needed.
    retired: list[int] = field(default_factory=list)

    def live(self) -> set[int]:
        return {version for versions in self.buckets.values() for version in versions}


class ExactStream:
    """A sliding-window query over a stream of arrivals, with the same results as the batch query.

    ``state_dir`` and ``out_dir`` are folders shared by all executors. State and results lie in a
    folder per run, named by the id that Spark keeps in the checkpoint: a new checkpoint starts
    afresh and leaves what other runs have written alone.

    State is one head row per key (progress, first and open epoch, last arrival) and the panes that
    can still reach a window, in ``buckets`` by hash of the key. A batch reads the buckets of its
    keys and adds the new state of those keys to them; every ``deltas`` additions a bucket is
    written anew. Other buckets are neither read nor written. With ``idle_ms`` a key that is so far
    behind the greatest event time of all keys is left out when its bucket is written anew: its
    open slide is never closed, and later rows of it start a new stream.

    A batch ends with its commit, a small table that names the versions of every bucket. A batch
    that is run again after a failure starts from the commit before it and replaces its own output
    as a whole. ``seq`` must rise from batch to batch, per key, and the query must stay the same;
    anything else is refused.

    ``prepare`` turns the rows of a batch into arrivals where the stream has no arrival numbers:
    it gets the rows, the next free number and what it has held back, and gives the arrivals, the
    number after them and what to hold back (see :func:`tidepane.sources.lines.line_arrivals` and
    :func:`tidepane.operators.numbering.partition_arrivals`). With ``messages``, the name of a result,
    its messages are written as text beside the results, ordered by closing time.
    """

    def __init__(
        self,
        spec: WindowSpec,
        aggs: Sequence[Aggregate],
        keys: Sequence[str] = (),
        *,
        state_dir: str,
        out_dir: str,
        progress_levels: int = 1,
        buckets: int = 64,
        deltas: int = DELTAS,
        idle_ms: int | None = None,
        prepare: Prepare | None = None,
        messages: str | None = None,
        message_format: str = "epoch_ms",
        run: str = "direct",
    ) -> None:
        if spec.flush:
            raise ValueError("a stream never closes its open slide; flush is for batch input")
        if messages is not None and messages not in [agg.name for agg in aggs]:
            raise ValueError(f"no result is called {messages}")
        self.spec, self.aggs, self.keys = spec, list(aggs), list(keys)
        self.groups = group_keys(spec, keys)
        self.buckets, self.deltas, self.idle_ms = (buckets if keys else 1), deltas, idle_ms
        self.prepare, self.messages, self.message_format = prepare, messages, message_format
        # Slide numbers and partial columns only mean the same under the same query.
        states = [(agg.name, *agg.state_columns()) for agg in self.aggs]
        self.query = f"{spec!r}, {states!r}, {self.keys!r}, {self.buckets}"
        # One level of arrival buckets is enough for what a single micro-batch holds.
        self.progress_levels = progress_levels
        self.state_dir, self.out_dir = state_dir.rstrip("/"), out_dir.rstrip("/")
        self.run, self.checkpoint = run, None

    def start(self, arrivals: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a streaming DataFrame shaped by :func:`tidepane.sources.arrivals`."""
        self.checkpoint = checkpoint.rstrip("/")
        return (
            arrivals.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .foreachBatch(self.process)
            .start()
        )

    def run_id(self, spark: SparkSession) -> str:
        if self.checkpoint is not None:
            stored = spark.read.text(f"{self.checkpoint}/metadata").first()
            self.run, self.checkpoint = json.loads(stored["value"])["id"], None
        return self.run

    def results(self, spark: SparkSession) -> DataFrame:
        """All results of this run with their ``batch``."""
        return spark.read.parquet(f"{self.out_dir}/run={self.run_id(spark)}/results")

    def message_lines(self, spark: SparkSession) -> DataFrame:
        """Messages with ``keys, emitted_at`` and ``batch``; files of a batch are in the order of its messages."""
        return spark.read.parquet(f"{self.out_dir}/run={self.run_id(spark)}/messages")

    def state(self, spark: SparkSession, batch_id: int, table: str) -> DataFrame:
        """The whole state after a batch: ``heads`` or ``panes``."""
        commit = self._commit(spark, batch_id)
        return self._newest(self._stored(spark, commit, table, list(commit.buckets)))

    def process(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = self._commit(spark, batch_id - 1) if batch_id > 0 else Commit()
        next_seq, held_back = before.next_seq, ""
        if self.prepare is not None:
            rows, next_seq, held = self.prepare(rows, before.next_seq, self._held(spark, before))
            if held is not None:
                held_back = stage(held, "held", f"{self._state(spark)}/held/batch={batch_id}").schema.json()
        work = f"{self._state(spark)}/work/{batch_id % 2}"
        seen = stage(
            rows.groupBy(*self.keys, self._bucket().alias(BUCKET)).agg(
                F.min(SEQ).alias("low_seq"), F.max(SEQ).alias("high_seq")
            ),
            "seen", f"{work}/seen",
        )
        touched = [row[0] for row in seen.select(BUCKET).distinct().collect()]
        stored = {name: self._stored(spark, before, name, touched) for name in ("heads", "panes")}
        old = {
            name: None if table is None else self._of_keys(self._newest(table), seen, "left_semi")
            for name, table in stored.items()
        }
        if old["heads"] is not None:
            old["heads"] = stage(old["heads"], "old-heads", f"{work}/old-heads")
            self._refuse_falling(seen, old["heads"])

        progressed = with_progress(
            rows, self.spec, self.keys, heads=old["heads"], levels=self.progress_levels,
            cuts=find_cuts(rows, SEQ) if self.progress_levels else None,
        )
        arrived = stage(
            build_panes(accepted(progressed, self.spec), self.spec, self.aggs, self.keys),
            "arrived", f"{work}/arrived",
        )
        heads = stage(self._heads(arrived, old["heads"], seen), "heads", f"{work}/heads")
        panes = arrived if old["panes"] is None else old["panes"].unionByName(arrived)
        self._emit(panes, arrived, heads, batch_id)

        top = heads.agg(F.max("progress_ms")).first()[0]
        reached = max((ms for ms in (top, before.reached_ms) if ms is not None), default=None)
        full = [b for b in touched if not self.keys or len(before.buckets.get(b, [])) >= self.deltas]
        schemas = self._store(heads, panes, stored, seen, full, reached, batch_id)
        after = Commit(batch_id, next_seq, reached, **schemas, held=held_back, buckets=dict(before.buckets))
        for bucket in touched:
            known = [] if bucket in full else before.buckets.get(bucket, [])
            # A batch that is run again is named once.
            after.buckets[bucket] = [v for v in known if v != batch_id] + [batch_id]
        # The commit before must stay readable, so its versions go one batch later.
        after.retired = sorted(before.live() - after.live())
        self._write_commit(spark, after)
        if held_back and batch_id > 1:
            emptied(spark, f"{self._state(spark)}/held/batch={batch_id - 2}")
        for version in before.retired:
            for name in ("heads", "panes"):
                emptied(spark, f"{self._state(spark)}/{name}/batch={version}")

    def _state(self, spark: SparkSession) -> str:
        return f"{self.state_dir}/run={self.run_id(spark)}"

    def _held(self, spark: SparkSession, commit: Commit) -> DataFrame | None:
        """What ``prepare`` has kept back for this batch."""
        if not commit.held:
            return None
        schema = T.StructType.fromJson(json.loads(commit.held))
        return spark.read.schema(schema).parquet(f"{self._state(spark)}/held/batch={commit.batch_id}")

    def _bucket(self) -> Column:
        if not self.keys:
            return F.lit(0)
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _commit(self, spark: SparkSession, batch_id: int) -> Commit:
        path = f"{self._state(spark)}/commits/batch={batch_id}"
        try:
            found = spark.read.schema(COMMIT).parquet(path).first()
        except AnalysisException:
            found = None
        if found is None:
            raise RuntimeError(f"state in {self._state(spark)} has no batch {batch_id}")
        if found["query"] != self.query:
            raise RuntimeError(f"state in {path} is of the query {found['query']}, not {self.query}")
        buckets = {b["bucket"]: list(b["versions"]) for b in found["buckets"]}
        return Commit(
            batch_id, found["next_seq"], found["reached_ms"], found["heads"], found["panes"], found["held"],
            buckets, list(found["retired"]),
        )

    def _write_commit(self, spark: SparkSession, commit: Commit) -> None:
        buckets = [(b, v) for b, v in sorted(commit.buckets.items())]
        row = (
            commit.batch_id, self.query, commit.next_seq, commit.reached_ms, commit.heads, commit.panes,
            commit.held, buckets, commit.retired,
        )
        path = f"{self._state(spark)}/commits/batch={commit.batch_id}"
        spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("overwrite").parquet(path)

    def _stored(self, spark: SparkSession, commit: Commit, name: str, buckets: list[int]) -> DataFrame | None:
        """The state of some buckets in all their versions, with its ``batch``."""
        folder = f"{self._state(spark)}/{name}"
        paths = [f"{folder}/batch={v}/{BUCKET}={b}" for b in buckets for v in commit.buckets.get(b, [])]
        if not paths:
            return None
        schema = T.StructType.fromJson(json.loads(getattr(commit, name))).add("batch", "long")
        return spark.read.schema(schema).option("basePath", folder).parquet(*paths).drop(BUCKET)

    def _newest(self, table: DataFrame | None) -> DataFrame | None:
        """Of each key what its last batch has written."""
        if table is None:
            return None
        newest = F.max("batch").over(W.partitionBy(*self.keys)) if self.keys else F.col("batch")
        return table.withColumn("_newest", newest).where("batch = _newest").drop("_newest", "batch")

    def _of_keys(self, table: DataFrame, seen: DataFrame, how: str) -> DataFrame:
        """Rows of the keys that are (``left_semi``) or are not (``left_anti``) in the batch."""
        if not self.keys:
            return table if how == "left_semi" else table.limit(0)
        return match_keys(table, seen.select(*self.keys), self.keys, how)

    def _refuse_falling(self, seen: DataFrame, heads: DataFrame) -> None:
        known = heads.select(*self.keys, "last_seq")
        both = match_keys(seen, known, self.keys, "inner") if self.keys else seen.crossJoin(known)
        falling = both.where("low_seq <= last_seq").limit(1).collect()
        if falling:
            row = falling[0]
            raise ValueError(
                f"arrival {row['low_seq']} of {[row[k] for k in self.keys]} comes after {row['last_seq']}"
            )

    def _heads(self, arrived: DataFrame, old: DataFrame | None, seen: DataFrame) -> DataFrame:
        """Per key of the batch: progress, first epoch, first epoch not emitted yet, open epoch."""
        new = arrived.groupBy(*self.groups).agg(
            F.max("reached_ms").alias("progress_ms"),
            F.min("epoch").alias("first_epoch"),
            F.min("epoch").alias("emit_from"),
            F.max("epoch").alias("open_epoch"),
        )
        if old is not None:
            known = old.withColumn("emit_from", F.col("open_epoch")).drop("last_seq")
            # The epoch that was open is the first to emit; a new key starts with its own first.
            new = known.unionByName(new).groupBy(*self.groups).agg(
                F.max("progress_ms").alias("progress_ms"),
                F.min("first_epoch").alias("first_epoch"),
                F.min("emit_from").alias("emit_from"),
                F.max("open_epoch").alias("open_epoch"),
            )
        new = new.filter(F.col("open_epoch").isNotNull())
        if self.keys:
            last = seen.select(*self.keys, F.col("high_seq").alias("last_seq"))
            return match_keys(new, last, self.keys, "inner")
        last = seen.first()
        return new.withColumn("last_seq", F.lit(last["high_seq"] if last else None).cast("long"))

    def _emit(self, panes: DataFrame, arrived: DataFrame, heads: DataFrame, batch_id: int) -> None:
        since = heads.select(
            *self.groups, F.col("emit_from").alias("epoch"), F.lit(None).cast("long").alias("opened_ms")
        )
        # Closing times come from this batch; the epoch open before it needs a row to close.
        epochs = (
            stream_epochs(arrived, self.spec, self.keys).unionByName(since)
            .groupBy(*self.groups, "epoch").agg(F.min("opened_ms").alias("opened_ms"))
        )
        versions = window_versions(
            panes, self.spec, self.aggs, self.keys, bounds=heads, epochs=epochs
        )
        out = f"{self.out_dir}/run={self.run_id(heads.sparkSession)}"
        written = stage(versions, "results", f"{out}/results/batch={batch_id}")
        if self.messages is not None:
            said = result_messages(written, self.messages, self.message_format, self.keys)
            said.write.mode("overwrite").parquet(f"{out}/messages/batch={batch_id}")

    def _store(
        self, heads: DataFrame, panes: DataFrame, stored: dict, seen: DataFrame, full: list[int],
        reached: int | None, batch_id: int,
    ) -> dict[str, str]:
        """Write the state of the batch's keys, and of all other keys of the buckets written anew;
        the schemas of both tables."""
        spark = heads.sparkSession
        tables = {"heads": heads, "panes": self._retained(panes, heads)}
        if full and self.keys and stored["heads"] is not None:
            others = self._of_keys(self._newest(stored["heads"]), seen, "left_anti").where(self._bucket().isin(full))
            if self.idle_ms is not None and reached is not None:
                others = others.where(F.col("progress_ms") >= reached - self.idle_ms)
            others = stage(others, "others", f"{self._state(spark)}/work/{batch_id % 2}/others")
            their = match_keys(self._newest(stored["panes"]), others.select(*self.keys), self.keys, "left_semi")
            tables = {"heads": heads.unionByName(others), "panes": tables["panes"].unionByName(their)}
        for name, table in tables.items():
            (
                table.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
                .write.mode("overwrite").partitionBy(BUCKET)
                .parquet(f"{self._state(spark)}/{name}/batch={batch_id}")
            )
        return {name: table.schema.json() for name, table in tables.items()}

    def _retained(self, panes: DataFrame, heads: DataFrame) -> DataFrame:
        """Panes for the next batch: closed epochs merged into one, unreachable panes dropped."""
        spec = self.spec
        opened = heads.select(*self.groups, "open_epoch")
        if self.groups:
            joined = match_keys(panes, opened, self.groups, "inner")
        else:
            row = opened.first()
            joined = panes.withColumn("open_epoch", F.lit(row[0] if row else None).cast("long"))
        oldest_window = F.col("open_epoch") - spec.retained_slides
        reach = (oldest_window + 1) * spec.slide_ms - spec.window_ms
        return (
            joined.filter((F.col("pane") + 1) * spec.pane_ms > reach)
            .withColumn("epoch", F.greatest("epoch", F.col("open_epoch") - 1))
            .groupBy(*self.groups, "pane", "epoch")
            .agg(*merge_columns(self.aggs))
            .withColumn("opened_ms", F.lit(None).cast("long"))
        )
