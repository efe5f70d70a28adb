"""Hard-negative mining (operator 13): rotated one-bit codes with alignments, intervals, integer scores.

Vectors become whole numbers, ``floor(256 * x)``. A vector is rotated (random signs and Hadamard
transforms, twice), its signs are its code, and the product of vector and code, its alignment, is
kept. What the code leaves over is rotated and coded again, ``LEVELS`` times. An anchor is rotated
the same way and cut into bit planes, so its product with a code is a few popcounts. Alignments
times products estimate the inner product, and what is not coded is bounded by Cauchy-Schwarz: the
part of the anchor that is orthogonal to the last code times the norm of the last residual. These
intervals hold for certain. Level by level, pairs leave whose interval misses every score window or
lies below as many certain ones as are asked for; the others are scored in whole numbers. The
result is that of scoring every pair.

Rows are dealt to slices by a hash of all they hold; a task holds one slice and the anchors stream
past it, so work is divided evenly whatever vectors or labels are frequent. Of each slice and
anchor a few best rows remain, which are merged by rank.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part; rows equal in id, label and whole-number vector count once; a null id is no anchor and comes
last among ties; shorter vectors are filled up with zeros; an anchor without other rows of its
label, or whose positives have no negative in their window, gives no rows; an empty table gives
none; other columns are not read. Components beyond 2^26 after scaling fail the query, as scores
would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidepane.sources.shared import stage

SCALE = 256
LARGEST = 1 << 26
LEVELS = 6
#: Bits of an anchor's rotated components.
PLANES = 7
#: Components of the rows of one slice, and pairs that are estimated at once.
SLICE = 1 << 22
PAIRS = 1 << 19
#: Rows of the first chunk, whose scores bound those that follow; later chunks double.
FIRST = 256
#: Pairs that are refined or scored at once.
PIECE = 1 << 16

INDEX = "row bigint, vec_id bigint, label int, whole binary, codes binary, alignments binary, norm double"


def rotated(x: np.ndarray, level: int) -> np.ndarray:
    """Rows rotated by random signs and a Hadamard transform, twice; the width is a power of two."""
    n, width = x.shape
    rng = np.random.Generator(np.random.Philox(key=level + 1))
    for _ in range(2):
        x = x * (rng.integers(0, 2, width) * 2.0 - 1)
        step = 1
        while step < width:
            x = x.reshape(n, -1, 2, step)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
            step *= 2
        x = x.reshape(n, width) / np.sqrt(width)
    return x


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x levels x words) and alignments (rows x levels)."""
    n, width = x.shape
    codes, alignments = np.zeros((n, LEVELS, width // 64), dtype=np.uint64), np.zeros((n, LEVELS))
    for level in range(LEVELS):
        x = rotated(x, level)
        signs = x >= 0
        codes[:, level] = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        alignments[:, level] = np.abs(x).sum(axis=1) / np.sqrt(width)
        x = x - np.where(signs, 1.0, -1.0) * (alignments[:, level] / np.sqrt(width))[:, None]
    return codes, alignments


class Anchors:
    """Bit planes of rotated anchors: the product with a unit code is ``scale * (popcounts) + shift``."""

    def __init__(self, whole: np.ndarray):
        x = whole.astype(np.float64)
        n, width = x.shape
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.planes = np.zeros((LEVELS, n, PLANES, width // 64), dtype=np.uint64)
        self.step, self.total, self.error = (np.zeros((LEVELS, n)) for _ in range(3))
        half = 1 << (PLANES - 1)
        for level in range(LEVELS):
            x = rotated(x, level)
            step = np.maximum(np.abs(x).max(axis=1), 1e-300) / (half - 1)
            near = np.rint(x / step[:, None])
            self.error[level] = np.sqrt(((x - near * step[:, None]) ** 2).sum(axis=1))
            self.step[level], self.total[level] = step / np.sqrt(width), near.sum(axis=1)
            bits = (near + half).astype(np.uint8)
            for p in range(PLANES):
                packed = np.packbits((bits >> p) & 1, axis=1, bitorder="little")
                self.planes[level, :, p] = packed.view(np.uint64)

    def products(self, level: int, codes: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Product of anchors and unit codes: all pairs (anchors x rows), or pairwise with ``of``."""
        planes = self.planes[level] if of is None else self.planes[level][of]
        step, total = (v[level] if of is None else v[level][of] for v in (self.step, self.total))
        if of is None:
            codes, planes, step, total = codes[None], planes[:, None], step[:, None], total[:, None]
        ones = np.zeros(np.broadcast_shapes(codes.shape[:-1], planes.shape[:-2]), dtype=np.int64)
        for p in range(PLANES):
            counted = np.bitwise_count(codes & planes[..., p, :])
            counted = counted[..., 0] if counted.shape[-1] == 1 else counted.sum(axis=-1, dtype=np.int64)
            ones += counted.astype(np.int64) << p
        set_bits = np.bitwise_count(codes).sum(axis=-1, dtype=np.int64)
        return step * (2 * (ones - (1 << (PLANES - 1)) * set_bits) - total)


class Rows:
    """The index rows of one slice."""

    def __init__(self, parts: list[pa.RecordBatch], width: int):
        table = pa.Table.from_batches(parts)
        n = table.num_rows
        self.row = table["row"].to_numpy()
        self.no_id = table["vec_id"].is_null().to_numpy()
        self.vec_id = table["vec_id"].fill_null(0).to_numpy()
        self.label = table["label"].to_numpy()
        self.norm = table["norm"].to_numpy()
        self.whole = _matrix(table["whole"], np.int32, n, width)
        self.codes = _matrix(table["codes"], np.uint64, n, LEVELS * width // 64).reshape(n, LEVELS, -1)
        self.alignments = _matrix(table["alignments"], np.float64, n, LEVELS)
        square = self.norm[:, None] ** 2 - np.cumsum(self.alignments**2, axis=1)
        # Rounding must not make a residual smaller than it is.
        self.residual = np.sqrt(np.maximum(square, 0) + 1e-9 * self.norm[:, None] ** 2)

    def __len__(self) -> int:
        return len(self.row)


def _matrix(column: pa.ChunkedArray, kind: type, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(rows, width)


def _rank(groups: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and then ``order``, and the rank within its group of each place in it."""
    by = np.lexsort((*order[::-1], groups))
    ordered = groups[by]
    first = np.r_[True, ordered[1:] != ordered[:-1]] if len(by) else np.empty(0, dtype=bool)
    return by, np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))


class Search:
    """The first ``k`` rows of one slice for every window of every anchor, found chunk by chunk."""

    def __init__(self, rows: Rows, anchors: Anchors, own: pa.RecordBatch, k: int, same_label: bool, width: int):
        self.rows, self.anchors, self.k, self.same_label = rows, anchors, k, same_label
        self.own_row = own.column("row").to_numpy()
        self.own_label = own.column("label").to_numpy()
        self.whole = _matrix(pa.chunked_array([own.column("whole")]), np.int32, len(self.own_row), width)
        low, high = own.column("low").to_pylist(), own.column("high").to_pylist()
        self.windows = max(map(len, low), default=0)
        # Windows that an anchor does not have are empty ones.
        self.low = np.array([x + [1] * (self.windows - len(x)) for x in low], dtype=np.int64).reshape(len(low), self.windows)
        self.high = np.array([x + [0] * (self.windows - len(x)) for x in high], dtype=np.int64).reshape(len(high), self.windows)
        self.least = self.low.astype(np.float64)
        self.found = np.empty((0, 5), dtype=np.int64)  # anchor, window, score, no id, id

    def interval(self, level: int, product: np.ndarray, estimate: np.ndarray, unsure: np.ndarray, a, r):
        """Estimate and bounds after one more level."""
        align, error = self.rows.alignments[r, level], self.anchors.error[level][a]
        norm = self.anchors.norm[a]
        estimate = estimate + align * product
        unsure = unsure + align * error
        known = np.maximum(np.abs(product) - error, 0)
        rest = np.sqrt(np.maximum(norm**2 - known**2, 0)) * self.rows.residual[r, level]
        half = unsure + rest + 1e-9 * norm * self.rows.norm[r] + 1e-9
        return estimate, unsure, estimate - half, estimate + half

    def chunk(self, start: int, stop: int) -> None:
        rows, a = self.rows, np.arange(len(self.own_row))[:, None]
        r = np.arange(start, stop)[None]
        wanted = (rows.label[None, start:stop] == self.own_label[:, None]) == self.same_label
        wanted &= rows.row[None, start:stop] != self.own_row[:, None]
        product = self.anchors.products(0, rows.codes[start:stop, 0])
        estimate, unsure, lo, hi = self.interval(0, product, 0.0, 0.0, a, r)
        self.raise_least_dense(wanted, lo, hi)
        open_ = np.zeros_like(wanted)
        for t in range(self.windows):
            open_ |= (lo <= self.high[:, t : t + 1]) & (hi >= self.least[:, t : t + 1])
        a, r = np.nonzero(open_ & wanted)
        estimate, unsure = estimate[a, r], unsure[a, r]
        r = r + start
        for level in range(1, LEVELS):
            parts = [self.refine(level, a[i : i + PIECE], r[i : i + PIECE], estimate[i : i + PIECE], unsure[i : i + PIECE]) for i in range(0, len(a), PIECE)]
            if not parts:
                return
            a, r, estimate, unsure, lo, hi = (np.concatenate(x) for x in zip(*parts))
            self.raise_least(a, lo, hi)
            keep = self.reaches(a, lo, hi)
            a, r, estimate, unsure = a[keep], r[keep], estimate[keep], unsure[keep]
        for i in range(0, len(a), PIECE):
            self.score(a[i : i + PIECE], r[i : i + PIECE])

    def refine(self, level, a, r, estimate, unsure):
        product = self.anchors.products(level, self.rows.codes[r, level], a)
        estimate, unsure, lo, hi = self.interval(level, product, estimate, unsure, a, r)
        keep = self.reaches(a, lo, hi)
        return tuple(x[keep] for x in (a, r, estimate, unsure, lo, hi))

    def reaches(self, a, lo, hi):
        keep = np.zeros(len(a), dtype=bool)
        for t in range(self.windows):
            keep |= (lo <= self.high[a, t]) & (hi >= self.least[a, t])
        return keep

    def raise_least_dense(self, wanted, lo, hi) -> None:
        """The k-th best of the rows that are in a window for certain bounds what can be found."""
        if lo.shape[1] < self.k:
            return
        for t in range(self.windows):
            sure = wanted & (lo >= self.low[:, t : t + 1]) & (hi <= self.high[:, t : t + 1])
            best = np.partition(np.where(sure, lo, -np.inf), -self.k, axis=1)[:, -self.k]
            self.least[:, t] = np.maximum(self.least[:, t], best)

    def raise_least(self, a, lo, hi) -> None:
        for t in range(self.windows):
            sure = np.flatnonzero((lo >= self.low[a, t]) & (hi <= self.high[a, t]))
            by, rank = _rank(a[sure], -lo[sure])
            last = sure[by[rank == self.k - 1]]
            self.least[a[last], t] = np.maximum(self.least[a[last], t], lo[last])

    def score(self, a, r) -> None:
        exact = np.einsum("ij,ij->i", self.whole[a].astype(np.int64), self.rows.whole[r].astype(np.int64))
        new = [self.found]
        for t in range(self.windows):
            i = np.flatnonzero((exact >= self.least[a, t]) & (exact <= self.high[a, t]))
            new.append(np.column_stack([a[i], np.full(len(i), t), exact[i], self.rows.no_id[r[i]], self.rows.vec_id[r[i]]]).astype(np.int64))
        every = np.concatenate(new)
        if len(every) == len(self.found):
            return
        by, rank = _rank(every[:, 0] * self.windows + every[:, 1], -every[:, 2], every[:, 3], every[:, 4])
        self.found = every[by[rank < self.k]]
        full = every[by[rank == self.k - 1]]
        self.least[full[:, 0], full[:, 1]] = np.maximum(self.least[full[:, 0], full[:, 1]], full[:, 2])

    def run(self) -> np.ndarray:
        most, start, step = max(1, PAIRS // max(1, len(self.own_row))), 0, FIRST
        while start < len(self.rows):
            stop = min(len(self.rows), start + min(step, most))
            self.chunk(start, stop)
            start, step = stop, 2 * step
        return self.found


def _scan(k: int, same_label: bool, width: int):
    """Rows of a slice come first and are held, its anchors follow and are searched in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_no, parts, rows = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if keys[start, 0] != slice_no:
                    slice_no, parts, rows = keys[start, 0], [], None
                if keys[start, 1] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                rows = rows or Rows(parts, width)
                for at in range(0, part.num_rows, 64):
                    own = part.slice(at, min(64, part.num_rows - at))
                    whole = _matrix(pa.chunked_array([own.column("whole")]), np.int32, own.num_rows, width)
                    found = Search(rows, Anchors(whole), own, k, same_label, width).run()
                    anchor = own.column("row").to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor[found[:, 0]]), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2]),
                            pa.array(found[:, 4], mask=found[:, 3] == 1),
                        ],
                        ["row", "target", "score", "vec_id"],
                    )

    return run


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, whole``: rows that take part, once each, with whole-number components."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    large = F.exists(scaled, lambda x: F.abs(x) > LARGEST)
    failed = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("array<int>")
    taken = rows.where(F.col(vector).isNotNull() & F.col("label").isNotNull() & finite)
    whole = F.when(large, failed).otherwise(scaled.cast("array<int>"))
    return taken.select("vec_id", F.col("label").cast("int").alias("label"), whole.alias("whole")).distinct()


def _index(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, min(4096, batch.num_rows - at))
                lists = part.column("whole")
                lengths = np.diff(lists.offsets.to_numpy())
                whole = np.zeros((part.num_rows, width), dtype=np.int32)
                whole[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = lists.flatten().to_numpy()
                codes, alignments = coded(whole.astype(np.float64))
                norm = np.sqrt((whole.astype(np.float64) ** 2).sum(axis=1))
                blobs = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (whole, codes, alignments)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("vec_id"), part.column("label"), *blobs, pa.array(norm)],
                    ["row", "vec_id", "label", "whole", "codes", "alignments", "norm"],
                )

    return run


def _best(index: DataFrame, anchors: DataFrame, slices: int, k: int, same_label: bool, width: int) -> DataFrame:
    """``row, target, score, vec_id, rank``: the first ``k`` rows for every window of every anchor.

    ``anchors``: ``row, label, whole, low, high`` with arrays of window ends.
    """
    empty = F.array().cast("array<bigint>")
    slice_no = F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")
    held = index.select(slice_no.alias("slice"), F.lit(0).alias("kind"), "*", empty.alias("low"), empty.alias("high"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    asked = anchors.select(everywhere.alias("slice"), F.lit(1).alias("kind"), "*")
    dealt = held.unionByName(asked, allowMissingColumns=True).repartitionById(slices, "slice").sortWithinPartitions("slice", "kind", "row")
    found = dealt.mapInArrow(_scan(k, same_label, width), "row bigint, target int, score bigint, vec_id bigint")
    order = W.partitionBy("row", "target").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    *,
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of other labels whose score is between
    ``window`` percent of the positive's: ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``. ``is_anchor`` is a condition on ``vec_id``."""
    spark = rows.sparkSession
    taken = stage(usable(rows, vector).select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-rows")
    size = taken.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("whole")).alias("width")).first()
    width = 64
    while width < (size["width"] or 0):
        width *= 2
    index = stage(taken.mapInArrow(_index(width), INDEX), "negatives-index")
    # Enough slices for all tasks, larger ones only when there are many rows.
    least = min(2 * spark.sparkContext.defaultParallelism, -(-size["n"] // 1024))
    slices = max(1, -(-size["n"] * width // SLICE), least)
    everything = F.array(F.lit(-(1 << 62)).cast("bigint")), F.array(F.lit(1 << 62).cast("bigint"))
    anchors = index.where(is_anchor).select("row", F.col("vec_id").alias("anchor_id"), "label", "whole")
    asked = anchors.select("row", "label", "whole", everything[0].alias("low"), everything[1].alias("high"))
    near = stage(
        _best(index, asked, slices, positives, True, width)
        .select("row", F.col("rank") - 1, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        .toDF("row", "target", "positive_id", "positive_score"),
        "negatives-positives",
    )
    # whole-number ends of low * p <= 100 * n <= high * p, none for negative p
    p, (low, high) = F.col("positive_score"), window
    ends = near.where("positive_score >= 0").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("target", F.expr(f"({low} * positive_score + 99) div 100").alias("low"), F.expr(f"({high} * positive_score) div 100").alias("high")))).alias("ends")
    )
    # Targets keep their number: positives come by falling score, so those below zero are the last.
    windows = ends.select("row", F.col("ends.low").alias("low"), F.col("ends.high").alias("high"))
    asked = anchors.select("row", "label", "whole").join(windows, "row")
    far = _best(index, asked, slices, negatives, False, width).select("row", "target", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        far.join(near, ["row", "target"]).join(anchors.select("row", "anchor_id"), "row")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
