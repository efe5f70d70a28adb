"""Suffix-array deduplication (operator 8): bytes of strings that start earlier elsewhere go.

Sorting every suffix of a corpus is not needed to find strings of ``length`` bytes that repeat.
Every such string has an anchor, its ``GRAM``-byte substring with the smallest hash (leftmost), a
function of the string alone. Consecutive starts with one anchor form a region; regions are
compared by anchor only. Equal regions are combined in batches before the shuffle and then by
anchor; all but the first occurrence are repeats as a whole. What is left, the first occurrences of
different regions with one anchor, is dealt by anchor into shards, and each shard is put in suffix
order by external induced sorting (``suffix_sort``), which handles shards larger than memory.

Defined results: null text is empty; a text shorter than ``length`` keeps everything; removed bytes
may cut a UTF-8 character (the kept bytes are hashed, not decoded); null ids are larger than any
other; rows that repeat an id are taken as copies of one document; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepane.llm.hashing import CHUNK, mix, prefix_sums, span_hashes
from tidepane.llm.suffix_sort import PIECE_BYTES, repeats
from tidepane.sources.shared import stage

LENGTH = 100
GRAM = 32
#: Stands for a null id.
LAST = (1 << 63) - 1
#: Rows held in a batch before equal regions are combined.
BATCH_REGIONS = 1 << 18
#: Regions of an anchor beyond which its shard is divided by the distance from the anchor.
HOT_ANCHOR = 256
#: Packs a region's distance to its anchor and its number of starts into one number.
LEAD = 1 << 12
#: Bytes of whole shards that are looked through together before sorting.
BUFFER_BYTES = 1 << 20
#: Starts of one part of a divided anchor.
PART_STARTS = 8


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def regions(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, region hash, first start and shape of all regions of a text: the number of
    starts, and ``LEAD`` times the distance from the first start to the anchor."""
    found = []
    for first in range(0, max(0, len(text) - length + 1), CHUNK):
        part = np.frombuffer(text, dtype=np.uint8)[first : first + CHUNK + length - 1]
        sums = prefix_sums(part)
        places = np.arange(len(part) - gram + 1)
        hashes = span_hashes(sums, places, places + gram)
        lowest = _sliding_minimum((hashes & ~np.uint64((1 << 24) - 1)) | places.astype(np.uint64), length - gram + 1)
        anchors = (lowest & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        counts = np.diff(np.append(starts, len(anchors)))
        at = anchors[starts]
        whole = span_hashes(sums, starts, starts + counts + length - 1)
        own = whole + (at - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found.append((hashes[at], own, starts + first, counts + (at - starts) * LEAD))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchored(length: int, gram: int):
    """Per batch and (anchor, region) one row: its first occurrence and the other ones."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        anchor, region, start, shape, doc = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((start, doc, region, anchor))
        anchor, region, start, shape, doc = anchor[order], region[order], start[order], shape[order], doc[order]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (region[1:] != region[:-1])])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(new))) - 1
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        others = pa.StructArray.from_arrays([pa.array(doc[~new]), pa.array(start[~new])], ["doc", "start"])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(anchor[first].view(np.int64)), pa.array(region[first].view(np.int64)), pa.array(doc[first]),
                pa.array(start[first]), pa.array(shape[first].astype(np.int32)), pa.ListArray.from_arrays(offsets, others),
            ],
            ["anchor", "region", "doc", "start", "shape", "others"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                anchor, region, start, shape = regions(text or b"", length, gram)
                if len(anchor):
                    held.append((anchor, region, start, shape, np.full(len(anchor), doc)))
                    size += len(anchor)
                if size >= BATCH_REGIONS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


_ANCHORED = "anchor bigint, region bigint, doc bigint, start bigint, shape int, others array<struct<doc:bigint,start:bigint>>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the shuffles."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([pack(x or b"") for x in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["doc", "doc_id", "packed"])


def _unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]


def _cut_out(length: int):
    """Bytes of the wanted regions of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc, text, wanted in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), batch.column(2).to_pylist()):
                for x in wanted:
                    value = text[x["start"] : x["start"] + x["count"] + length - 1]
                    for column, y in zip(rows, (x["shard"], value, doc, x["start"])):
                        column.append(y)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["shard", "bytes", "doc", "start"])

    return run


def _recurring(rows: list[tuple[int, bytes, int, int]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """The parts of regions whose strings have a hash that recurs in their shard."""
    if not rows:
        return
    data = np.frombuffer(b"".join([r[1] for r in rows]), dtype=np.uint8)
    sizes = np.array([len(r[1]) for r in rows])
    offsets = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), sizes - length + 1)
    inner = np.arange(len(owner)) - (np.cumsum(sizes - length + 1) - (sizes - length + 1))[owner]
    begin = offsets[owner] + inner
    shards = mix(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))
    hashes = span_hashes(prefix_sums(data), begin, begin + length) ^ shards[owner]
    _, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    often = np.flatnonzero(counts[back] > 1)
    if not len(often):
        return
    new = np.concatenate([[True], (owner[often][1:] != owner[often][:-1]) | (inner[often][1:] != inner[often][:-1] + 1)])
    cuts = np.append(np.flatnonzero(new), len(often))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        _, region, doc, start = rows[int(owner[often[a]])]
        first = int(inner[often[a]])
        yield region[first : first + b - a + length - 1], doc, start + first


def _worth_sorting(rows: Iterator[tuple[int, bytes, int, int]], length: int, buffered: int) -> Iterator[tuple[bytes, int, int]]:
    """Regions in order of their shards; whole shards within a buffer lose what cannot recur, a
    shard that does not fit a buffer is sorted as it is."""
    held: list[tuple[int, bytes, int, int]] = []
    size, passing = 0, None  # the shard that passes as it is
    for row in rows:
        if row[0] == passing:
            yield row[1:]
            continue
        passing = None
        if size >= buffered and row[0] != held[-1][0]:
            yield from _recurring(held, length)
            held, size = [], 0
        held.append(row)
        size += len(row[1])
        if size >= 4 * buffered:
            passing = row[0]
            yield from _recurring([r for r in held if r[0] != passing], length)
            yield from (r[1:] for r in held if r[0] == passing)
            held, size = [], 0
    yield from _recurring(held, length)


def _sort_shard(length: int, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[b.column(i).to_pylist() for i in range(4)]))
        for docs, starts in repeats(_worth_sorting(rows, length, BUFFER_BYTES), length, piece_bytes):
            order = np.lexsort((starts, docs))
            docs, starts = docs[order], starts[order]
            for k in range(0, len(docs), 1 << 16):
                d, s = docs[k : k + (1 << 16)], starts[k : k + (1 << 16)]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)]))
                counts = np.diff(np.append(new, len(d)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[new].astype(np.int64)), pa.array(s[new].astype(np.int64)), pa.array(counts.astype(np.int64))],
                    ["doc", "start", "count"],
                )

    return run


def pack_texts(docs: DataFrame) -> DataFrame:
    source = docs.select("doc", "doc_id", "text")
    return source.mapInArrow(_packed, f"doc bigint, doc_id {source.schema['doc_id'].dataType.simpleString()}, packed binary")


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``doc, start, count``: runs of byte positions at which a repeated string starts.

    ``docs``: ``doc`` (integer, not null), ``doc_id`` and ``text`` (not null), one row per document.
    """
    rows = docs.select("doc", "text").mapInArrow(_anchored(length, gram), _ANCHORED)
    met = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where((F.col("n") > 1) | (F.size("others") > 0))
    met = stage(met.drop("n"), "suffix-anchors")
    first = met.groupBy("anchor", "region").agg(F.min(F.struct("doc", "start")).alias("first"), F.max("shape").alias("shape"))
    first = stage(first, "suffix-regions")
    # Occurrences of a region after its first one.
    every = met.select("anchor", "region", "shape", F.explode(F.concat(F.array(F.struct("doc", "start")), "others")).alias("at"))
    later = every.join(first.select("anchor", "region", "first"), ["anchor", "region"]).where(F.col("at") != F.col("first"))
    later = later.select("at.doc", "at.start", (F.col("shape") % LEAD).cast("bigint").alias("count"))
    # First occurrences of different regions with one anchor.
    several = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = first.join(several, "anchor").select("anchor", "n", "first.doc", "first.start", "shape")
    return later.union(_sorted_shards(wanted, pack_texts(docs), length, piece_bytes))


def _sorted_shards(wanted: DataFrame, docs: DataFrame, length: int, piece_bytes: int) -> DataFrame:
    count, lead = F.col("shape") % LEAD, (F.col("shape") / LEAD).cast("int")
    # Equal strings are equally far from their anchor, so a hot anchor is divided by that distance.
    step = F.when(F.col("n") > HOT_ANCHOR, F.lit(PART_STARTS)).otherwise(F.lit(LEAD))
    nearest = lead - count + 1
    parts = F.explode(F.sequence(F.floor(nearest / step), F.floor(lead / step)))
    split = wanted.select("anchor", "doc", "start", "shape", step.alias("step"), parts.alias("part"))
    far = F.least(lead, (F.col("part") + 1) * F.col("step") - 1)
    near = F.greatest(nearest, F.col("part") * F.col("step"))
    dealt = split.select("doc", F.struct(
        F.xxhash64("anchor", "part").alias("shard"), (F.col("start") + lead - far).cast("bigint").alias("start"),
        (far - near + 1).cast("bigint").alias("count"),
    ).alias("w"))
    per_doc = dealt.groupBy("doc").agg(F.collect_list("w").alias("wanted"))
    cut = docs.join(per_doc, "doc").select("doc", "packed", "wanted").mapInArrow(
        _cut_out(length), "shard bigint, bytes binary, doc bigint, start bigint"
    )
    return cut.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _sort_shard(length, piece_bytes), "doc bigint, start bigint, count bigint"
    )


def _judge(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text, runs in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
                spans, kept, at = 0, hashlib.sha256(), 0
                removed = 0
                for x in sorted((r["start"], r["start"] + r["count"] + length - 1) for r in runs or []):
                    start, end = x[0], min(x[1], len(text))
                    if start > at or not spans:
                        kept.update(text[at:start])
                        spans += 1
                        removed += end - start
                        at = end
                    elif end > at:
                        removed += end - at
                        at = end
                kept.update(text[at:])
                for column, value in zip(rows, (len(text), removed, spans, kept.hexdigest())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, k) for x, k in zip(rows, kinds)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("bigint").alias("doc"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    runs = repeated_starts(keyed, length, gram, piece_bytes)
    runs = stage(runs.groupBy("doc").agg(F.collect_set(F.struct("start", "count")).alias("runs")), "suffix-runs")
    source = pack_texts(keyed).join(runs, "doc", "left").select("doc_id", "packed", "runs")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_judge(length), f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
