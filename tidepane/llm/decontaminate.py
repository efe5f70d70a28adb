"""Benchmark decontamination (operator 6).

Windows of consecutive benchmark words are broadcast in blocks of bounded size, and every document
is scanned once per block: span hashes of all its word windows are looked up in a bitmap and a
sorted array, and each hit is verified against the window's bytes. Word ranges that are hit and
the items they belong to stay with the row, so a document is never shuffled for a single block;
results of several blocks are merged by row.

Defined results: null or empty text has no words and is never hit; items without words have no
windows; repeated items count once by ``item_id``; null ``item_id`` is ignored; documents keep all
their columns, whatever their names, and repeated rows are judged alike; an empty benchmark hits
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepane.llm.hashing import CHUNK, prefix_sums, shingle_hashes, span_hashes
from tidepane.sources.shared import stage

#: Words of a window.
WINDOW = 10
#: (window, item) entries in one broadcast block, some 40 MB in a Python worker.
BLOCK_ENTRIES = 200_000

_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def plain(text: bytes | None) -> bytes:
    """Letters lower-cased, everything between words turned into blanks; same length as the text."""
    return (text or b"").translate(_LOWER)


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = plain(text).split()
                size = min(window, len(words))
                for i in range(len(words) - size + 1 if size else 0):
                    ids.append(item)
                    texts.append(b" ".join(words[i : i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["item", "window"])

    return run


class Windows:
    """One block: windows by number of words, as bitmap, sorted hashes and bytes."""

    def __init__(self, entries: list[tuple[str, bytes]]):
        self.items: dict[bytes, list[str]] = {}
        for item, window in entries:
            self.items.setdefault(window, []).append(item)
        by_size: dict[int, set[int]] = {}
        for window in self.items:
            words = window.split(b" ")
            by_size.setdefault(len(words), set()).add(int(shingle_hashes(words, len(words))[0]))
        self.by_size = {n: self._index(hashes) for n, hashes in by_size.items()}

    @staticmethod
    def _index(hashes: set[int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.sort(np.array(list(hashes), dtype=np.uint64))
        bitmap = np.zeros(1 << 22, dtype=bool)
        bitmap[keys & np.uint64(len(bitmap) - 1)] = True
        return keys, bitmap

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """Merged ranges of hit words, and the items whose windows occur, sorted as strings."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        most = max(self.by_size, default=0)
        first = 0
        while first < len(words):
            # A part of the text: as many words as fill a chunk, overlapping by a window.
            last, size = first, 0
            while last < len(words) and (size < CHUNK or last < first + 2 * most):
                size += len(words[last]) + 1
                last += 1
            part = words[first:last]
            joined = b" ".join(part)
            sums = prefix_sums(np.frombuffer(joined, dtype=np.uint8))
            lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            for n, (keys, bitmap) in self.by_size.items():
                if len(part) < n:
                    continue
                found = span_hashes(sums, starts[: len(part) - n + 1], ends[n - 1 :])
                maybe = np.flatnonzero(bitmap[found & np.uint64(len(bitmap) - 1)])
                for i in maybe[keys[np.minimum(np.searchsorted(keys, found[maybe]), len(keys) - 1)] == found[maybe]].tolist():
                    owners = self.items.get(joined[starts[i] : ends[i + n - 1]])
                    if owners:
                        items.update(owners)
                        ranges.append((first + i, first + i + n))
            if last == len(words):
                break
            first = last - most + 1
        merged: list[list[int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return merged, sorted(items)


def _scan(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(block.value)
        for batch in batches:
            counts, hits, items = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = plain(text).split()
                found, owners = windows.scan(words)
                counts.append(len(words))
                hits.append(found)
                items.append(owners)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()),
                    pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string())),
                ],
                [batch.schema.names[0], "n_words", "hits", "items"],
            )

    return run


def overlaps(
    docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """``row`` (a struct of the columns to ``carry``, all by default), ``n_words``, ``hits`` (word
    ranges), ``items``."""
    spark = docs.sparkSession
    entries = stage(
        benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
        .mapInArrow(_item_windows(window), "item string, window binary").distinct(),
        "benchmark-windows",
    )
    blocks = max(1, -(-entries.count() // block_entries))
    numbered = entries.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(blocks)))
    source = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col("text"))
    if blocks > 1:
        # Rows with the same content have the same hits, so content serves as their key.
        source = source.select("row", F.sha2(F.to_json(F.struct("row", "text")).cast("binary"), 256).alias("key"), "text")
    scanned = source.select("row" if blocks == 1 else "key", "text")
    schema = T.StructType([scanned.schema[0], *FOUND])
    parts = []
    for number in range(blocks):
        rows = numbered.where(F.col("block") == number).select("item", "window").toLocalIterator()
        block = spark.sparkContext.broadcast([(r.item, bytes(r.window)) for r in rows])
        parts.append(scanned.mapInArrow(_scan(block), schema))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    merged = every.groupBy("key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    united = F.aggregate(
        "hits", F.array().cast("array<array<bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x[0] <= F.element_at(F.element_at(done, -1), 2)),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.array(
                    F.element_at(F.element_at(done, -1), 1),
                    F.greatest(F.element_at(F.element_at(done, -1), 2), x[1]),
                )),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return (
        source.select("row", "key").join(merged.withColumn("hits", united), "key")
        .select("row", "n_words", "hits", "items")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, hits in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            if hits:
                is_word = np.frombuffer(b" " + plain(text) + b" ", dtype=np.uint8) != 32
                edges = np.flatnonzero(is_word[1:] != is_word[:-1])
                kept, at = [], 0
                for a, b in hits:
                    kept.append(text[at : edges[2 * a]])
                    at = int(edges[2 * b - 1])
                text = b"".join([*kept, text[at:]])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options: int) -> DataFrame:
    """The documents without benchmark text: whole ``documents`` go, or only the ``spans`` hit.

    A span runs from the first to the last of consecutive hit words. Columns are those of ``docs``.
    """
    found = overlaps(docs, benchmark, **options)
    if remove == "documents":
        return found.where(F.size("hits") == 0).select("row.*")
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    cut = found.select("row", F.col("row.text").alias("text"), "hits").mapInArrow(
        _cut, T.StructType([T.StructField("row", docs.schema), T.StructField("text", T.StringType())])
    )
    return cut.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, x: total + x[1] - x[0])
    return overlaps(docs, benchmark, ["doc_id"], **options).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
