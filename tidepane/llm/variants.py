"""Spelling variant grouping (operator 12): a bit-sliced position index over the vocabulary.

Words are counted over all texts. Near words, one inserted, deleted or replaced code point apart,
agree before and behind the edit, so words meet by what they share around one of ``SEGMENTS``
parts: a pair belongs to the part in which its common prefix ends, and to no other. Words that meet
are indexed in units: for each position and letter the set of words that have it there, one bit a
word. A word is looked up by word-parallel recurrences over its letters, which carry the words
without error and, with the position shifted by the edit, those with one. Units keep their words by
falling count, so the first bit of a result is the word's form. A unit reports one row per word: how
many near words it has there, and the best.

Units are hash buckets of many small groups. A group too large for one unit is cut into slices: a
word is indexed in one of them and looked up in all, so nothing is left out and no task grows with
a group. Counts multiply by ten from word to form, so chains are short; roots come by doubling.

Defined results: null text has no words; a null id counts as an empty one in the hash; repeated
rows count each time; runs of any length are taken whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.sources.shared import stage

LEAST_LETTERS = 7
RUN = r"[A-Za-z\x{00C0}-\x{00FF}]"
#: Parts of a word; words meet if they agree outside of one.
SEGMENTS = 3
#: Rows of a bucket of units, and of a group that is not sliced.
BUCKET_ROWS = 1 << 14
GROUP_ROWS = 1 << 12
#: Letters indexed at once, and words looked up at once.
INDEX_LETTERS = 1 << 20
LOOK_UP = 1 << 10
#: A chain of forms is shorter than the decimal digits of a count.
MOST_ROUNDS = 8

FOUND = "word string, n_near bigint, best_n bigint, best string"


def words(docs: DataFrame, least_count: int = 2) -> DataFrame:
    """``word, n``: words of at least seven letters and their occurrences in all texts."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{LEAST_LETTERS},}}"), F.lit(0)))
    lowered = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    found = (
        docs.select("doc_id", runs.alias("run")).withColumn("run", lowered)
        .select("run", F.crc32(named.cast("binary")).alias("h"), F.length("run").alias("size"))
    )
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    word = F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run"))
    counted = found.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= least_count))


def _meetings(word: Column) -> Column:
    """All ``la, part, around`` of a word: the length of the shorter word of a pair, the part that
    may differ, and a hash of what is around it."""
    size = F.length(word)

    def of(la: Column, part: int) -> Column:
        start, stop = F.floor(la * part / SEGMENTS).cast("int"), F.floor(la * (part + 1) / SEGMENTS).cast("int")
        rest = la - stop
        around = F.xxhash64(la, F.lit(part), F.substring(word, F.lit(1), start), F.substring(word, size - rest + 1, rest))
        return F.struct(la.alias("la"), F.lit(part).alias("part"), around.alias("around"))

    as_long = F.array(*[of(size, part) for part in range(SEGMENTS)])
    as_longer = F.array(*[of(size - 1, part) for part in range(SEGMENTS)])
    return F.when(size > LEAST_LETTERS, F.concat(as_long, as_longer)).otherwise(as_long)


def _cut(la: int, part: int) -> int:
    return la * part // SEGMENTS


class Index:
    """Bit sets of the members by position and letter."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray, la: int):
        n, width = letters.shape
        self.base = int(letters.max()) + 1
        self.words = -(-n // 64)
        member, place = np.nonzero(letters)
        keys = place * self.base + letters[member, place]
        self.keys, row = np.unique(keys, return_inverse=True)
        # One row more, empty, for what no member has.
        bits = np.zeros((len(self.keys) + 1, self.words * 64), dtype=np.uint8)
        bits[row, member] = 1
        self.sets = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.all = self._bits(np.ones(n, dtype=bool))
        self.short, self.long = self._bits(sizes == la), self._bits(sizes == la + 1)

    def _bits(self, which: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, dtype=np.uint8)
        padded[: len(which)] = which
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def having(self, letter: np.ndarray, place: int) -> np.ndarray:
        """Members with these letters at this place, one row per letter."""
        if place < 0:
            return np.zeros((len(letter), self.words), dtype=np.uint64)
        key = place * self.base + np.minimum(letter, self.base - 1)
        at = np.searchsorted(self.keys, key)
        found = (at < len(self.keys)) & (letter < self.base)
        found[found] = self.keys[at[found]] == key[found]
        return self.sets[np.where(found, at, len(self.keys))]

    def near(self, asked: np.ndarray, size: int, la: int, part: int) -> np.ndarray:
        """Near members of words of one size whose common prefix ends in ``part``, as bits."""
        none = np.broadcast_to(self.all, (len(asked), self.words)).copy()
        equal, start = none, none if part == 0 else None
        stop = None
        replaced, longer, shorter = np.zeros_like(none), none, np.zeros_like(none)
        for i in range(1, size + 1):
            letter = asked[:, i - 1]
            before, here = equal, self.having(letter, i - 1)
            equal = before & here
            if size == la:
                replaced = (replaced & here) | before
                longer = (longer & self.having(letter, i)) | equal
            else:
                shorter = (shorter & self.having(letter, i - 2)) | before
            if i == _cut(la, part):
                start = equal
            if i == _cut(la, part + 1) and part + 1 < SEGMENTS:
                stop = equal
        if size == la:
            found = (replaced & ~equal & self.short) | (longer & self.long)
        else:
            found = shorter & self.short
        found = found & start
        return found if stop is None else found & ~stop


def _letters(part: list[str], width: int) -> np.ndarray:
    text = "".join([w.ljust(width, "\0") for w in part])
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(part), width).astype(np.int64)


def unit_rows(la: int, part: int, rows: list[tuple[str, int, bool]]) -> Iterator[tuple[str, int, int, str]]:
    """``word, n_near, best_n, best`` for the words of one unit; rows are ``word, n, indexed``."""
    members = sorted(((w, n) for w, n, indexed in rows if indexed), key=lambda x: (-x[1], x[0]))
    step = max(1, min(GROUP_ROWS, INDEX_LETTERS // (la + 1)))
    some = max(1, min(LOOK_UP, INDEX_LETTERS // (la + 1)))
    best: dict[str, tuple[int, int, str]] = {}
    for first in range(0, len(members), step):
        chunk = members[first : first + step]
        names = [w for w, _ in chunk]
        index = Index(_letters(names, la + 1), np.fromiter(map(len, names), dtype=np.int64, count=len(names)), la)
        for size in (la, la + 1):
            asked = [w for w, _, _ in rows if len(w) == size]
            for k in range(0, len(asked), some):
                names = asked[k : k + some]
                found = index.near(_letters(names, la + 1), size, la, part)
                counts = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
                at = np.argmax(found != 0, axis=1)
                value = found[np.arange(len(names)), at]
                low = value & (~value + np.uint64(1))
                place = at * 64 + np.bitwise_count(low - np.uint64(1)).astype(np.int64)
                for i in np.flatnonzero(counts).tolist():
                    known = best.get(names[i])
                    if known is None:  # members come by falling count
                        w, n = chunk[int(place[i])]
                        best[names[i]] = (int(counts[i]), n, w)
                    else:
                        best[names[i]] = (known[0] + int(counts[i]), *known[1:])
    return ((word, *values) for word, values in best.items())


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come unit after unit."""
    unit, rows, out = None, [], []

    def flush() -> None:
        if len(rows) > 1:
            out.extend(unit_rows(unit[0], unit[1], rows))

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        columns = zip(*part) if part else ([], [], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n_near", "best_n", "best"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for la, part, bucket, piece, word, n, indexed in zip(*columns):
            if (la, part, bucket, piece) != unit:
                flush()
                unit, rows = (la, part, bucket, piece), []
            rows.append((word, n, indexed))
        if len(out) > 5000:
            yield batch_of(out)
            out = []
    flush()
    yield batch_of(out)


def near_words(vocabulary: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have near words; ``vocabulary``: ``word, n``."""
    meeting = vocabulary.select("word", "n", F.explode(_meetings(F.col("word"))).alias("m")).select("word", "n", "m.*")
    buckets = max(1, -(-vocabulary.count() * 2 * SEGMENTS // BUCKET_ROWS))
    large = stage(
        meeting.groupBy("around").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > group_rows)
        .select("around", F.ceil(F.col("rows") / group_rows).cast("int").alias("pieces")),
        "variants-groups",
    )
    joined = meeting.join(large, "around", "left")
    small = joined.where("pieces IS NULL").select(
        "la", "part", F.pmod("around", F.lit(buckets)).alias("bucket"), F.lit(-1).alias("piece"), "word", "n", F.lit(True).alias("indexed")
    )
    own = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    sliced = (
        joined.where("pieces IS NOT NULL").withColumns({"own": own, "piece": F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))})
        .select("la", "part", F.col("around").alias("bucket"), "piece", "word", "n", (F.col("own") == F.col("piece")).alias("indexed"))
    )
    unit = ["la", "part", "bucket", "piece"]
    dealt = small.unionByName(sliced).repartition(*unit).sortWithinPartitions(*unit)
    # A word's parts come from several units.
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return (
        dealt.mapInArrow(_units, FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
        .select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of forms; ``forms``: ``word, form``, without cycles."""
    known = stage(forms.select("word", F.col("form").alias("root")), "variants-roots")
    for _ in range(MOST_ROUNDS):
        further = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(known.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "variants-roots")
        known = moved.select("word", "root")
        if moved.where("further IS NOT NULL").isEmpty():
            return known
    raise RuntimeError("a chain of forms does not end")


def spelling_variants(docs: DataFrame, factor: int = 10, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per word: ``word, n, n_near, form, form_n, root``. The form is the most frequent near word
    (ties: the smaller one), if it is ``factor`` times as frequent."""
    vocabulary = stage(words(docs), "variants-words")
    near = near_words(vocabulary, group_rows)
    has_form = F.col("best_n") >= factor * F.col("n")
    table = stage(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "variants-forms",
    )
    ends = roots(table.where("form IS NOT NULL").select("word", "form"))
    return table.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
