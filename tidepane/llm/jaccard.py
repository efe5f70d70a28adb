"""N-gram Jaccard join by universe partition (operator 2).

Sets of word shingles are compared without comparing all documents. Shingle hashes are dealt into
``segments`` of the universe; sizes fall into bands, and every band has its own number of segments,
one more than the largest symmetric difference that two linked sets can have. By the pigeonhole
principle linked sets agree in a segment: the subset of a set that falls into a segment is
indexed. Costs decide how the allowance is spent: where the subsets of a segment collide often
(squared frequencies, estimated by sign sketches over all documents), it gets allowance 0 and a
cheaper segment gets 2, which means that its subsets are also indexed with any one element deleted.
Candidates are verified on the shingles themselves, as words.

Groups of copies are never expanded into pairs: equal word sequences are one unit, whose documents
are counted. The units of a signature are first compared with one centre, and with each other, in
blocks behind a parity sketch that bounds the symmetric difference from below, where a signature
still joins different components. That gives the components; links lie inside of them. To count
links, the units of a component are dealt to blocks of bounded size, and each pair of blocks is
compared exactly in one task, which returns a number per unit: pairs never become rows.

Defined results: null text, empty text or text without words has an empty set, which is linked with
nothing; fewer words than a shingle form one shingle; rows with null id are single and have a null
component; rows that repeat an id are one document per text, and a row that repeats both counts
once; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepane.llm.components import connected_components
from tidepane.llm.hashing import mix, shingle_hashes
from tidepane.llm.tables import stage_texts
from tidepane.sources.shared import stage

#: Sign counters per segment in the cost sketch.
SIGNS = 2
#: Segments of one (band, segment) table whose allowance may be moved.
MOST_MOVES = 4096
#: A segment whose squared frequencies exceed this many times its rows is too costly.
COSTLY = 64.0
#: Documents signed together; their equal signatures are combined before the shuffle.
BATCH_SIGNATURES = 1 << 19
#: Members of a signature compared as one block, and candidates held before they are given out.
BLOCK = 2048
MOST_HELD = 1 << 16
SKETCH_BITS = 2048
#: Sets below this size spend their allowance on deletions, larger ones on more segments.
SMALL = 64
#: Candidates verified against one copy of their centre.
SALT = 256
#: Shingles in one block of a component whose links are counted, and the least that a unit weighs.
BLOCK_SHINGLES = 1 << 17
UNIT_WEIGHT = 128


class Scheme:
    """Arithmetic of a threshold ``num / den`` on shingles of ``n`` words."""

    def __init__(self, n: int, num: int, den: int, moves: dict[tuple[int, int], int] | None = None):
        self.n, self.num, self.den = n, num, den
        self.moves = moves or {}
        self.by_band: dict[int, dict[int, int]] = {}
        for (band, segment), allowance in self.moves.items():
            self.by_band.setdefault(band, {})[segment] = allowance

    def linked(self, common: int, a: int, b: int) -> bool:
        return common * self.den >= self.num * (a + b - common)

    @cache  # noqa: B019
    def bands(self, size: int) -> list[int]:
        """Smallest sizes of the bands up to the one of ``size``; a set links within two bands."""
        lows = [1]
        while True:
            nxt = lows[-1] * self.den // self.num + 1
            if nxt > size:
                return lows
            lows.append(nxt)

    def difference(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    @cache  # noqa: B019
    def roles(self, size: int) -> list[tuple[int, int, int, int]]:
        """(band, segments, allowance of each, largest difference) where a set of ``size`` is indexed.

        Segments without deletions have spare ones beside them, so that a set can leave out those that
        are too thin to tell it from others. Sets with deletions get the fewest and thickest segments.
        """
        lows = self.bands(size)
        out = []
        for band in (len(lows) - 1, len(lows) - 2):
            if band < 0:
                continue
            small = lows[band] * self.den // self.num  # largest size in the band
            if band == len(lows) - 2 and size > small * self.den // self.num:
                continue
            most = self.difference(small, small * self.den // self.num)
            base = 2 if most and small < SMALL else 1
            segments = most // base + 1
            out.append((band, segments + (3 + segments // 16 if most and base == 1 else 0), base, most))
        return out


def _folded(hashes: np.ndarray, segments: int, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each of the sorted hashes, the hashes mixed, and per segment a combined hash and count."""
    # Segments are ranges of the upper half of the hashes, so sorted hashes are in their order.
    at = ((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    own = mix(hashes + np.uint64(band + 1))
    counts = np.bincount(at, minlength=segments)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return at, own, sums[ends] - sums[ends - counts], counts


def _signature(sums: np.ndarray, counts: np.ndarray, band: int, segment: np.ndarray) -> np.ndarray:
    place = mix(np.asarray(segment).astype(np.uint64) * np.uint64(1 << 20) + np.uint64(band))
    return mix(sums ^ place) + counts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _lowest(counts: np.ndarray, allowance: np.ndarray, spare: int) -> int:
    """The greatest number of elements for which all segments with less fit into the spare allowance."""
    least = counts - allowance + 1
    order = np.argsort(least, kind="stable")
    over = np.flatnonzero(np.cumsum(allowance[order]) > spare)
    return max(0, int(least[order[over[0]]]))


def signatures(hashes: np.ndarray, scheme: Scheme) -> np.ndarray:
    """All signatures of a set of distinct shingle hashes.

    With allowance a, linked sets are within a - 1 of each other in some segment; the allowances of
    all such segments exceed the spare allowance. So each set leaves out subsets of fewer than
    ``lowest`` elements, the greatest number for which the segments of fewer than lowest + a - 1
    elements fit into its spare allowance. Of two linked sets let X be the one with the greater
    ``lowest``: in some segment they are within a - 1, and X has at least lowest + a - 1 elements there.
    The subset they share, X's own or one with an element deleted, then has at least ``lowest``
    elements, and both index it.
    """
    out = []
    for band, segments, base, most in scheme.roles(len(hashes)):
        at, own, sums, counts = _folded(hashes, segments, band)
        allowance = np.full(segments, base)
        for segment, value in scheme.by_band.get(band, {}).items():
            allowance[segment] = value
        lowest = _lowest(counts, allowance, int(allowance.sum()) - (most + 1))
        used = np.flatnonzero((allowance > 0) & (counts >= lowest))
        out.append(_signature(sums[used], counts[used], band, used))
        deleted = (allowance[at] == 2) & (counts[at] > lowest)
        if deleted.any():
            out.append(_signature(sums[at[deleted]] - own[deleted], counts[at[deleted]] - 1, band, at[deleted]))
    return np.unique(np.concatenate(out))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _distinct(words: list[bytes], n: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, n))


def _parity(hashes: np.ndarray) -> bytes:
    bits = np.bincount((hashes & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _survey(scheme: Scheme):
    """One pass over the texts: per document its size and digest; per task the cost sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs: dict[tuple[int, int], np.ndarray] = {}
        kinds = None
        for batch in batches:
            kinds = (batch.column(0).type, batch.column(2).type)
            sizes, digests = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = _words(text)
                hashes = _distinct(words, scheme.n)
                for band, segments, base, _ in scheme.roles(len(hashes)) if len(hashes) else ():
                    if base > 1:
                        continue
                    _, _, sums, counts = _folded(hashes, segments, band)
                    sign = _signature(sums, counts, band, np.arange(segments))
                    bits = ((sign[:, None] >> np.arange(SIGNS, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1
                    bits[counts == 0] = 0
                    seen = costs.setdefault((band, segments), np.zeros((segments, SIGNS + 2), dtype=np.int64))
                    seen[:, :SIGNS] += bits
                    seen[:, SIGNS] += counts
                    seen[:, SIGNS + 1] += 1
                sizes.append(len(hashes))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
            yield _survey_batch(batch.column(0), batch.column(2), sizes, digests, pa.nulls(len(sizes), pa.binary()))
        for (band, segments), seen in costs.items():
            head = np.array([band, segments], dtype=np.int64).tobytes()
            none = [pa.nulls(1, kind) for kind in kinds]
            yield _survey_batch(*none, [None], [None], pa.array([head + seen.tobytes()], pa.binary()))

    return run


_SURVEY = "doc_id {}, text_key binary, n_shingles bigint, digest binary, costs binary"


def _survey_batch(ids: pa.Array, keys: pa.Array, sizes: list, digests: list, costs: pa.Array) -> pa.RecordBatch:
    columns = [ids, keys, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), costs]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "digest", "costs"])


def _add_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum sketches of one band; there is one row per band and task, and few bands."""
    sums: dict[bytes, np.ndarray] = {}
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            values = np.frombuffer(blob[16:], dtype=np.int64)
            sums[blob[:16]] = sums.get(blob[:16], 0) + values
    for head, values in sums.items():
        seen = values.reshape(-1, SIGNS + 2).astype(float)
        rows = seen[:, SIGNS + 1]
        squares = (seen[:, :SIGNS] ** 2).mean(1)
        # Cost of a segment against its rows, and what deletions would add.
        worst = np.argsort(-squares)[:64]
        worst = worst[squares[worst] > COSTLY * np.maximum(rows[worst], 1)]
        length = seen[:, SIGNS] / np.maximum(rows, 1)
        cheap = [i for i in np.argsort(squares + length * rows, kind="stable") if i not in set(worst.tolist())][: len(worst)]
        band = int(np.frombuffer(head, dtype=np.int64)[0])
        for i, j in zip(worst.tolist(), cheap):
            if squares[j] * 2 + length[j] * rows[j] < squares[i]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([band]), pa.array([i]), pa.array([int(j)]), pa.array([float(squares[i])])], ["band", "none", "two", "gain"]
                )


def allocate(survey: DataFrame) -> dict[tuple[int, int], int]:
    """Allowances other than 1, at most ``MOST_MOVES`` pairs; any choice keeps the join exact."""
    sketches = survey.where("costs IS NOT NULL").select("costs")
    moves = (
        sketches.repartition(F.substring("costs", 1, 8)).mapInArrow(_add_costs, "band bigint, none bigint, two bigint, gain double")
        .orderBy(F.desc("gain"), "band", "none").limit(MOST_MOVES).collect()
    )
    return {k: v for m in moves for k, v in (((m.band, m.none), 0), ((m.band, m.two), 2))}


def _sign(scheme: Scheme):
    """Per signature and batch of documents one row: the smallest document, and the others."""

    def flush(docs: list[int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not docs:
            return
        keys = np.concatenate(parts)
        owner = np.repeat(np.array(docs, dtype=np.int64), [len(p) for p in parts])
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        rest = np.ones(len(keys), dtype=bool)
        rest[first] = False
        sizes = np.diff(np.append(first, len(keys))) - 1
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[first].view(np.int64)), pa.array(owner[first]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(owner[rest])),
            ],
            ["sig", "doc", "others"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                hashes = _distinct(_words(text), scheme.n)
                if doc is None or not len(hashes):
                    continue
                docs.append(doc)
                parts.append(signatures(hashes, scheme))
                held += len(parts[-1])
                if held >= BATCH_SIGNATURES:
                    yield from flush(docs, parts)
                    docs, parts, held = [], [], 0
        yield from flush(docs, parts)

    return run


def _shared(units: DataFrame, scheme: Scheme) -> DataFrame:
    """``sig, doc, hub`` for every signature that more than one unit (``doc, text``) has."""
    rows = units.select("doc", "text").mapInArrow(_sign(scheme), "sig bigint, doc bigint, others array<bigint>")
    by_sig = Window.partitionBy("sig")
    met = rows.withColumn("n", F.count(F.lit(1)).over(by_sig)).withColumn("hub", F.min("doc").over(by_sig))
    met = met.where((F.col("n") > 1) | (F.size("others") > 0))
    return met.select("sig", F.explode(F.concat(F.array("doc"), "others")).alias("doc"), "hub")


def _shingles(text: bytes | None, n: int) -> set[tuple[bytes, ...]]:
    words = _words(text)
    return set(zip(*[words[i:] for i in range(min(n, len(words)))])) if words else set()


def _verify(scheme: Scheme):
    """Rows of one centre and salt come together, the centre first: keep the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, set()
        for batch in batches:
            a, b = [], []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for hub, salt, doc, text in zip(*columns[:3], batch.column(3).cast(pa.binary()).to_pylist()):
                if (hub, salt) != key:
                    key, centre = (hub, salt), set()
                if doc == hub:
                    centre = _shingles(text, scheme.n)
                    continue
                own = _shingles(text, scheme.n)
                if scheme.linked(len(own & centre), len(own), len(centre)):
                    a.append(doc)
                    b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """The linked ones of distinct ``pairs`` (``doc, hub``); ``texts``: ``doc, text``, one per doc."""
    salt = (F.row_number().over(Window.partitionBy("hub", "part").orderBy("doc")) / SALT).cast("int")
    # Numbered within parts of a hub's candidates, so that no task has all of them.
    salted = pairs.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(64))).withColumn("salt", salt * 64 + F.col("part"))
    sent = salted.select("hub", "salt", "doc")
    sent = sent.union(sent.select("hub", "salt", F.col("hub").alias("doc")).distinct())
    sent = sent.join(texts, "doc").select("hub", "salt", "doc", "text")
    dealt = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("doc") != F.col("hub"))
    return dealt.mapInArrow(_verify(scheme), "a bigint, b bigint")


def _comparable(key: tuple | None, held: list) -> bool:
    """Whether both blocks of a pair have rows; blocks are dealt by hash and may have none."""
    return bool(held) and {x[0] for x in held} == ({0} if key[1] == key[2] else {0, 1})


def _blocks(scheme: Scheme):
    """All pairs of different components within two blocks of a signature's members that the sizes
    and the parity sketches allow."""

    def compare(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        left = [x for x in held if x[0] == 0]
        right = [x for x in held if x[0] == 1] or left
        bits = [np.frombuffer(b"".join(x[4] for x in side), dtype=np.uint64).reshape(len(side), -1) for side in (left, right)]
        ids, parts, sizes = [[np.array([x[k] for x in side]) for side in (left, right)] for k in (1, 2, 3)]
        a, b, found = [], [], 0
        for i in range(len(left)):
            least = np.bitwise_count(bits[1] ^ bits[0][i]).sum(1).astype(np.int64)
            total = sizes[1] + sizes[0][i]
            near = (parts[1] != parts[0][i]) & (least * (scheme.den + scheme.num) <= (scheme.den - scheme.num) * total)
            if right is left:
                near[: i + 1] = False
            hit = ids[1][near]
            a.append(np.maximum(hit, ids[0][i]))
            b.append(np.minimum(hit, ids[0][i]))
            found += len(hit)
            if found >= MOST_HELD or i == len(left) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["doc", "hub"])
                a, b, found = [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for sig, i, j, *rest in zip(*[batch.column(k).to_pylist() for k in range(8)]):
                if (sig, i, j) != key:
                    if _comparable(key, held):
                        yield from compare(held)
                    key, held = (sig, i, j), []
                held.append(rest)
        if _comparable(key, held):
            yield from compare(held)

    return run


def _sketches(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_distinct(_words(t), scheme.n) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_parity(x) for x in sets], pa.binary())],
                ["doc", "n", "parity"],
            )

    return run


def _candidates(shared: DataFrame, components: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """Candidate pairs (``doc, hub``) of different components that share a signature; who has no
    component is its own."""
    named = shared.select("sig", "doc").join(components.select(F.col("id").alias("doc"), "component"), "doc", "left")
    named = named.withColumn("component", F.coalesce("component", "doc"))
    open_ = named.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sig")
    members = stage(named.join(open_, "sig").distinct(), "open-signatures")
    small = texts.join(members.select("doc").distinct(), "doc").select("doc", "text")
    sketches = stage(small.mapInArrow(_sketches(scheme), "doc bigint, n bigint, parity binary"), "parity-sketches")
    # Members are dealt by hash to as many blocks as they fill.
    counts = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocked = members.join(counts, "sig").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    roles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j"), (F.col("block") > x).cast("int").alias("side")
    ))
    dealt = (
        blocked.select("sig", "doc", "component", F.explode(roles).alias("r")).join(sketches, "doc")
        .select("sig", "r.i", "r.j", "r.side", "doc", "component", "n", "parity")
        .repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    )
    return dealt.mapInArrow(_blocks(scheme), "doc bigint, hub bigint").distinct()


def _counts(scheme: Scheme):
    """Per pair of blocks of a component: for each unit the documents it is linked with."""

    def count(held: list[tuple]) -> pa.RecordBatch:
        left = [x for x in held if x[0] == 0]
        right = [x for x in held if x[0] == 1]
        numbers: dict[tuple[bytes, ...], int] = {}
        sets = [
            [np.array([numbers.setdefault(y, len(numbers)) for y in _shingles(text, scheme.n)], dtype=np.int32) for *_, text in side]
            for side in (left, right or left)
        ]
        sizes = np.array([len(x) for x in sets[1]])
        joined, starts = np.concatenate(sets[1]), np.cumsum(sizes) - sizes
        copies = np.array([x[2] for x in right or left])
        here, there = np.zeros(len(left), dtype=np.int64), np.zeros(len(copies), dtype=np.int64)
        marked = np.zeros(len(numbers), dtype=bool)
        for i, own in enumerate(sets[0]):
            marked[own] = True
            common = np.add.reduceat(marked[joined], starts, dtype=np.int64)
            marked[own] = False
            near = common * scheme.den >= scheme.num * (sizes + len(own) - common)
            if not right:
                near[i] = False
            here[i] = copies[near].sum()
            there[near] += left[i][2]
        units, sums = [x[1] for x in left], here
        if right:
            units, sums = units + [x[1] for x in right], np.concatenate([here, there])
        return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(sums)], ["unit", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)] + [batch.column(6).cast(pa.binary()).to_pylist()]
            for root, i, j, *rest in zip(*columns):
                if (root, i, j) != key:
                    if _comparable(key, held):
                        yield count(held)
                    key, held = (root, i, j), []
                held.append(tuple(rest))
        if _comparable(key, held):
            yield count(held)

    return run


def _links(units: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """``unit, n``: the documents behind all other units that a unit is linked with.

    ``units``: ``unit, root, copies, n_shingles``. A component of several blocks sends each unit
    once to each of its blocks, by hash, so no block needs a look at the whole component.
    """
    weight = F.greatest("n_shingles", F.lit(UNIT_WEIGHT))
    roots = units.groupBy("root").agg(F.count(F.lit(1)).alias("n_units"), F.sum(weight).alias("weight")).where("n_units > 1")
    blocks = F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int")
    met = units.join(roots.select("root", blocks.alias("blocks")), "root")
    met = met.withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    roles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j"), (F.col("block") > x).cast("int").alias("side")
    ))
    sent = met.join(texts, met["unit"] == texts["doc"]).select("root", "unit", "copies", "text", F.explode(roles).alias("r"))
    dealt = sent.select("root", "r.i", "r.j", "r.side", "unit", "copies", "text").repartition("root", "i", "j")
    counted = dealt.sortWithinPartitions("root", "i", "j").mapInArrow(_counts(scheme), "unit bigint, n bigint")
    return counted.groupBy("unit").agg(F.sum("n").alias("n"))


def _text_key(text: str) -> Column:
    """The SHA-256 of a text; empty bytes for null."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def _grouped(docs: DataFrame, scheme: Scheme, every_link: bool) -> DataFrame:
    """Per row: ``doc_id, text_key, n_shingles, root, component_id, n_links``; ``root`` names the
    component, and is null where there are no words or no id."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", _text_key("text").alias("text_key"))
    survey = docs.mapInArrow(_survey(scheme), _SURVEY.format(id_type))
    survey = stage(survey.withColumn("row", F.monotonically_increasing_id()), "jaccard-survey")
    scheme = Scheme(scheme.n, scheme.num, scheme.den, allocate(survey))
    rows = survey.where("n_shingles IS NOT NULL")
    # Equal word sequences are one unit, named by a row that has it.
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("digest", "doc_id")
    known = known.agg(F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"))
    units = stage(known.groupBy("digest").agg(
        F.min("row").alias("unit"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"),
        F.first("n_shingles").alias("n_shingles"),
    ), "jaccard-units")
    # The text of each unit, from the rows of its id and text; rows that repeat both are one.
    named = rows.join(units.select(F.col("unit").alias("row")), "row").select("doc_id", "text_key", F.col("row").alias("doc"))
    texts = docs.where("doc_id IS NOT NULL").join(named, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    texts = stage_texts(texts.select("doc", "text"), "jaccard-texts")

    shared = stage(_shared(texts, scheme).distinct(), "jaccard-shared")
    wanted = stage(shared.select("doc").distinct(), "jaccard-wanted")
    wanted = stage_texts(texts.join(wanted, "doc"), "jaccard-texts")
    spokes = stage(shared.where("doc <> hub").select("doc", "hub").distinct(), "jaccard-candidates")
    links = stage(_verified(spokes, wanted, scheme), "jaccard-links")
    components = connected_components(links)
    candidates = stage(_candidates(shared, components, wanted, scheme), "jaccard-candidates")
    more = stage(_verified(candidates, wanted, scheme), "jaccard-links")
    components = connected_components(links.union(more))

    units = units.join(components, units["unit"] == components["id"], "left").withColumn("root", F.coalesce("component", "unit"))
    units = stage(units.select("digest", "unit", "root", "least", "copies", "n_shingles"), "jaccard-units")
    least = units.groupBy("root").agg(F.min("least").alias("component_id"))
    named = units.join(least, "root")
    if every_link:
        near = _links(units.select("unit", "root", "copies", "n_shingles"), wanted, scheme)
        named = named.join(near, "unit", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n", F.lit(0)))
    else:
        named = named.withColumn("n_links", F.lit(None).cast("bigint"))
    named = named.select(F.col("digest").alias("_digest"), "root", "component_id", "n_links")
    has = rows["doc_id"].isNotNull() & (rows["digest"] == named["_digest"])
    return rows.join(named, has, "left").select(
        "doc_id", "text_key", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, n_links``.

    ``component_id`` is the smallest id that links reach; ``n_links`` is the number of other
    documents that the document is linked with, copies included.
    """
    return _grouped(docs, Scheme(n, num, den), every_link=True).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents without near-duplicates: of each component the row with the smallest id stays (of
    its texts, the one with the smallest SHA-256), of rows equal in id and text one. Texts without
    words and rows with null id stay. All columns are kept."""
    rows = _grouped(docs, Scheme(n, num, den), every_link=False).where("doc_id IS NOT NULL")
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key"), "root")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("_id", "_text_key")).alias("x")).select("x.*")
    kept = first.union(rows.where("root IS NULL").select("_id", "_text_key").distinct())
    keyed = docs.select("*", _text_key("text").alias("_own_key"))
    same = (keyed["doc_id"] == kept["_id"]) & (keyed["_own_key"] == kept["_text_key"])
    found = keyed.join(kept, same).dropDuplicates(["_id", "_text_key"])
    return found.select(*[keyed[f"`{c}`"] for c in docs.columns]).union(docs.where("doc_id IS NULL"))
