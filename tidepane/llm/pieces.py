"""SentencePiece encoding and decoding with distinct sampled segmentations (operator 4).

A text is a lattice whose edges are vocabulary pieces; characters without a piece of their own fall
back to byte pieces. Pieces have log probabilities (by a power law of their rank in the public
model), so a path has a probability. Gumbel top-k without replacement: the root gets a perturbed
score, each node hands its score to the child that wins the perturbed comparison, and the other
children get scores cut off at it. Following the winners leads to the best path, and the best child
left behind is where an A* search goes on, so every sample costs one descent from there and no path
comes twice. Siblings left behind wait in the queue together, by the best score among them; which of
them has it is drawn when the search comes back. A sample's inclusion score is the probability that its perturbed score exceeds that of
the best path left out. Noise is a hash of the row's key, the sample and the place in the lattice:
results do not depend on partitions.

No piece of the vocabulary spans a blank after a letter, a line break, or a letter and a sign, so
lattices are built per distinct unit (blanks and the word or signs after them; a vocabulary with
other pieces is refused) and documents walk through them together, in numpy.
The encoding is lossless: no normalisation, blanks are the pieces' word marks, one blank is put in
front and taken off by decoding.

Defined results: null text counts as empty, whose one segmentation is the mark alone; fewer paths
than samples give fewer rows; rows that repeat id and text get the same samples; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepane.llm.hashing import mix, prefix_sums, span_hashes
from tidepane.llm.memory import give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Log probability of a piece: minus this times the logarithm of its rank.
SHARPNESS = 1.0
#: Text walked through together, rows of a batch that are Python objects at once, and bytes of cached
#: unit lattices in a worker.
CHUNK_BYTES = 300_000
ROWS = 500
CACHE_BYTES = 64_000_000
#: Bytes of an edge and of a node, and of a unit's entry beside its own bytes.
EDGE_BYTES, NODE_BYTES, UNIT_BYTES = 16, 8, 150

#: Blanks and what follows of one kind: Latin letters (up to U+02BF), or anything else.
_UNIT = re.compile(rb" *(?:[A-Za-z]+|[\xc3-\xca][\x80-\xbf])+| *[^ \nA-Za-z\xc3-\xca]+| +|\n|[\xc3-\xca]")
_MARK = "▁"


class Vocabulary:
    """Pieces as bytes (word marks as blanks), log probabilities, and a hash index by length."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray, bytes_at: list[int]):
        self.pieces, self.log_p, self.bytes_at = pieces, log_p, np.array(bytes_at)
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.begins = np.cumsum(self.sizes) - self.sizes
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if np.isfinite(log_p[i]):
                by_length.setdefault(len(piece), []).append(i)
        own = set(bytes_at)
        self.index = {}
        for length, ids in sorted(by_length.items()):
            ids = [i for i in ids if i not in own]
            if not ids:
                continue
            data = np.frombuffer(b"".join(pieces[i] for i in ids), dtype=np.uint8)
            at = np.arange(len(ids)) * length
            keys = span_hashes(prefix_sums(data), at, at + length)
            order = np.argsort(keys)
            present = np.zeros(1 << 18, dtype=bool)
            present[(keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            self.index[length] = (keys[order], np.array(ids)[order], present)

    @staticmethod
    def load(path: str) -> tuple[list[bytes], np.ndarray, list[int]]:
        """Arguments of a vocabulary, read from a model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces, log_p, bytes_at, rank = [], np.full(size, -np.inf), [-1] * 256, 0
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                pieces.append(bytes([value]))
                bytes_at[value], log_p[i] = i, -SHARPNESS * np.log(size)
            elif model.is_control(i) or model.is_unknown(i):
                pieces.append(b"")
            else:
                if " " in piece or len(_UNIT.findall(piece.replace(_MARK, " ").encode())) > 1:
                    raise ValueError(f"piece {piece!r} spans units")
                rank += 1
                pieces.append(piece.replace(_MARK, " ").encode())
                log_p[i] = -SHARPNESS * np.log(rank + 1)
        if min(bytes_at) < 0:
            raise ValueError("the model has no byte fallback")
        return pieces, log_p, bytes_at

    def decode(self, encoded: list[np.ndarray]) -> list[bytes]:
        """Texts of sequences of piece ids; the blank put in front of each is taken off."""
        counts = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        ids = np.concatenate(encoded) if len(encoded) else np.zeros(0, dtype=np.int32)
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(self.begins[ids] - ends[:-1], size)
        data = self.bytes[at].tobytes()
        last = ends[np.cumsum(counts)]
        return [data[a + 1 : b] for a, b in zip([0, *last[:-1].tolist()], last.tolist())]


class _Places(dict):
    """First nodes of units; an unknown unit is noted in ``fresh`` and stands for minus its number."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, unit: bytes) -> int:
        self.fresh.append(unit)
        self[unit] = -len(self.fresh)
        return -len(self.fresh)


class Lattices:
    """Lattices of distinct units in one node space, edges in order of their node, long ones first."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.node_of = _Places()
        self.n_nodes = self.n_edges = self.n_units = 0
        # Grown by a quarter; only the first n_nodes and n_edges entries count.
        self.first, self.degree = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
        self.target, self.piece = np.zeros(1 << 17, dtype=np.int32), np.zeros(1 << 17, dtype=np.int32)
        # Log probability of an edge at its node, and share of the node's edges up to it.
        self.log_q, self.upto = np.zeros(1 << 17, dtype=np.float32), np.zeros(1 << 17, dtype=np.float32)

    def held(self) -> int:
        """Bytes of all edges, nodes and units (a unit of n bytes has n + 1 nodes)."""
        return EDGE_BYTES * self.n_edges + (NODE_BYTES + 1) * self.n_nodes + UNIT_BYTES * self.n_units

    def _append(self, name: str, used: int, values: np.ndarray) -> None:
        array = getattr(self, name)
        if used + len(values) > len(array):
            grown = np.zeros((used + len(values)) * 5 // 4, dtype=array.dtype)
            grown[:used] = array[:used]
            setattr(self, name, grown)
            array = grown
        array[used : used + len(values)] = values

    def add(self, units: list[bytes]) -> None:
        """Build the lattices of new units; a unit of n bytes has nodes 0 to n."""
        vocabulary = self.vocabulary
        data = np.frombuffer(b"".join(units), dtype=np.uint8)
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        unit_of = np.repeat(np.arange(len(units)), lengths)
        ends = np.cumsum(lengths)[unit_of]
        left = ends - np.arange(len(data))  # bytes up to the unit's end
        # An edge as one number that sorts by source, then longest first: source, length, piece.
        piece_bits, length_bits = len(vocabulary.pieces).bit_length(), max(vocabulary.index).bit_length()
        longest = (1 << length_bits) - 1

        def packed(at: np.ndarray, length: int, piece: np.ndarray) -> np.ndarray:
            return (((at << length_bits) + (longest - length)) << piece_bits) + piece

        edges = []
        single = np.zeros(len(data), dtype=bool)
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        for begin in range(0, len(data), 1 << 20):
            # A part of the bytes; pieces are short, so it is hashed with some bytes beyond its end.
            sums = prefix_sums(data[begin : begin + (1 << 20) + 64])
            inside = heads[(heads >= begin) & (heads < begin + (1 << 20))]
            for length, (keys, ids, present) in vocabulary.index.items():
                at = inside[left[inside] >= length]
                if not len(at):
                    continue
                hashes = span_hashes(sums, at - begin, at - begin + length)
                maybe = np.flatnonzero(present[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
                where = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
                good = keys[where] == hashes[maybe]
                at, where = at[maybe[good]], where[good]
                edges.append(packed(at, length, ids[where]))
                single[at[width[at] == length]] = True
        # Bytes of characters that have no piece.
        owner = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
        alone = np.flatnonzero(~single[owner])
        edges.append(packed(alone, 1, vocabulary.bytes_at[data[alone]]))
        edge = np.sort(np.concatenate(edges))
        piece = edge & ((1 << piece_bits) - 1)
        source = edge >> (length_bits + piece_bits)
        target = source + longest - ((edge >> piece_bits) & longest)
        log_p, ending = vocabulary.log_p[piece], target == ends[source]
        # Total log probability from a node to its unit's end, from the end on.
        level = left[source]
        if level.max(initial=0) < 1 << 16:
            level = level.astype(np.uint16)  # sorted by digits
        order = np.argsort(level, kind="stable")
        beta = np.full(len(data) + 1, -np.inf)
        s, t, w, e = source[order], target[order], log_p[order], ending[order]
        cuts = np.searchsorted(level[order], np.arange(1, int(level.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            values = w[a:b] + np.where(e[a:b], 0.0, beta[t[a:b]])
            new = np.flatnonzero(np.concatenate([[True], s[a + 1 : b] != s[a : b - 1]]))
            beta[s[a:b][new]] = np.logaddexp.reduceat(values, new)
        log_q = log_p + np.where(ending, 0.0, beta[target]) - beta[source]
        # Node numbers: a unit's end node follows its last byte; as a target it is -1.
        base = self.n_nodes
        degree = np.bincount(source + unit_of[source], minlength=len(data) + len(units))
        last = np.cumsum(degree[degree > 0]) - 1
        share = np.cumsum(np.exp(log_q))
        upto = share - np.repeat(np.concatenate([[0.0], share[last[:-1]]]), degree[degree > 0])
        upto[last] = 2.0  # beyond every draw
        self._append("first", base, self.n_edges + np.cumsum(degree) - degree)
        self._append("degree", base, degree)
        self._append("target", self.n_edges, np.where(ending, -1, base + target + unit_of[source]))
        self._append("piece", self.n_edges, piece)
        self._append("log_q", self.n_edges, log_q)
        self._append("upto", self.n_edges, upto)
        self.n_nodes += len(degree)
        self.n_edges += len(piece)
        self.n_units += len(units)
        starts = base + np.cumsum(lengths) - lengths + np.arange(len(units))
        self.node_of.update(zip(units, starts.tolist()))

    def nodes(self, units: list[bytes]) -> np.ndarray:
        if self.held() > CACHE_BYTES:
            self.clear()
            give_back()
        known = self.node_of
        nodes = np.fromiter(map(known.__getitem__, units), dtype=np.int64, count=len(units))
        if known.fresh:
            fresh, known.fresh = known.fresh, []
            try:
                self.add(fresh)
            except BaseException:  # the units noted have no lattice
                self.clear()
                raise
            first = np.fromiter(map(known.__getitem__, fresh), dtype=np.int64, count=len(fresh))
            new = nodes < 0
            nodes[new] = first[-1 - nodes[new]]
        return nodes


_REST = np.uint64(0x9E3779B97F4A7C15)
_STEPS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SAMPLES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
#: A Gumbel draw of :func:`_gumbel` lies between -3.7 and 36.8: what lies further behind cannot win.
_REACH = 45.0
#: How far below its start a text is looked at first for nodes to go on from.
_DEPTH = 80.0


def _uniform(x: np.ndarray) -> np.ndarray:
    # 53 bits: as signed numbers they are the same and convert faster.
    out = (mix(x) >> np.uint64(11)).view(np.int64).astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


def _gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_uniform(x)))


class _Walk:
    """One descent of many documents: chosen edges per occurrence, and the nodes they left.

    Which child wins does not depend on the score it inherits, so the winner is drawn by the
    children's shares alone; what its siblings score at best is drawn later, where it can matter.
    """

    def __init__(self, lattices: Lattices, noise: np.ndarray, node: np.ndarray):
        edges, owners = [], []
        active, at, step = np.arange(len(node)), node, 0
        while True:
            ongoing = at >= 0
            if not ongoing.all():
                active, at = active[ongoing], at[ongoing]
            if not len(active):
                break
            draw = _uniform(noise[active] + _STEPS[step % len(_STEPS)] * np.uint64(1 + step // len(_STEPS)))
            edge = lattices.first[at]
            beyond = np.flatnonzero(draw >= lattices.upto[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[draw[beyond] >= lattices.upto[edge[beyond]]]
            edges.append(edge)
            owners.append(active)
            at = lattices.target[edge]
            step += 1
        self.counts = np.zeros(len(node), dtype=np.int64)
        for k, active in enumerate(owners):
            self.counts[active] = k + 1
        self.offsets = np.cumsum(self.counts) - self.counts
        self.edges = np.zeros(int(self.counts.sum()), dtype=np.int32)
        for k, (active, edge) in enumerate(zip(owners, edges)):
            self.edges[self.offsets[active] + k] = edge
        sums = np.concatenate([[0.0], np.cumsum(lattices.log_q[self.edges], dtype=np.float64)])
        # Log probability of the edges before each one, and of all edges of an occurrence.
        self.before = sums[:-1]
        self.total = sums[self.offsets + self.counts] - sums[self.offsets]


def _best_child(lattices: Lattices, noise: np.ndarray, nodes: list[tuple], number: int) -> tuple:
    """Take the best child left off the best of ``nodes``: score, sample, occurrence, step, edge, before.

    The child is drawn by the shares of those not taken; the others stay, cut off at its score.
    """
    g, parent, occ, step, node, taken, before = nodes.pop(0)
    first = int(lattices.first[node])
    left = [e for e in range(first, first + int(lattices.degree[node])) if e not in taken]
    shares = [math.exp(lattices.log_q[e]) for e in left]
    salt = mix(noise[occ : occ + 1] + _SAMPLES[number]) + np.uint64(step)
    draw, again = _uniform(np.concatenate([salt, salt ^ _REST])).tolist()
    k, draw = 0, draw * sum(shares)
    while k < len(left) - 1 and draw >= shares[k]:
        draw -= shares[k]
        k += 1
    rest = sum(shares[:k]) + sum(shares[k + 1 :])
    if rest > 0:
        score = -float(np.logaddexp(-g, -(before + math.log(rest) - math.log(-math.log(again)))))
        nodes.append((score, parent, occ, step, node, (*taken, left[k]), before))
        nodes.sort(key=lambda y: -y[0])
    return g, parent, occ, step, left[k], before


def sample(texts: list[bytes], keys: np.ndarray, lattices: Lattices, samples: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text up to ``samples`` distinct segmentations: piece ids, log probability, inclusion."""
    if samples > len(_SAMPLES):
        raise ValueError(f"at most {len(_SAMPLES)} samples")
    units: list[bytes] = []
    counts = []
    for text in texts:
        own = _UNIT.findall(b" " + text)
        units += own
        counts.append(len(own))
    n = len(texts)
    counts = np.array(counts, dtype=np.int64)
    starts = lattices.nodes(units)
    bounds = np.cumsum(counts) - counts
    doc_of = np.repeat(np.arange(n), counts)
    place = (np.arange(len(units)) - bounds[doc_of]).astype(np.uint64)
    noise = mix(keys)[doc_of] + mix(place * np.uint64(0xA0761D6478BD642F) + np.uint64(1))
    root = _gumbel(mix(keys) + np.uint64(12345))
    found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in range(n)]
    # Per text the nodes to go on from: score of the best child not taken yet, sample that came by,
    # occurrence, step, node, edges taken, log probability of what lies before.
    open_: list[list[tuple]] = [[] for _ in range(n)]
    paths: list[list[np.ndarray]] = [[] for _ in range(n)]  # pieces of each sample
    piece_at: list[list[np.ndarray]] = [[] for _ in range(n)]  # where each occurrence's pieces begin
    live = np.arange(n)
    for number in range(samples):
        heads: dict[int, tuple] = {}
        if number == 0:
            node = starts
            prefix, score = np.zeros(n), root
            walk_docs, occ = doc_of, np.arange(len(units))
        else:
            for d in live.tolist():
                if open_[d]:
                    heads[d] = _best_child(lattices, noise, open_[d], number)
            live = np.array(sorted(heads), dtype=np.int64)
            if not len(live):
                break
            begin = np.array([heads[d][2] for d in live.tolist()], dtype=np.int64)
            size = (bounds + counts)[live] - begin
            first = np.cumsum(size) - size
            occ = np.repeat(begin - first, size) + np.arange(int(size.sum()))
            node = starts[occ]
            prefix, score = np.zeros(n), np.zeros(n)
            for k, d in zip(first.tolist(), live.tolist()):
                g, _, _, _, edge, before = heads[d]
                node[k] = lattices.target[edge]
                prefix[d] = before + float(lattices.log_q[edge])
                score[d] = g
            walk_docs = doc_of[occ]
        walk = _Walk(lattices, noise[occ] + _SAMPLES[number], node)
        # Log probability of everything before each occurrence.
        sums = np.concatenate([[0.0], np.cumsum(walk.total)])
        first_of = np.searchsorted(walk_docs, np.arange(n))
        last_of = np.searchsorted(walk_docs, np.arange(n), side="right")
        ahead = sums[:-1] - sums[first_of[walk_docs]] + prefix[walk_docs]
        log_p = sums[last_of] - sums[first_of] + prefix
        # The nodes passed, by the best score among the children that did not win: a Gumbel variable
        # around their common log probability, cut off at the score that came in.
        # Only nodes near the likeliest ones can give it; most texts need just their first words.
        deep = prefix - _DEPTH
        while True:
            at_occ = np.flatnonzero(ahead >= deep[walk_docs])
            size = walk.counts[at_occ]
            a = np.repeat(at_occ, size)
            passed = np.arange(len(a)) + np.repeat(walk.offsets[at_occ] - (np.cumsum(size) - size), size)
            d, step = walk_docs[a], passed - walk.offsets[a]
            came_from = np.where(step == 0, node[a], lattices.target[walk.edges[passed - 1]])
            at_log = ahead[a] + walk.before[passed] - walk.before[walk.offsets[a]]
            log_q = lattices.log_q[walk.edges[passed]].astype(np.float64)
            rest = np.where(lattices.degree[came_from] > 1, np.log(-np.expm1(np.minimum(log_q, -1e-15))), -np.inf)
            location = at_log + rest
            # What the needed number of nodes reaches per text; none far below can beat those.
            least, bar = location.copy(), np.full(n, -np.inf)
            for _ in range(samples - number):
                bar[:] = -np.inf
                np.maximum.at(bar, d, least)
                least[least == bar[d]] = -np.inf
            short = np.isfinite(deep) & (bar - _REACH < deep)
            if not short.any():
                break
            deep[short] = -np.inf
        near = np.flatnonzero((location >= bar[d] - _REACH) & np.isfinite(location))
        a, d, step, passed, came_from, at_log, location = (x[near] for x in (a, d, step, passed, came_from, at_log, location))
        salt = (noise[occ[a]] + _SAMPLES[number] + _STEPS[step % len(_STEPS)] * (1 + step // len(_STEPS)).astype(np.uint64)) ^ _REST
        g = -np.logaddexp(-score[d], -(location + _gumbel(salt)))
        order = np.lexsort((passed, -g, d))
        begins = np.searchsorted(d[order], np.arange(n + 1))
        for x in live.tolist():
            for i in order[begins[x] : min(begins[x] + samples - number, begins[x + 1])].tolist():
                # In the first occurrence of a later sample, steps count from where it left the other.
                skipped = heads[x][3] + 1 if number and a[i] == first_of[x] else 0
                edge = int(walk.edges[passed[i]])
                open_[x].append((float(g[i]), number, int(occ[a[i]]), int(step[i]) + skipped, int(came_from[i]), (edge,), float(at_log[i])))
            open_[x] = sorted(open_[x], key=lambda y: -y[0])[: samples - number]
        piece_first = np.append(walk.offsets, len(walk.edges))
        chosen = lattices.piece[walk.edges]
        for x in live.tolist():
            lo, hi = int(first_of[x]), int(last_of[x])
            new = chosen[piece_first[lo] : piece_first[hi]]
            at = walk.offsets[lo:hi] - (walk.offsets[lo] if hi > lo else 0)
            if number:
                _, parent, at_occ, at_step, at_edge, _ = heads[x]
                k = at_occ - int(bounds[x])
                cut = int(piece_at[x][parent][k]) + at_step
                new = np.concatenate([paths[x][parent][:cut], lattices.piece[at_edge : at_edge + 1], new])
                at = np.concatenate([piece_at[x][parent][: k + 1], at[1:] + cut + 1])
            paths[x].append(new)
            piece_at[x].append(at)
            found[x].append((new, float(log_p[x]), 1.0))
    for x in range(n):
        if open_[x]:
            edge_score = open_[x][0][0]
            found[x] = [(p, lp, float(-np.expm1(-np.exp(min(lp - edge_score, 700.0))))) for p, lp, _ in found[x]]
    return found


#: The lattices of this worker, kept from task to task: those of the last vocabulary used.
_kept: dict[str, Lattices] = {}


def _lattices(model: tuple[str, tuple]) -> Lattices:
    name, parts = model
    if name not in _kept:
        _kept.clear()
        _kept[name] = Lattices(Vocabulary(*parts))
    return _kept[name]


def _named_model(path: str) -> tuple[str, tuple]:
    pieces, log_p, bytes_at = Vocabulary.load(path)
    digest = hashlib.sha256(log_p.tobytes() + repr((pieces, bytes_at)).encode())
    return digest.hexdigest(), (pieces, log_p, bytes_at)


def _encode(broadcast, samples: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        lattices = _lattices(broadcast.value)
        vocabulary = lattices.vocabulary

        def flush(rows: list, texts: list[bytes], keys: list[int]) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(7)]
            sampled = sample(texts, np.array(keys, dtype=np.uint64), lattices, samples)
            back = iter(vocabulary.decode([ids for found in sampled for ids, _, _ in found]))
            for row, text, found in zip(rows, texts, sampled):
                for number, (ids, log_p, inclusion) in enumerate(found, 1):
                    decoded = next(back)
                    digest = None if with_ids else hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                    values = (row, number, len(ids), round(log_p, 6), inclusion, ids if with_ids else digest, decoded == text)
                    for column, value in zip(out, values):
                        column.append(value)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.float64()), pa.array(out[4], pa.float64()),
                    pa.array(out[5], pa.list_(pa.int32()) if with_ids else pa.string()), pa.array(out[6], pa.bool_()),
                ],
                ["doc_id", "sample", "n_pieces", "log_p", "inclusion", "ids", "lossless"],
            )

        rows, texts, keys, size = [], [], [], 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for doc, text, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                rows.append(doc)
                texts.append(text or b"")
                keys.append(key % (1 << 64))
                size += len(texts[-1]) + 64
                if size >= CHUNK_BYTES:
                    yield flush(rows, texts, keys)
                    rows, texts, keys, size = [], [], [], 0
        if rows:
            yield flush(rows, texts, keys)

    return run


def sampled_encodings(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, seed: int = 17, with_ids: bool = True) -> DataFrame:
    """Per document and sample: ``doc_id, sample, n_pieces, log_p, inclusion, ids, lossless``.

    ``ids`` are the piece ids, or with ``with_ids=False`` the SHA-256 of their little-endian form.
    ``lossless`` says that decoding gave the text back.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(_named_model(model))
    source = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("key")
    )
    kind = T.ArrayType(T.IntegerType()) if with_ids else T.StringType()
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("sample", T.IntegerType()), T.StructField("n_pieces", T.LongType()),
        T.StructField("log_p", T.DoubleType()), T.StructField("inclusion", T.DoubleType()), T.StructField("ids", kind),
        T.StructField("lossless", T.BooleanType()),
    ])
    return source.mapInArrow(_encode(vocabulary, samples, with_ids), schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with ``ids`` replaced by the ``text`` they stand for; null ids give null."""
    broadcast = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*broadcast.value)
        for batch in batches:
            ids = [None if x is None else np.array(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
            back = iter(vocabulary.decode([x for x in ids if x is not None]))
            texts = [None if x is None else next(back) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "text"])

    carried = [c for c in encoded.columns if c != "ids"]
    source = encoded.select(F.struct(*carried).alias("row"), "ids")
    rows = source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("text", T.StringType())]))
    return rows.select("row.*", "text")
