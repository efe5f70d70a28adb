"""Suffix order of a shard by induced sorting, for strings that repeat over a fixed length.

Within memory, suffixes are sorted by induction: suffixes that begin a descent (leftmost S) are
named and ordered on a reduced string, the others follow from them through one queue per character,
in the order in which their successors come. A shard larger than memory is cut into pieces; each
piece's order is spilled as a run of tuples (the first ``length`` bytes, document, place), and a
priority queue over the runs carries tuples and common-prefix values in suffix order.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes sorted in memory at once.
PIECE_BYTES = 2 << 20


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor (type S); the last one is the smallest."""
    n = len(text)
    rises = np.empty(n, dtype=bool)
    rises[:-1] = text[:-1] < text[1:]
    rises[-1] = True
    decided = np.empty(n, dtype=bool)
    decided[:-1] = text[:-1] != text[1:]
    decided[-1] = True
    where = np.where(decided, np.arange(n), n)
    return rises[np.minimum.accumulate(where[::-1])[::-1]]


def _split(places: np.ndarray, text: np.ndarray, queues: dict[int, list[np.ndarray]]) -> None:
    """Append places to the queues of their characters, in order."""
    if not len(places):
        return
    chars = text[places]
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order]
    cuts = np.flatnonzero(np.concatenate([[True], sorted_chars[1:] != sorted_chars[:-1]]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        queues.setdefault(int(sorted_chars[a]), []).append(places[order[a:b]])


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Suffix order from the order of the leftmost S suffixes."""
    alphabet = np.unique(text).tolist()
    by_char: dict[int, list[np.ndarray]] = {}
    _split(seeds, text, by_char)
    larger: dict[int, list[np.ndarray]] = {}
    for c in alphabet:
        queue, at = larger.setdefault(c, []), 0
        while at < len(queue):  # grows while suffixes of the same character are induced
            before = queue[at] - 1
            before = before[before >= 0]
            _split(before[~small[before]], text, larger)
            at += 1
        for places in by_char.get(c, []):
            before = places - 1
            before = before[before >= 0]
            _split(before[~small[before]], text, larger)
    lower: dict[int, list[np.ndarray]] = {}
    for c in reversed(alphabet):
        queue, at = lower.setdefault(c, []), 0
        if c == alphabet[0] and not queue:
            queue.append(np.array([len(text) - 1]))
        while at < len(queue):
            before = queue[at] - 1
            before = before[before >= 0]
            _split(before[small[before]], text, lower)
            at += 1
        for places in reversed(larger.get(c, [])):
            before = places[::-1] - 1
            before = before[before >= 0]
            _split(before[small[before]], text, lower)
    parts = []
    for c in alphabet:
        parts += larger[c]
        parts += [x[::-1] for x in reversed(lower[c])]
    return np.concatenate(parts)


def _ranks_of_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    order = np.lexsort((second, first))
    new = np.concatenate([[0], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes, right at least as far as their first ``depth`` characters.

    ``text`` ends with a character smaller than all others.
    """
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1]
    small = _types(text)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = _induce(text, small, starts)
    rank_of = np.zeros(n, dtype=bool)
    rank_of[starts] = True
    sorted_starts = order[rank_of[order]]
    # Name the substrings between leftmost S suffixes: equal if length and all characters are.
    ends = np.append(starts[1:], n - 1)
    length_of = np.zeros(n, dtype=np.int64)
    length_of[starts] = ends - starts + 1
    a, b = sorted_starts[:-1], sorted_starts[1:]
    same = length_of[a] == length_of[b]
    pending = np.flatnonzero(same)
    step = 0
    while len(pending):
        pending = pending[step < length_of[a[pending]]]
        differs = text[a[pending] + step] != text[b[pending] + step]
        same[pending[differs]] = False
        pending = pending[~differs]
        step += 1
    names = np.zeros(n, dtype=np.int64)
    names[sorted_starts] = np.concatenate([[0], np.cumsum(~same)])
    reduced = names[starts]
    # The reduced string's suffixes, by names of twice the reach at each level of recursion. Two
    # characters at least lie between leftmost S suffixes.
    reach = 1
    while reach * 2 <= depth + 2 and len(np.unique(reduced)) < len(reduced):
        ahead = np.concatenate([reduced[reach:] + 1, np.zeros(min(reach, len(reduced)), dtype=np.int64)])[: len(reduced)]
        reduced = _ranks_of_pairs(reduced, ahead)
        reach *= 2
    return _induce(text, small, starts[np.argsort(reduced, kind="stable")])


class _Piece:
    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, region: bytes, doc: int, place: int, length: int) -> None:
        windows = len(region) - length + 1
        self.parts.append(region)
        self.docs.append(np.where(np.arange(len(region) + 1) < windows, doc, np.iinfo(np.int64).min))
        self.places.append(np.arange(place, place + len(region) + 1))
        self.size += len(region) + 1

    def sorted(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """In suffix order, for places where ``length`` bytes follow: bytes (as a view), document,
        place, and whether the first ``length`` bytes equal those of the predecessor."""
        raw = np.frombuffer(b"\0".join([*self.parts, b""]) + b"\0" * length, dtype=np.uint8)
        n = self.size
        text = raw[:n].astype(np.int16) + 2
        ends = np.cumsum([len(x) + 1 for x in self.parts]) - 1
        text[ends] = 1
        text = np.append(text, np.int16(0))
        order = suffix_order(text, length)
        docs, places = np.concatenate(self.docs), np.concatenate(self.places)
        order = order[order < n]
        order = order[docs[order] != np.iinfo(np.int64).min]
        windows = np.lib.stride_tricks.sliding_window_view(raw, length)
        same = np.zeros(len(order), dtype=bool)
        for k in range(1, len(order), 1 << 16):
            now = order[k : k + (1 << 16)]
            same[k : k + len(now)] = (windows[now] == windows[order[k - 1 : k - 1 + len(now)]]).all(1)
        return order, docs[order], places[order], same


def repeats(regions: Iterator[tuple[bytes, int, int]], length: int, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, places) of all ``length``-byte strings in ``regions`` (bytes, document, place of
    the first byte) that also start at a smaller document or place."""
    piece, runs = _Piece(), []
    for region, doc, place in regions:
        piece.add(region, doc, place, length)
        if piece.size >= piece_bytes:
            runs.append(_spill(piece, length))
            piece = _Piece()
    if not runs:
        if piece.size:
            _, docs, places, same = piece.sorted(length)
            yield _later(docs, places, np.cumsum(~same))
        return
    if piece.size:
        runs.append(_spill(piece, length))
    docs, places, groups, group, last = [], [], [], 0, None
    for window, doc, place in heapq.merge(*[_read(run, length) for run in runs]):
        if window != last:
            if len(docs) >= 1 << 16:
                yield _later(np.array(docs), np.array(places), np.array(groups))
                docs, places, groups = [], [], []
            group, last = group + 1, window
        elif len(docs) >= 1 << 20:  # a huge group: its first member is its smallest
            yield _later(np.array(docs), np.array(places), np.array(groups))
            docs, places, groups = [docs[0]], [places[0]], [group]
            docs[0], places[0] = first
        if not groups or groups[-1] != group:
            first = (doc, place)
        docs.append(doc)
        places.append(place)
        groups.append(group)
    yield _later(np.array(docs), np.array(places), np.array(groups))


def _later(docs: np.ndarray, places: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of groups without the first of each."""
    if not len(docs):
        return docs, places
    order = np.lexsort((places, docs, groups))
    rest = np.concatenate([[False], groups[order][1:] == groups[order][:-1]])
    # A place that is given twice is no repeat of itself.
    own = np.concatenate([[True], (docs[order][1:] != docs[order][:-1]) | (places[order][1:] != places[order][:-1])])
    first = np.maximum.accumulate(np.where(~rest, np.arange(len(order)), 0))
    not_first = (docs[order] != docs[order][first]) | (places[order] != places[order][first])
    keep = order[rest & own & not_first]
    return docs[keep], places[keep]


def _spill(piece: _Piece, length: int):
    """A run on disk: tuples in suffix order, equal strings by document and place."""
    raw = b"\0".join([*piece.parts, b""]) + b"\0" * length
    order, docs, places, same = piece.sorted(length)
    inner = np.lexsort((places, docs, np.cumsum(~same)))
    run = tempfile.TemporaryFile()
    for i in inner.tolist():
        at = int(order[i])
        run.write(raw[at : at + length] + int(docs[i]).to_bytes(8, "big", signed=True) + int(places[i]).to_bytes(8, "big"))
    run.seek(0)
    return run


def _read(run, length: int) -> Iterator[tuple[bytes, int, int]]:
    size = length + 16
    while block := run.read(size * 4096):
        for k in range(0, len(block), size):
            yield (
                block[k : k + length], int.from_bytes(block[k + length : k + length + 8], "big", signed=True),
                int.from_bytes(block[k + length + 8 : k + size], "big"),
            )
