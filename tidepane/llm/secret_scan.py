"""Secret scans (operator 11): fixed kinds by pattern, others by two character Markov models.

Texts are cut into pieces (runs of letters and digits). Labelled samples come from the texts: pieces
inside values of base spans are random strings; numbers, and pieces that stand after different texts,
are ordinary identifiers, as a secret stands in one place and its copies. What is seen both inside
and outside of base values is left out. Each distinct piece counts once, so frequent words weigh no
more than others; ordinary ones count in capitals, too. Two Markov models of order ``ORDER`` are counted over all samples, the shorter contexts
standing in for unseen ones (Witten-Bell). A piece is a secret if its log-likelihood ratio, random
over ordinary, reaches ``LEAST`` in total and ``LEAST_EACH`` per character, and has ``LEAST_SIGNS``
different characters (a drawn-out letter is rare in both models, but not random). Neighbouring
secret pieces joined by one of ``JOINERS`` are one span, of the kind ``random``; what touches a base
span is not added again.

All texts train and all are scanned. What the driver holds are counts by context and character,
bounded by the alphabet.

Defined results: null text counts as empty; without random or without ordinary samples nothing is
added; rows that repeat are judged alike; null ids are kept; an empty table gives no rows; other
columns are not read; texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.sources.shared import stage

#: Base kinds in the order of the contract.
KINDS = ("assign", "access", "hex")
ADDED = "random"
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
PIECE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{8,}")
JOINERS = "+/_=-"
#: Characters before a piece that tell one place from another.
BEFORE = 12

ORDER = 2
#: Share of all signs, evenly, in the random model: secrets may use other signs than the samples.
EVEN = 0.5
LEAST = 20.0
LEAST_EACH = 1.0
LEAST_SIGNS = 6
#: Distinct pieces whose scores a Python worker keeps.
CACHE_PIECES = 500_000

_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: The start of a piece is a sign of its own, 0.
_BASE = len(_SIGNS) + 1
_CODE = np.zeros(256, dtype=np.int64)
_CODE[np.frombuffer(_SIGNS.encode(), dtype=np.uint8)] = np.arange(1, _BASE)
_KEYWORDS = ("password", "passwd", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """``start, kind, stop`` and the span of the value, by start and kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _pieces(text: str, base: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[str, int, int, bool, bool]]:
    """``piece, start, stop, touches a base span, lies in a base value``."""
    spans, values = _joined([(s, e) for s, _, e, _, _ in base]), _joined([(s, e) for *_, s, e in base])
    i = j = 0
    for m in PIECE.finditer(text):
        start, stop = m.span()
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        while j < len(values) and values[j][1] <= start:
            j += 1
        touches = i < len(spans) and spans[i][0] < stop
        inside = j < len(values) and values[j][0] <= start and stop <= values[j][1]
        yield m[0], start, stop, touches, inside


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pieces of a batch: least and greatest hash of what stands before, and of the label."""
    for batch in batches:
        seen: dict[str, tuple[int, int, bool, bool]] = {}
        for text in batch.column(0).to_pylist():
            for piece, start, _, touches, inside in _pieces(text, base_spans(text)) if text else ():
                if inside or not touches:
                    before = zlib.crc32(text[max(0, start - BEFORE) : start].encode())
                    least, most, ever, always = seen.get(piece, (before, before, inside, inside))
                    seen[piece] = (min(least, before), max(most, before), ever or inside, always and inside)
        columns = [list(seen), *(zip(*seen.values()) if seen else ([], [], [], []))]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["piece", "least", "most", "ever", "always"])


def samples(docs: DataFrame) -> DataFrame:
    """``piece, random``: the distinct labelled samples of all texts."""
    seen = docs.select("text").mapInArrow(_samples, "piece string, least bigint, most bigint, ever boolean, always boolean")
    ordinary = ~F.col("ever") & (F.col("piece").rlike("^[0-9]+$") | (F.col("least") < F.col("most")))
    return (
        seen.groupBy("piece").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("ever").alias("ever"), F.min("always").alias("always"))
        .where(F.col("always") | ordinary).select("piece", F.col("always").alias("random"))
    )


def _cells(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and characters as one number per place, and where each piece begins."""
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    # Every piece after ORDER starting signs; those places are no characters of it.
    padded = ("\0" * ORDER).join(["", *pieces]).encode()
    codes = _CODE[np.frombuffer(padded, dtype=np.uint8)]
    cells = np.zeros(len(codes), dtype=np.int64)
    for back in range(ORDER, -1, -1):
        cells = cells * _BASE + np.r_[np.zeros(back, dtype=np.int64), codes[: len(codes) - back]]
    return cells[codes > 0], np.cumsum(lengths) - lengths


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, _BASE ** (ORDER + 1)), dtype=np.int64)
    for batch in batches:
        random = batch.column("random").to_numpy(zero_copy_only=False)
        pieces = batch.column("piece").to_pylist()
        for label in (0, 1):
            part = [p for p, r in zip(pieces, random) if r == bool(label)]
            if not label:  # words in capitals are as ordinary
                part += [p.upper() for p in part if not p.isupper() and not p.isdigit()]
            if part:
                np.add.at(total[label], _cells(part)[0], 1)
    label, cell = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label == 1), pa.array(cell), pa.array(total[label, cell])], ["random", "cell", "n"]
    )


def _model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a character after its context, by Witten-Bell interpolation."""
    counts = counts.reshape((_BASE,) * (ORDER + 1)).astype(np.float64)
    known = np.full(_BASE, 1.0 / len(_SIGNS))
    for order in range(ORDER + 1):
        seen = counts.sum(axis=tuple(range(ORDER - order)))
        n, kinds = seen.sum(axis=-1, keepdims=True), (seen > 0).sum(axis=-1, keepdims=True)
        with np.errstate(invalid="ignore"):
            known = np.where(n > 0, (seen + kinds * known) / np.maximum(n + kinds, 1), known)
    return np.log(known).reshape(-1)


class Models:
    """The ratio of both models for every context and character."""

    def __init__(self, counts: np.ndarray):
        random = np.logaddexp(np.log1p(-EVEN) + _model(counts[1]), np.log(EVEN / len(_SIGNS)))
        self.ratio = (random - _model(counts[0])).astype(np.float32)

    def ratios(self, pieces: list[str]) -> np.ndarray:
        cells, starts = _cells(pieces)
        return np.add.reduceat(self.ratio[cells].astype(np.float64), starts) if pieces else np.empty(0)

    def secret(self, pieces: list[str]) -> np.ndarray:
        ratio = self.ratios(pieces)
        likely = (ratio >= LEAST) & (ratio >= LEAST_EACH * np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        for i in np.flatnonzero(likely).tolist():
            likely[i] = len(set(pieces[i])) >= LEAST_SIGNS
        return likely


def count_models(labelled: DataFrame) -> Models | None:
    """Sums over all samples; None if one of the kinds has none."""
    counted = labelled.select("piece", "random").mapInArrow(_counts, "random boolean, cell bigint, n bigint")
    table = counted.groupBy("random", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, _BASE ** (ORDER + 1)), dtype=np.int64)
    counts[table["random"].to_numpy().astype(np.int64), table["cell"].to_numpy()] = table["n"].to_numpy()
    return Models(counts) if counts.sum(axis=1).all() else None


def train(docs: DataFrame) -> Models | None:
    return count_models(stage(samples(docs), "secret-samples"))


def _merged(spans: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in spans:
        if out and start == out[-1][1] + 1 and text[out[-1][1]] in JOINERS:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


SPANS = "array<struct<start:bigint,kind:string,stop:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())]))


def _scan(models: Models | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, bool] = {}
        for batch in batches:
            base_of, added_of = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                free = [(p, s, e) for p, s, e, touches, _ in _pieces(text, base) if not touches] if models else []
                new = list({p for p, _, _ in free if p not in cache})
                if len(cache) + len(new) > CACHE_PIECES:
                    cache.clear()
                    new = list({p for p, _, _ in free})
                if new:
                    cache.update(zip(new, models.secret(new).tolist()))
                base_of.append([{"start": s, "kind": KINDS[k], "stop": e} for s, k, e, _, _ in base])
                secret = _merged([(s, e) for p, s, e in free if cache[p]], text)
                added_of.append([{"start": s, "kind": ADDED, "stop": e} for s, e in secret])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_of, _SPANS), pa.array(added_of, _SPANS)], ["doc_id", "base", "added"])

    return run


def find_secrets(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """``doc_id, base, added``: spans ``start, kind, stop`` in code points, end exclusive. Models are
    trained on the same texts unless given."""
    models = models or train(docs)
    source = docs.select("doc_id", "text")
    return source.mapInArrow(_scan(models), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, base {SPANS}, added {SPANS}")


def joined_spans(spans: str | Column) -> Column:
    """``kind:start:end`` by start and then kind in the order of the contract, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], F.array_position(kinds, x["kind"]).alias("no"), x["kind"], x["stop"])))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``."""
    counts = [_number_of(kind).alias(f"n_{kind}") for kind in KINDS]
    return find_secrets(docs).select(
        "doc_id", *counts, F.sha2(joined_spans("base").cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_random"),
    )
