"""Toxicity (operator 3): a subsequence string kernel with Nyström landmarks and a linear SVM.

Two terms are similar when they share subsequences of characters, each weighted by ``DECAY`` to the
length it spans, so a gap or an inserted character lowers the similarity instead of ending it. The
kernel, normalised, is evaluated against a few landmark terms; the Nyström map turns these values
into features, and a linear support vector machine (squared hinge loss, Newton steps) separates terms
of toxic sentences from others. A text is as toxic as its worst term. Terms are the words of the
whole text without outer punctuation, and single characters written apart, joined.

Labels are per document, so sentences are labelled first: of a toxic document only the sentences
with its most telling terms are toxic. Fitting reads at most ``SAMPLE_DOCS`` labelled documents of
each label, of at most ``SAMPLE_CHARS`` characters; scoring reads every text in full, and each
distinct term is evaluated once per Python worker while a cache of bounded size holds it.

Defined results: null text counts as empty; a text without terms has the score of the least toxic
term; null labels and ids do not train; without toxic or without other training rows every score is
0; repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepane.llm.tables import held_out

SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
LANDMARKS = 96
SUBSEQUENCE = 3
#: Most characters that a subsequence may span.
SPAN = 5
DECAY = 0.6
RIDGE = 1e-5
#: Terms whose values a Python worker keeps.
CACHE_TERMS = 600_000
#: Longer terms are cut into overlapping pieces of this length.
PIECE = 16

_OUTER = " \t\r\n\f\v.,;:!?\"'()[]{}<>|*#$%&_-+=/\\~`^@…“”‘’«»¡¿"
_SINGLE = re.compile(r"(?<!\S)(?:\w[\W_]?[ \t]){2,}\w(?!\w)")


def terms(text: str) -> set[str]:
    text = text.lower()
    found = {w.strip(_OUTER) for w in set(text.split())}
    for run in _SINGLE.findall(text):
        letters = "".join(c for c in run if c.isalnum())
        found.update(letters[i : i + PIECE] for i in range(0, max(1, len(letters) - PIECE // 2), PIECE // 2))
    for word in [w for w in found if len(w) > PIECE]:
        found.discard(word)
        found.update(word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2))
    return {w for w in found if len(w) >= SUBSEQUENCE}


#: Distances of the second and third character of a subsequence from its first, and the weights.
_SHAPES = [(j, k, DECAY ** (k + 1)) for k in range(2, SPAN) for j in range(1, k)]
_TABLE = 1 << 20


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``words`` and character codes, with marks at both ends, of terms equally long."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(lengths):
        where = np.flatnonzero(lengths == length)
        for k in range(0, len(where), 4096):
            rows = where[k : k + 4096]
            text = "".join([f"\x01{words[i]}\x02" for i in rows.tolist()])
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield rows, codes.reshape(len(rows), length + 2).astype(np.uint64)


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For every gap pattern, the keys of all subsequences (terms x places) and their weight."""
    places = codes.shape[1]
    for j, k, weight in _SHAPES:
        if places > k:
            n = places - k
            yield (codes[:, :n] << np.uint64(42)) | (codes[:, j : j + n] << np.uint64(21)) | codes[:, k : k + n], weight


def _norm(places: int) -> float:
    """Square root of a term's kernel with itself, its subsequences taken as different."""
    return float(np.sqrt(sum(w * w * max(0, places - k) for _, k, w in _SHAPES)))


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


class TermModel:
    """Landmarks, their Nyström map, SVM weights and the slope to probabilities.

    The kernel is a sum over subsequences, so once trained the decision value is one, too: a
    weight per subsequence of the landmarks, kept in a hash table with its keys.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        found: dict[int, dict[int, float]] = {}
        for rows, codes in _by_length(landmarks):
            for keys, weight in _subsequences(codes):
                for m, own in zip(rows.tolist(), keys.tolist()):
                    for key in own:
                        column = found.setdefault(key, {})
                        column[m] = column.get(m, 0.0) + weight / _norm(codes.shape[1])
        self.keys = np.array(sorted(found), dtype=np.uint64)
        self.by_key = np.zeros((len(self.keys), len(landmarks)), dtype=np.float32)
        for i, key in enumerate(self.keys.tolist()):
            self.by_key[i, list(found[key])] = list(found[key].values())
        values, vectors = np.linalg.eigh(self.similarity(landmarks).astype(np.float64))
        good = values > 1e-3
        self.map = vectors[:, good] / np.sqrt(values[good])
        self.slope, self.offset = 1.0, 0.0
        self.train(np.zeros(int(good.sum())), 0.0)

    def similarity(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of terms and landmarks."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        for rows, codes in _by_length(words):
            for part in range(0, len(rows), 512):
                own = codes[part : part + 512]
                cells, weights = [], []
                for keys, weight in _subsequences(own):
                    at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                    i, j = np.nonzero(self.keys[at] == keys)
                    cells.append(i * len(self.keys) + at[i, j])
                    weights.append(np.full(len(i), weight))
                size = len(own) * len(self.keys)
                dense = np.bincount(np.concatenate(cells), weights=np.concatenate(weights), minlength=size)
                dense = dense.reshape(len(own), -1).astype(np.float32)
                out[rows[part : part + 512]] = dense @ self.by_key / _norm(codes.shape[1])
        return out

    def features(self, words: list[str]) -> np.ndarray:
        return self.similarity(words) @ self.map

    def train(self, weights: np.ndarray, bias: float) -> None:
        self.bias = bias
        self.values = self.by_key @ (self.map @ weights)
        self.present = np.zeros(_TABLE, dtype=bool)
        self.present[_slots(self.keys)] = True

    def decide(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for rows, codes in _by_length(words):
            total = np.zeros(len(rows))
            for keys, weight in _subsequences(codes):
                i, j = np.nonzero(self.present[_slots(keys)])
                found = keys[i, j]
                at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
                values = np.where(self.keys[at] == found, self.values[at], 0)
                total += weight * np.bincount(i, weights=values, minlength=len(rows))
            out[rows] = total / _norm(codes.shape[1])
        return out + self.bias

    def probability(self, worst: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30))))


def sentences_of(text: str) -> list[str]:
    return [x for x in re.split(r"[.!?\n]+(?=\s|$)", text) if x.strip()]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss: Newton steps on the examples inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag(np.append(np.full(x.shape[1] - 1, RIDGE), 1e-9))
    for step in range(40):
        inside = y * (x @ w) < 1
        part = x[inside] * weight[inside, None]
        new = np.linalg.solve(part.T @ x[inside] + ridge, part.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new if step == 0 else w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str, int]], seed: int = 11) -> TermModel | None:
    """Fit on (text, label) of a bounded sample."""
    toxic = [t for t, y in rows if y == 1]
    clean = [t for t, y in rows if y == 0]
    if not toxic or not clean:
        return None
    sets = [terms(t) for t in toxic]
    in_toxic, in_clean = Counter(w for s in sets for w in s), Counter(w for t in clean for w in terms(t))
    rate = len(toxic) / len(clean)

    def telling(word: str) -> float:
        return float(np.log((in_toxic[word] + 0.1) / (in_clean[word] * rate + 0.1)) * np.log1p(in_toxic[word]))

    # Sentences with the most telling terms carry the label; their terms are the positive examples.
    # A term tells something if it is in one of a hundred toxic texts at least.
    least = max(2, len(toxic) // 100)
    positive: set[str] = set()
    for text, words in zip(toxic, sets):
        known = [w for w in words if in_toxic[w] >= least]
        best = max(map(telling, known), default=0.0)
        for sentence in sentences_of(text) if best > 1 else []:
            positive.update(w for w in terms(sentence) & set(known) if telling(w) >= max(0.3 * best, 1.0))
    strong = sorted(positive, key=lambda w: (-telling(w), w))[:600]
    if not strong:
        return None
    rng = np.random.default_rng(seed)
    others = sorted(in_clean)
    weights = np.array([in_clean[w] for w in others], dtype=float) ** 0.5
    count = min(len(others), 4000)
    negative = [others[i] for i in rng.choice(len(others), count, replace=False, p=weights / weights.sum())]

    # Landmarks: telling terms that no chosen landmark resembles, and some frequent other terms.
    landmarks: list[str] = [strong[0]]
    closest = TermModel(landmarks).similarity(strong)[:, 0]
    while len(landmarks) < min(LANDMARKS * 2 // 3, len(strong)):
        gain = (1 - closest) * np.array([max(telling(w), 0) * in_toxic[w] ** 0.5 for w in strong])
        pick = int(gain.argmax())
        if gain[pick] <= 0.05:
            break
        landmarks.append(strong[pick])
        closest = np.maximum(closest, TermModel([strong[pick]]).similarity(strong)[:, 0])
    common = [w for w in sorted(in_clean, key=lambda w: (-in_clean[w], w)) if 4 <= len(w) <= 12 and w not in landmarks]
    landmarks += common[: LANDMARKS - len(landmarks)]

    model = TermModel(landmarks)
    # Telling terms also with a character put in or a separator between letters.
    noisy = {w[:k] + c + w[k:]: in_toxic[w] for w in strong[:80] for c in ("x", "-", "*") for k in range(1, len(w))}
    noisy |= {c.join(w): in_toxic[w] for w in strong[:80] for c in ("-", ".", "*")}
    noisy = {w: n for w, n in noisy.items() if len(w) <= PIECE and w not in in_clean}
    positives = [*strong, *noisy]
    # A term weighs as much as the documents that it tells.
    told_by = np.array([in_toxic[w] for w in strong], dtype=float)
    noise = np.array(list(noisy.values()), dtype=float)
    share = np.concatenate([0.35 * told_by / told_by.sum(), 0.15 * noise / max(noise.sum(), 1)])
    x_positive = model.features(positives)
    for _ in range(4):
        x = np.vstack([x_positive, model.features(negative)])
        y = np.concatenate([np.ones(len(positives)), -np.ones(len(negative))])
        weight = np.concatenate([share, np.full(len(negative), 0.5 / len(negative))])
        model.train(*_svm(x, y, weight))
        # The clean terms nearest to the wrong side join the examples.
        known = set(negative)
        values = model.decide(others)
        hard = [others[i] for i in np.argsort(-values, kind="stable")[:1500] if values[i] > -1 and others[i] not in known]
        if not hard:
            break
        negative += hard

    # From the worst term of each sampled document to a probability (two logistic parameters).
    values: dict[str, float] = {}
    every = sorted(set(in_toxic) | set(in_clean))
    values.update(zip(every, model.decide(every).tolist()))
    worst = np.array([max((values[v] for v in terms(t)), default=min(values.values())) for t, _ in rows])
    label = np.array([v for _, v in rows], dtype=float)
    balance = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * worst + c, -30, 30)))
        g = np.array([(balance * (p - label) * worst).sum() + 1e-4 * a, (balance * (p - label)).sum()])
        h = balance * p * (1 - p)
        hessian = np.array([[(h * worst * worst).sum() + 1e-4, (h * worst).sum()], [(h * worst).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hessian, g)
        move *= min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        a, c = a - move[0], c - move[1]
    model.slope, model.offset = float(a), float(c)
    return model


def _score(model: TermModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        least = min(model.decide(model.landmarks)) if model else 0.0
        for batch in batches:
            scores = []
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 200):
                part = [terms(t or "") if model else set() for t in texts[k : k + 200]]
                new = sorted(set().union(*part) - cache.keys()) if part else []
                if len(cache) + len(new) > CACHE_TERMS:
                    cache.clear()
                    new = sorted(set().union(*part))
                if new:
                    cache.update(zip(new, model.decide(new).tolist()))
                scores += [model.probability(max(map(cache.__getitem__, s), default=least)) if model else 0.0 for s in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample: of each label, the documents that come first by a hash of their id."""
    known = labels.where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).where("doc_id IS NOT NULL")
    ids = None
    for value in (0, 1):
        part = (
            known.where(F.col("toxic") == value).select("doc_id", "toxic")
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
        )
        ids = part if ids is None else ids.union(part)
    picked = docs.join(F.broadcast(ids.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    rows = picked.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text", "toxic").collect()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.text, r.toxic))]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted`` (1 if the score is at least 0.7)."""
    model = fit(training_rows(docs.select("doc_id", "text"), labels))
    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema[0], T.StructField("score", T.DoubleType())])
    return source.mapInArrow(_score(model), schema).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
