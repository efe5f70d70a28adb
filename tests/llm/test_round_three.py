"""Operators 11 to 13 against plain versions, with nulls, empty tables, ties, repeated rows, long
texts and extra columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepane.llm import hard_negatives, secret_scan, variants

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"
VEC = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def random_hex(seed, n=40):
    return "".join(random.Random(seed).choices("0123456789abcdef", k=n))


# --- operator 11 -----------------------------------------------------------------------------


def plain_secrets(text):
    """Base spans by scanning for maximal runs and keys, without the operator's patterns."""
    text = text or ""
    out = []
    key = re.compile(r"password|passwd|secret|token|apikey|api_key")
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    at = 0
    while m := key.search(lowered, at):
        i, at = m.end(), m.start() + 1
        i += text[i : i + 1] in ("'", '"') and i < len(text)
        while text[i : i + 1] == " ":
            i += 1
        if text[i : i + 1] not in (":", "=") or i >= len(text):
            continue
        i += 1
        while text[i : i + 1] == " ":
            i += 1
        i += text[i : i + 1] in ("'", '"') and i < len(text)
        j = i
        while j < len(text) and (text[j].isascii() and text[j].isalnum() or text[j] in "+/_.=-"):
            j += 1
        if j > i:
            at = j
            if j - i >= 6:
                out.append((m.start(), 0, j))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


ODD = [
    (9001, None), (9002, ""), (9003, 'ä TOKEN = "abc" secret:abcdefgh Api_Key=\'' + "x" * 7), (9004, "AKIA" + "Z" * 15 + " AKIA" + "Z" * 16),
    (9005, "f" * 23 + " " + "f" * 24 + "G" + "token: " * 3), (9006, "token=" + "a1" * 50_000 + " " + "wort " * 50_000),
    (9007, "paſſword=abcdefgh toKen=abcdefgh passwordtoken=abcdefgh"), (9008, "token==abcdef token  =  ==token=zzzzzz"), (9008, "token==abcdef"), (None, "secret=abcdef"),
]


def test_secret_base_spans(spark, docs):
    rows = docs + ODD
    table = spark.createDataFrame(rows, DOC).withColumn("spans", F.lit(1)).withColumn("base", F.lit("own"))
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.secret_report(table).collect())
    want = Counter()
    for doc, text in rows:
        spans = plain_secrets(text)
        said = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want[(doc, *[sum(x[1] == k for x in spans) for k in range(3)], hashlib.sha256(said.encode()).hexdigest())] += 1
    assert got == want


def test_secrets_that_no_pattern_knows(spark, docs):
    marked = [(9100 + i, f"text token = {random_hex(i)} here") for i in range(60)]
    loose = random_hex("loose").upper()
    camel = "".join(random.Random(3).choices(secret_scan._SIGNS, k=32))
    hidden = [(9200, f"see {loose} there"), (9201, f"key {camel[:16]}_{camel[16:]}"), (9202, "m" * 400), (9203, "plain words only, nothing else")]
    rows = docs + marked + hidden
    out = {r.doc_id: r for r in secret_scan.secret_report(spark.createDataFrame(rows, DOC)).collect()}
    assert out[9200].spans == "random:4:44" and out[9200].n_random == 1
    assert out[9201].spans == "random:4:37"
    assert out[9202].spans == out[9203].spans == ""
    # hardly any document of the given table has further spans
    assert sum(out[d].n_random > 0 for d, _ in docs) <= len(docs) // 50
    assert all(out[d].n_hex == 1 and out[d].spans.count("random") == 0 for d, _ in marked)


def test_secret_models_on_held_out_samples(spark, docs):
    marked = [(9100 + i, f"text token = {random_hex(i)} here") for i in range(200)]
    samples = secret_scan.samples(spark.createDataFrame(docs + marked, DOC))
    fold = F.crc32(F.col("piece").cast("binary")) % 2 == 0
    models = secret_scan.count_models(samples.where(fold))
    rest = samples.where(~fold).collect()
    judged = dict(zip([r.piece for r in rest], models.secret([r.piece for r in rest]).tolist()))
    random_ones, others = [r.piece for r in rest if r.random], [r.piece for r in rest if not r.random]
    assert np.mean([judged[p] for p in random_ones]) >= 0.95
    assert np.mean([judged[p] for p in others]) <= 0.02


def test_secret_ratio_by_hand():
    counts = np.zeros((2, secret_scan._BASE ** 3), dtype=np.int64)
    for label, pieces in ((0, ["wordword", "wordings"]), (1, ["a1b2c3d4", "4d3c2b1a"])):
        np.add.at(counts[label], secret_scan._cells(pieces)[0], 1)
    models = secret_scan.Models(counts)

    def log_probability(samples, piece, even):
        known = [dict(), dict(), dict()]
        for sample in samples:
            padded = "\0\0" + sample
            for i in range(2, len(padded)):
                for order in range(3):
                    known[order].setdefault(padded[i - order : i], Counter())[padded[i]] += 1
        total, padded = 0.0, "\0\0" + piece
        for i in range(2, len(padded)):
            p = 1 / 62
            for order in range(3):
                seen = known[order].get(padded[i - order : i])
                if seen:
                    p = (seen[padded[i]] + len(seen) * p) / (sum(seen.values()) + len(seen))
            total += np.log((1 - even) * p + even / 62)
        return total

    pieces = ["a1b2wxyz", "wordless", "ZZZZZZZZ"]
    want = [log_probability(["a1b2c3d4", "4d3c2b1a"], p, secret_scan.EVEN) - log_probability(["wordword", "wordings"], p, 0) for p in pieces]
    assert np.allclose(models.ratios(pieces), want, atol=1e-3)


def test_secrets_empty(spark):
    assert secret_scan.secret_report(spark.createDataFrame([], DOC)).count() == 0
    only = secret_scan.secret_report(spark.createDataFrame([(1, None), (1, None), (2, "token=abcdefgh")], DOC)).collect()
    assert sorted((r.doc_id, r.spans) for r in only) == [(1, ""), (1, ""), (2, "assign:0:14")]


# --- operator 12 -----------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    by_rest = {}
    for w in n:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest.setdefault(rest, set()).add(w)
    found = {}
    for w in n:
        others = set().union(*(by_rest[r] for r in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}))
        found[w] = sorted((-n[x], x) for x in others if near(w, x))
    form = {w: f[0][1] for w, f in found.items() if f and -f[0][0] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n[w], len(found[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


def got_variants(table, **options):
    out = variants.spelling_variants(table, **options).collect()
    assert len({r.word for r in out}) == len(out)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in out}


def test_variants(spark, docs):
    long = "x" * 30_000 + "y"
    odd = [
        (9001, None), (9002, ""), (None, "recieve receive " * 3), (9003, "receive " * 400), (9003, "receive " * 400), (9004, "recieves reciive " * 4),
        (9005, f"{long} {long} {long}z {long}z {long[1:]}z {long[1:]}z"), (9006, "ÀÉÎÕÜßÿ àÉÎÕÜßÿ " * 3), (9007, "receiving receivingg " * 2), (9008, "reciives " * 41),
        (9010, "receeive " * 60), (9011, "receeivee " * 3),
    ]
    table = spark.createDataFrame(docs + odd, DOC).withColumn("n", F.lit(1)).withColumn("word", F.lit("own"))
    want = plain_variants(docs + odd)
    assert got_variants(table) == want and any(v[2] != v[4] and v[2] for v in want.values())


def test_variants_of_large_groups(spark):
    """Hundreds of words that differ in one letter or end; groups cut into slices change nothing."""
    rng = random.Random(5)
    words = ["stemword" + "".join(rng.choices("abcd", k=3)) for _ in range(300)] + ["stemwor" + c for c in "abcdefgh"]
    rows = [(i, f"{w} {w} " * (200 if i % 50 == 0 else 1)) for i, w in enumerate(words)]
    table, want = spark.createDataFrame(rows, DOC), plain_variants(rows)
    assert got_variants(table) == want == got_variants(table, group_rows=7)
    assert max(v[1] for v in want.values()) >= 8


def test_variants_chains_and_empty(spark):
    counts = [("aaaaaaaa", 2), ("aaaaaaab", 25), ("aaaaaabb", 260), ("aaaaabbb", 2700)]
    table = spark.createDataFrame([(w, n) for w, n in counts], "word string, form_n bigint")
    forms = spark.createDataFrame([("aaaaaaaa", "aaaaaaab"), ("aaaaaaab", "aaaaaabb"), ("aaaaaabb", "aaaaabbb")], "word string, form string")
    assert {(r.word, r.root) for r in variants.roots(forms).collect()} == {(w, "aaaaabbb") for w, _ in counts[:3]}
    assert table.count() == 4
    assert got_variants(spark.createDataFrame([], DOC)) == {}
    assert got_variants(spark.createDataFrame([(1, "short words")], DOC)) == {}


# --- operator 13 -----------------------------------------------------------------------------


def plain_negatives(rows):
    taken = set()
    for vec, x, label in rows:
        if label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        taken.add((vec, label, tuple(int(np.floor(256 * float(np.float32(v)))) for v in x)))
    taken = sorted(taken, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a in taken:
        if a[0] is None or a[0] % 50:
            continue
        scored = sorted(((-score(a[2], r[2]), r[0] is None, r[0] or 0, r) for r in taken if r is not a), key=lambda x: x[:3])
        for p in [s for s in scored if s[3][1] == a[1]][:5]:
            fits = [s for s in scored if s[3][1] != a[1] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]]
            out += [(a[0], p[3][0], k, s[3][0], -p[0], -s[0]) for k, s in enumerate(fits[:3], 1)]
    return out


def got_negatives(spark, rows):
    table = spark.createDataFrame(rows, VEC).withColumn("row", F.lit("own")).withColumn("score", F.lit(1))
    out = hard_negatives.hard_negatives(table, F.col("vec_id") % 50 == 0).collect()
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out)


def vectors(n, d, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    return [(i, [float(np.float32(v)) for v in (centres[i % 4] + spread * rng.normal(size=d)) / np.sqrt(d)], int(i // 4 % 3)) for i in range(n)]


@pytest.mark.parametrize("d, spread", [(64, 0.3), (3, 1.0), (70, 2.0)])
def test_negatives(spark, d, spread):
    rows = vectors(320, d, d, spread)
    assert got_negatives(spark, rows) == Counter(plain_negatives(rows))


def test_negatives_ties_nulls_and_repeats(spark):
    rows = vectors(160, 8, 1, 0.4)
    same = [(1000 + i, [0.5] * 8, i % 2) for i in range(120)]  # equal vectors: ties by id
    odd = [
        (2000, None, 1), (2001, [0.5] * 8, None), (2050, [float("nan")] + [0.5] * 7, 1), (2051, [None] * 8, 0), (2052, [float("inf")] + [0.5] * 7, 0),
        (2100, [], 1), (2150, [0.5, 0.5], 0), (2200, [0.0] * 8, 0), (2250, [-0.5] * 8, 1), (None, [0.5] * 8, 1), (None, [0.4] * 8, 0),
    ]
    every = rows + same + odd
    want = Counter(plain_negatives(every))
    assert got_negatives(spark, every) == want and want
    assert got_negatives(spark, every + same + odd) == want
    assert got_negatives(spark, []) == Counter()
    assert got_negatives(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == Counter()


def test_negatives_refuse_components_that_leave_64_bits(spark):
    with pytest.raises(Exception, match="beyond"):
        got_negatives(spark, [(0, [1e9], 1), (1, [1.0], 1)])


def test_intervals_hold():
    """Products of anchors and rows lie inside the interval of every level."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(300, 128)) * rng.choice([1, 40, 400], size=(300, 1))).astype(np.int32)
    codes, alignments = hard_negatives.coded(x.astype(float))
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    rows = object.__new__(hard_negatives.Rows)
    rows.alignments, rows.norm = alignments, norm
    rows.residual = np.sqrt(np.maximum(norm[:, None] ** 2 - np.cumsum(alignments**2, axis=1), 0) + 1e-9 * norm[:, None] ** 2)
    search = object.__new__(hard_negatives.Search)
    search.rows, search.anchors = rows, hard_negatives.Anchors(x[:40])
    a, r = np.arange(40)[:, None], np.arange(300)[None]
    exact = x[:40].astype(np.int64) @ x.T.astype(np.int64)
    estimate, unsure, width = 0.0, 0.0, []
    for level in range(hard_negatives.LEVELS):
        product = search.anchors.products(level, codes[:, level])
        estimate, unsure, lo, hi = search.interval(level, product, estimate, unsure, a, r)
        assert (lo <= exact).all() and (exact <= hi).all()
        width.append(float(np.mean(hi - lo)))
    assert width[-1] < width[0] / 5
