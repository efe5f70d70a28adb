"""Operator 9's scan: long texts with many matches, and its places against a plain scan."""

import random
import re
import time

from pyspark.sql import functions as F

from tidepane.llm import pii

DOC = "doc_id bigint, text string"
BEFORE = r"(?<!\S)(?:[^\s=:0-9]++[=:](?!\s)|[^\s0-9]++[ \t]++)"
GROUP = r"[+(]*+[0-9][0-9().+-]*+"
WHOLE = rf"(?:{GROUP}(?:\x20{GROUP})*+(?![^\s,;!?>\x22'\]])|[^\s=:0-9@]*+[0-9@][^\s=:]*+)"
CONTEXT = rf"({BEFORE})[<\x22'\[/]*+"
SIGNS = [
    "\n", "\r\n", " ", "  ", "\t", "\x0b", "\x01", "\u2028", "1", "12", "7x", "10.0.0.1", "256.1.1.1", "4111 1111 1111 1111", "99999999999999999999",
    "a@b.co", "x@y", "@", ".", ",", "=", "key=", "a=[x 5", "host: ", "+1 (614) 555-8001", "(614) 555", "[", "<", "word", "é", "\U0001f600", "-", "+", "$", "\\",
]


def plain_candidates(text):
    out = []
    for m in re.finditer(CONTEXT + WHOLE, text, re.ASCII):
        context = re.match(CONTEXT, m.group(), re.ASCII)
        token = re.sub(r"""[.,;!?)>"'\]]+(?=[\u0085\u2028\u2029]?\Z)""", "", m.group()[context.end():])
        out.append((context[1].strip(" ").lower(), token, m.start() + context.end(), m.start() + context.end() + len(token)))
    return out


def test_a_text_of_many_matches_is_scanned_in_linear_time(spark):
    """The places of 20,000 addresses, and of the candidates between them, in one text."""
    n = 20_000
    text = "".join(f"Mail u{i}@example.com or host{i} " for i in range(n))
    began = time.time()
    row, = pii.personal_data(spark.createDataFrame([(1, text)], DOC)).collect()
    assert time.time() - began < 120  # the array of matches was built anew with each: 33 s for 8,000 addresses, four times that for twice as many
    addresses = [(m.start(), m.end()) for m in re.finditer(r"\S+@\S+", text)]
    assert row.n_email == n and row.n_context == 0
    assert row.spans == ",".join(f"email:{a}:{b}" for a, b in addresses)


def test_scan_of_odd_texts(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(SIGNS) + draw.choice(["", " "]) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(8)
    spans = df.select("doc_id", pii.base_spans(F.col("text")).alias("base"), pii.candidates(F.col("text")).alias("candidates"))
    rows = spans.select("*", pii.clear_of(F.col("candidates"), F.col("base")).alias("clear")).collect()
    assert len(rows) == len(texts) and sum("\x01" in x for x in texts) > 100
    touched = 0
    for r in rows:
        want = plain_candidates(texts[r.doc_id])
        assert [(x.pattern, x.instance, x.start, x.stop) for x in r.candidates] == want
        clear = [x for x in r.candidates if not any(b.start < x.stop and b.stop > x.start for b in r.base)]
        assert r.clear == clear
        touched += len(want) - len(clear)
        assert all(texts[r.doc_id][b.start : b.stop] == b.instance for b in r.base)
    assert touched > 100
