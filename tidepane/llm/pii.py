"""Personal data (operator 9): fixed kinds by pattern, unseen identifiers by bootstrapped contexts.

Base spans are leftmost non-overlapping matches per kind. They seed a graph of lexical patterns (the
word or key just before an identifier) and instances: the base spans as they are, and elsewhere
whole candidates after a pattern (groups of digits with blanks between them, tokens with a digit or
an @). In every round a pattern's confidence is the share of trust among its distinct instances, and an
instance trusts its best pattern; patterns with enough trusted instances spread trust to instances
that no base kind knows. What high-confidence patterns reach in the end is added, with the kind
``context``. Texts are scanned once, everything later works on the spans found, in DataFrame
operations only and with whole numbers (thousandths), so that results do not depend on order.

Java's possessive quantifiers keep the matching of very long runs linear and off the stack; where a
match begins is guarded so that it stays the leftmost one of the pattern without them. A pattern runs
once over a text, and only where a cheap look finds what each of its matches needs: candidates lie
within a line that has a digit or an @. Places come from running sums in log2(n) passes, so the work
for a text is its length and, but for a logarithm, the number of its matches.

Defined results: null text counts as empty; texts without matches have no spans and the hash of the
empty string; rows that repeat id and text are judged alike; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.sources.shared import stage

#: Signs one by one: Java looks a class of single signs up in a table, but asks for ranges and \s in turn.
_DIGIT = string.digits
_ALNUM = string.ascii_letters + _DIGIT
_BLANK = r"\x20\t\n\x0B\f\r"

#: Base kinds in the order of the contract, as possessive forms of its patterns. Of cards, only the runs
#: long enough to be one: shorter ones are not valid, and no context reaches over a digit.
EMAIL = rf"(?:\G|(?<![{_ALNUM}._%+-]))[{_ALNUM}._%+-]++@[{_ALNUM}-]++(?:\.[{_ALNUM}-]++)++"
IP = rf"[{_DIGIT}](?<![{_DIGIT}][{_DIGIT}])[{_DIGIT}]*+\.[{_DIGIT}]++\.[{_DIGIT}]++\.[{_DIGIT}]++"
CARD = rf"[{_DIGIT}](?:[\x20-]?[{_DIGIT}]){{13}}(?:[\x20-]?[{_DIGIT}])*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: A word without digits before blanks, or a key with = or :, at the start of a token.
_BEFORE = rf"(?<![^{_BLANK}])(?:[^{_BLANK}=:{_DIGIT}]++[=:](?![{_BLANK}])|[^{_BLANK}{_DIGIT}]++[ \t]++)"
#: Signs that may open an identifier without being part of it.
_OPENING = r"""[<"'\[/]"""
#: Groups of digits over single blanks up to a token's end, or a token with a digit or an @.
_GROUP = rf"[+(]*+[{_DIGIT}][{_DIGIT}().+-]*+"
_WHOLE = rf"(?:{_GROUP}(?:\x20{_GROUP})*+(?![^{_BLANK},;!?>\x22'\]])|[^{_BLANK}=:{_DIGIT}@]*+[{_DIGIT}@][^{_BLANK}=:]*+)"
CANDIDATE = rf"{_BEFORE}{_OPENING}*+{_WHOLE}"
CONTEXT = rf"^({_BEFORE}){_OPENING}*+"
#: The same before a base span, in the text since the last match.
SEED_CONTEXT = rf"({_BEFORE})[<(\x22'\[/]*+$"
#: What every base span and every candidate has.
_SIGN = f"[{_DIGIT}@]"
#: Set around matches where a text does not have it.
MARK = "\x01"

ROUNDS = 3
#: Distinct trusted instances that a pattern needs, and its confidence in thousandths.
SUPPORT = 3
CONFIDENT = 600


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Each value merged with all before it; every pass doubles how far back."""
    steps = F.filter(F.expr("transform(sequence(0, 30), k -> shiftleft(1, k))"), lambda step: step < F.size(values))
    return F.aggregate(steps, values, lambda done, step: F.transform(
        done, lambda x, i: F.when(i < step, x).otherwise(merge(F.get(done, i - step), x))
    ))


def _ends(texts: Column) -> Column:
    """Where each of the texts ends if they stand one after the other."""
    return _let(F.transform(texts, F.length), lambda lengths: _running(lengths, lambda a, b: a + b))


def found(text: Column, pattern: str) -> Column:
    """Matches as structs ``start, stop, hit, gap``: places in code points, end exclusive; ``gap`` is
    the text since the last match, after a 0 in its place."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    apart = F.flatten(F.zip_with(gaps, hits, lambda gap, hit: F.array(gap, hit)))
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    # Gaps and hits in turn.
    pieces = F.when(text.contains(MARK), apart).otherwise(marked)

    def places(pieces: Column, ends: Column) -> Column:
        gap = lambda i: F.get(pieces, i - 1)
        return F.transform(pieces, lambda x, i: F.when((i % 2 == 1) & x.isNotNull(), F.struct(
            F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("stop"), x.alias("hit"),
            F.when(i > 1, F.concat(F.lit("0"), gap(i))).otherwise(gap(i)).alias("gap"),
        )))

    return F.filter(_let(pieces, lambda p: _let(_ends(p), lambda ends: places(p, ends))), lambda x: x.isNotNull())


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
        return F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    if kind == "card":
        return _let(digits, lambda x: F.when(F.length(x).between(14, 19), _luhn(x)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _spans_of(text: Column, number: int, kind: str, pattern: str) -> Column:
    good = F.filter(found(text, pattern), lambda x: _valid(kind, x["hit"]))
    return F.transform(good, lambda x: F.struct(
        x["start"].alias("start"), F.lit(number).alias("kind_no"), x["stop"].alias("stop"),
        F.lower(F.trim(F.regexp_extract(x["gap"], SEED_CONTEXT, 1))).alias("pattern"), x["hit"].alias("instance"),
    ))


def _of_kind(number: int) -> Column:
    return F.filter("base", lambda x: x["kind_no"] == number)


def base_spans(text: Column) -> Column:
    """Structs ``start, kind_no, stop, pattern, instance`` of all base kinds, by start and kind; the
    pattern is empty where no word or key stands before."""
    # A cheap look for what a match needs spares most texts the search.
    needs = {
        "email": text.contains("@"), "ip": text.rlike(rf"[{_DIGIT}]\.[{_DIGIT}]++\.[{_DIGIT}]++\.[{_DIGIT}]"),
        "card": text.rlike(rf"[{_DIGIT}](?:[\x20-]?[{_DIGIT}]){{13}}"), "phone": text.contains("+"),
    }
    none = F.array().cast("array<struct<start:int,kind_no:int,stop:int,pattern:string,instance:string>>")
    parts = []
    for number, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        parts.append(F.when(needs[kind], _spans_of(text, number, kind, pattern)).otherwise(none))
    return F.when(text.rlike(_SIGN), F.array_sort(F.concat(*parts))).otherwise(none)


def candidates(text: Column) -> Column:
    """Structs ``pattern, instance, start, stop`` of whole candidates after a word or key, in order."""

    def cut(hit: Column, start: Column) -> Column:
        context = F.lower(F.trim(F.regexp_extract(hit, CONTEXT, 1)))
        token = lambda skipped: F.regexp_replace(F.substring(hit, skipped + 1, F.length(hit)), r"""[.,;!?)>"'\]]+$""", "")
        return _let(F.length(F.regexp_extract(hit, CONTEXT, 0)), lambda skipped: _let(token(skipped), lambda token: F.struct(
            context.alias("pattern"), token.alias("instance"), (start + skipped).alias("start"), (start + skipped + F.length(token)).alias("stop"),
        )))

    def within(lines: Column, ends: Column) -> Column:
        """No match reaches over a line break; a line starts after all before it and their breaks."""
        placed = F.transform(lines, lambda x, i: F.when(x.rlike(_SIGN), F.struct(x.alias("line"), (F.get(ends, i) - F.length(x) + i).alias("at"))))
        return F.flatten(F.transform(F.filter(placed, lambda x: x.isNotNull()), lambda x: F.transform(
            found(x["line"], CANDIDATE), lambda y: cut(y["hit"], y["start"] + x["at"])
        )))

    none = F.array().cast("array<struct<pattern:string,instance:string,start:int,stop:int>>")
    every = _let(F.split(text, "\n", -1), lambda lines: _let(_ends(lines), lambda ends: within(lines, ends)))
    return F.when(text.rlike(_SIGN), every).otherwise(none)


def clear_of(spans: Column, base: Column) -> Column:
    """Those of ``spans`` (apart and in order) that touch none of ``base``.

    In the order of where base spans start and others stop, the furthest stop of a base span so far
    is what could reach back into the one that stops here.
    """

    def event(at: Column, rank: int, reach: Column, start: Column, number: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(rank).alias("rank"), reach.alias("reach"), start.alias("start"), number.alias("number"))

    none = F.lit(-1)
    events = lambda spans: F.array_sort(F.concat(
        F.transform(spans, lambda x, i: event(x["stop"], 0, none, x["start"], i)),
        F.transform(base, lambda x: event(x["start"], 1, x["stop"], x["start"], none)),
    ))

    def kept(spans: Column, events: Column, reach: Column) -> Column:
        clear = F.filter(events, lambda x, i: (x["number"] >= 0) & (F.get(reach, i) <= x["start"]))
        return F.transform(clear, lambda x: F.get(spans, x["number"]))

    reach = lambda events: _let(F.transform(events, lambda x: x["reach"]), lambda x: _running(x, F.greatest))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(
        _let(spans, lambda s: _let(events(s), lambda e: _let(reach(e), lambda r: kept(s, e, r))))
    )


def _join_spans(spans: Column) -> Column:
    name = lambda n: F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "context")]), n + 1)
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", name(x["kind_no"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def confident_pairs(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: int = CONFIDENT) -> DataFrame:
    """``pattern, instance`` pairs of unseen identifiers whose pattern is confident in the end.

    ``seen``: ``pattern, instance, seed`` (1 for base spans).
    """
    edges = stage(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")
    trust = edges.groupBy("instance").agg((F.max("seed") * 1000).alias("trust"))
    patterns = None
    for _ in range(rounds):
        patterns = edges.join(trust, "instance").groupBy("pattern").agg(
            F.sum("trust").alias("sum"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("trust") >= confident, 1)).alias("good")
        ).select("pattern", F.when(F.col("good") >= support, F.expr("sum div n")).otherwise(0).alias("confidence"))
        patterns = stage(patterns.where(F.col("confidence") >= confident), "pii-patterns")
        trust = edges.join(patterns, "pattern", "left").groupBy("instance").agg(
            F.greatest(F.max("seed") * 1000, F.coalesce(F.max("confidence"), F.lit(0))).alias("trust")
        )
    return edges.join(patterns, "pattern").where("seed = 0").select("pattern", "instance")


def personal_data(docs: DataFrame, **options: int) -> DataFrame:
    """Per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select("doc_id", text.alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.col("text").cast("binary"), 256))
    spans = source.select("doc_id", key.alias("key"), base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("candidates"))
    # What touches a base span is not a candidate: the span itself is the instance.
    scanned = stage(spans.select("doc_id", "key", "base", clear_of(F.col("candidates"), F.col("base")).alias("unseen")), "pii-spans")
    unseen = scanned.select("key", F.explode("unseen").alias("c")).select("key", "c.*")
    seeds = scanned.select(F.explode("base").alias("b")).where("b.pattern <> ''").select("b.pattern", "b.instance", F.lit(1).alias("seed"))
    pairs = confident_pairs(seeds.union(unseen.select("pattern", "instance", F.lit(0).alias("seed"))), **options)
    added = (
        unseen.join(pairs, ["pattern", "instance"]).groupBy("key")
        .agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind_no"), "stop")).alias("added"))
    )
    counts = [F.size(_of_kind(n)).cast("bigint").alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind_no"].alias("kind_no"), b["stop"].alias("stop")))
    every = F.array_sort(F.when(F.col("added").isNull(), plain).otherwise(F.concat(plain, "added")))
    return scanned.select("doc_id", "key", "base").join(added, "key", "left").select(
        "doc_id", *counts, F.sha2(_join_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _join_spans(every).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("bigint").alias("n_context"),
    )
