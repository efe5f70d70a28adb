"""Line deduplication (operator 7), in DataFrame operations only.

``run_report`` and ``run_dedup`` remove every repeated run of lines: a chunk of two lines starts at
every line, a chunk that stands earlier in the corpus is a hit, and a run is the union of the hits
that adjoin. So a run of two lines or more goes wherever it stands and whatever surrounds it; the
first occurrence of every line stays. Lines are keyed by hash, and the bytes of all lines behind a
hash are compared; where they differ, chunks are told apart by their text. First is the smallest
``doc_id``, then the earliest line.

``line_report`` and ``line_dedup`` are the form with content-defined chunks alone, which leaves runs
that hold no whole chunk. A document's lines are cut into chunks where a rolling hash over the last line hashes meets a
condition, so boundaries move with the content and not with its place. Chunks of several lines that
occur more than once in the corpus are found by hash, compared byte by byte with their first
occurrence, and removed everywhere but there. First is the smallest ``doc_id``, then the earliest
chunk.

Hashes are counted with partial sums before the shuffle; the joins on a hash that very many chunks
share carry the first occurrence as the small side and can be split. Texts are scanned for hashes,
and joined by document for the comparison and for the removal.

Defined results: null text stays null and has no lines; empty texts keep their one empty line; null
ids come first; rows that repeat id and text are one occurrence and are treated alike; all other
columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.sources.shared import stage

#: Line hashes in a rolling hash, and one boundary in so many lines on average.
ROLLING = 2
SPACING = 3
#: Lines of the smallest chunk that is removed.
LEAST_LINES = 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks_of(lines: Column, rolling: int = ROLLING, spacing: int = SPACING) -> Column:
    """Chunks as structs ``no, first, n`` (first line counted from 1)."""
    hashes = F.transform(lines, lambda x: F.xxhash64(x))

    def ends(h: Column) -> Column:
        # One number over the last line hashes; a chunk ends where it is a multiple.
        def rolled(i: Column) -> Column:
            return sum((F.shiftrightunsigned(F.get(h, i - k), 32) * F.lit(31**k) for k in range(1, rolling)), F.shiftrightunsigned(F.get(h, i), 32))

        return F.filter(
            F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | ((i >= rolling) & (F.pmod(rolled(i - 1), F.lit(spacing)) == 0))
        )

    # Bound once: the hashes, then the ends derived from them.
    bound = F.transform(F.array(hashes), ends)
    cut = lambda e: F.transform(e, lambda x, i: F.struct(
        i.alias("no"), (F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0)) + 1).alias("first"),
        (x - F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0))).alias("n"),
    ))
    return F.flatten(F.transform(bound, cut))


def chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["first"], chunk["n"]), "\n")


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.col("text").cast("binary"), 256))
    return docs.select(key.alias("_key"), *columns)


def removed_chunks(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """``_key, removed`` (numbers of the chunks that go) of documents that lose any."""
    lines = F.col("_lines")
    texts = _keyed(docs.where("text IS NOT NULL"), F.col("doc_id"), lines_of(F.col("text")).alias("_lines")).select(
        "_key", "doc_id", "_lines", F.filter(chunks_of(lines), lambda c: c["n"] >= least_lines).alias("_chunks")
    )
    marks = F.transform("_chunks", lambda c: F.struct(
        c["no"].alias("no"), c["first"].alias("first"), c["n"].alias("n"), F.xxhash64(chunk_text(lines, c)).alias("hash"),
    ))
    found = texts.select("_key", "doc_id", F.explode(marks).alias("c")).select(
        F.struct("doc_id", "_key", "c.no").alias("at"), "c.first", "c.n", "c.hash"
    )
    found = stage(found, "line-chunks")
    # Repeated rows are one place, so only different places count.
    often = found.groupBy("hash").agg(F.min("at").alias("head"), F.max("at").alias("tail")).where("head <> tail").select("hash", "head")
    repeated = stage(found.join(often, "hash").distinct(), "line-repeats")
    wanted = repeated.groupBy(F.col("at._key").alias("_key")).agg(F.collect_list(F.struct("at", "first", "n", "hash", "head")).alias("w"))
    compared = (
        _keyed(docs.where("text IS NOT NULL"), F.col("text")).join(wanted, "_key")
        .select(lines_of(F.col("text")).alias("_lines"), "w")
        .select(F.explode(F.transform("w", lambda x: F.struct(
            x["at"].alias("at"), x["head"].alias("head"), x["hash"].alias("hash"),
            F.array_join(F.slice(lines, x["first"], x["n"]), "\n").alias("bytes"),
        ))).alias("x")).select("x.*")
    )
    compared = stage(compared, "line-compared").distinct()
    heads = compared.where("at = head").select("hash", F.col("bytes").alias("content"))
    checked = compared.where("at <> head").join(heads, "hash")
    same = checked.where("bytes = content").select("at")
    # Chunks that only share the hash of the first one repeat among themselves, if at all.
    differs = stage(checked.where("bytes <> content").select("at", "hash", "bytes"), "line-collisions")
    own = differs.groupBy("hash", "bytes").agg(F.min("at").alias("head"))
    apart = differs.join(own, ["hash", "bytes"]).where("at <> head").select("at")
    return same.union(apart).groupBy(F.col("at._key").alias("_key")).agg(F.collect_set("at.no").alias("removed"))


def _with_removed(docs: DataFrame, **options: int) -> DataFrame:
    removed = stage(removed_chunks(docs, **options), "line-removed")
    rows = _keyed(docs, F.struct("*").alias("_row"))
    lines = lines_of(F.col("_row.text"))
    joined = rows.join(removed, "_key", "left").select("_row", "removed", F.when(F.col("removed").isNotNull(), lines).alias("_lines"))
    goes = F.filter(chunks_of(F.col("_lines")), lambda c: F.array_contains("removed", c["no"]))
    return joined.select("_row", "_lines", F.when(F.col("removed").isNotNull(), goes).alias("_goes"))


def _kept_text() -> Column:
    stays = F.filter("_lines", lambda x, i: ~F.exists("_goes", lambda c: (i + 1 >= c["first"]) & (i + 1 < c["first"] + c["n"])))
    return F.when(F.col("_goes").isNull(), F.col("_row.text")).otherwise(F.array_join(stays, "\n"))


def line_dedup(docs: DataFrame, **options: int) -> DataFrame:
    """The documents without repeated chunks; columns as before."""
    rows = _with_removed(docs, **options)
    return rows.select(*[_kept_text().alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, **options: int) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_removed_lines, n_removed_chunks, kept_sha256``."""
    rows = _with_removed(docs.select("doc_id", "text"), **options)
    gone = F.aggregate("_goes", F.lit(0), lambda total, c: total + c["n"])
    text = F.col("_row.text")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_removed_lines"),
        F.coalesce(F.size("_goes"), F.lit(0)).cast("bigint").alias("n_removed_chunks"),
        F.sha2(F.coalesce(_kept_text(), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def _pairs_of(lines: Column) -> Column:
    """Chunks of two lines as structs ``line, h1, h2`` (first line counted from 1)."""
    return F.flatten(F.transform(F.array(F.transform(lines, lambda x: F.xxhash64(x))), lambda h: F.transform(
        F.slice(h, 1, F.size(h) - 1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("h1"), F.get(h, i + 1).alias("h2"))
    )))


def _lines_at(numbers: Column, width: int) -> Column:
    """For each number the text of ``width`` lines from it on; the text is split once."""
    return F.flatten(F.transform(F.array(lines_of(F.col("text"))), lambda x: F.transform(
        numbers, lambda i: F.struct(i.alias("line"), F.array_join(F.slice(x, i, width), "\n").alias("bytes"))
    )))


def removed_pairs(docs: DataFrame) -> DataFrame:
    """``_key, removed``: first lines of the two-line chunks that stand earlier, of documents with any."""
    texts = docs.where("text IS NOT NULL")
    found = _keyed(texts, F.col("doc_id"), F.explode(_pairs_of(lines_of(F.col("text")))).alias("c")).select(
        F.struct("doc_id", "_key", "c.line").alias("at"), "c.h1", "c.h2"
    )
    found = stage(found, "line-pairs")
    # Repeated rows are one place, so only different places count.
    often = found.groupBy("h1", "h2").agg(F.min("at").alias("head"), F.max("at").alias("tail")).where("head <> tail").drop("tail")
    repeated = stage(found.join(often, ["h1", "h2"]).distinct().withColumn("later", F.col("at") != F.col("head")).drop("head"), "line-repeats")
    wanted = repeated.groupBy(F.col("at._key").alias("_key")).agg(F.collect_set("at.line").alias("w"))
    numbers = F.array_distinct(F.concat("w", F.transform("w", lambda i: i + 1)))
    lines = _keyed(texts, F.col("text")).join(wanted, "_key").select(F.explode(_lines_at(numbers, 1)).alias("x")).select(
        F.xxhash64("x.bytes").alias("h"), F.col("x.bytes").alias("bytes")
    )
    # Equal least and greatest bytes: all lines behind the hash are the same.
    mixed = stage(lines.groupBy("h").agg(F.min("bytes").alias("x"), F.max("bytes").alias("y")).where("x <> y").select("h"), "line-collisions")
    by = lambda side: F.col(side) == F.col("h")
    same = repeated.join(mixed, by("h1"), "left_anti").join(mixed, by("h2"), "left_anti").where("later").select("at")
    doubtful = repeated.join(mixed, by("h1"), "left_semi").select("at").union(repeated.join(mixed, by("h2"), "left_semi").select("at")).distinct()
    asked = doubtful.groupBy(F.col("at._key").alias("_key")).agg(F.collect_set("at.line").alias("w"))
    told = _keyed(texts, F.col("doc_id"), F.col("text")).join(asked, "_key").select("_key", "doc_id", F.explode(_lines_at(F.col("w"), 2)).alias("x"))
    told = stage(told.select(F.struct("doc_id", "_key", "x.line").alias("at"), F.col("x.bytes").alias("bytes")).distinct(), "line-doubtful")
    apart = told.join(told.groupBy("bytes").agg(F.min("at").alias("head")), "bytes").where("at <> head").select("at")
    return same.union(apart).groupBy(F.col("at._key").alias("_key")).agg(F.collect_set("at.line").alias("removed"))


def _without_runs(docs: DataFrame) -> DataFrame:
    """``_row, _out``: the row, and what stays (``kept, n_lines, n_chunks``), null if all does."""
    removed = stage(removed_pairs(docs), "line-removed")
    covered = F.array_distinct(F.concat("removed", F.transform("removed", lambda i: i + 1)))
    runs = F.transform(F.array(covered), lambda gone: F.struct(
        gone.alias("gone"), F.size(F.array_except(gone, F.transform(gone, lambda i: i + 1))).alias("n_chunks")
    ))
    out = F.transform(F.arrays_zip(F.array(lines_of(F.col("_row.text"))).alias("lines"), runs.alias("runs")), lambda x: F.struct(
        F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(1), F.size(x["lines"])), x["runs"]["gone"]), lambda i: F.get(x["lines"], i - 1)
        ), "\n").alias("kept"),
        F.size(x["runs"]["gone"]).alias("n_lines"), x["runs"]["n_chunks"].alias("n_chunks"),
    ))
    rows = _keyed(docs, F.struct("*").alias("_row")).join(removed, "_key", "left")
    return rows.select("_row", F.when(F.col("removed").isNotNull(), F.get(out, F.lit(0))).alias("_out"))


def _kept() -> Column:
    return F.when(F.col("_out").isNull(), F.col("_row.text")).otherwise(F.col("_out.kept"))


def run_dedup(docs: DataFrame) -> DataFrame:
    """The documents without repeated runs of lines; columns as before."""
    return _without_runs(docs).select(*[_kept().alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def run_report(docs: DataFrame) -> DataFrame:
    """As ``line_report``; ``n_removed_chunks`` counts the runs of lines that go."""
    text = F.col("_row.text")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return _without_runs(docs.select("doc_id", "text")).select(
        F.col("_row.doc_id").alias("doc_id"), n_lines.cast("bigint").alias("n_lines"),
        F.coalesce("_out.n_lines", F.lit(0)).cast("bigint").alias("n_removed_lines"),
        F.coalesce("_out.n_chunks", F.lit(0)).cast("bigint").alias("n_removed_chunks"),
        F.sha2(F.coalesce(_kept(), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
