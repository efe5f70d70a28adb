"""The operators against plain versions, with nulls, empty tables, ties, repeated rows, long texts
and extra columns of clashing names."""

import hashlib
import math
import sys
from pathlib import Path

import numpy as np
import plain
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidepane.llm import components, decontaminate, exact_dedup, jaccard, line_chunks, pieces, pii, quality, queries, suffix_dedup, suffix_sort, tables, toxicity, url_graph

SMALL = "/root/testdata/sf0.001"
LONG = "wort " * 20_000 + "\n" + "1" * 30_000 + " " + "1 2 " * 5_000 + "\n" + "äö" * 20_000
EDGES = [(9001, None), (9002, ""), (9003, "\n \n"), (9004, "one"), (9005, LONG), (9006, LONG), (9007, "one"), (9008, "a@b.c%d@e.fr 1.2.3.4.5 +1 (988) 555-2485 +1")]
DOC = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    return rows + EDGES


@pytest.fixture(scope="module")
def table(spark, docs):
    return spark.createDataFrame(docs, DOC)


def empty(spark, schema=DOC):
    return spark.createDataFrame([], schema)


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(table, docs, n, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table, n, num).collect()}
    want = plain.jaccard(docs, n, num, 100)
    assert {d: (s, c if s else d) for d, (s, c) in want.items()} == got


def test_jaccard_near_copies_and_null_ids(spark):
    words = [f"w{i}" for i in range(200)]
    near = [(i, " ".join([*words[:i], f"x{i}", *words[i:]])) for i in range(60)]
    rows = [*near, (None, "w1 w2 w3"), (100, "solo text here"), (100, "solo text here")]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, DOC), 3, 90).collect()
    assert {r.component_id for r in out if r.doc_id is not None and r.doc_id < 60} == {0}
    assert len(out) == len(rows) and [r.component_id for r in out if r.doc_id is None] == [None]
    assert jaccard.jaccard_components(empty(spark), 3, 90).count() == 0
    kept = jaccard.keep_one(spark.createDataFrame(rows, DOC).withColumn("n_links", F.lit("own"))).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 100] and kept[0].n_links == "own"


def test_jaccard_counts_every_link(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(0, 50, 2)]
    texts += [" ".join(words)] * 3 + [" ".join(words[:k]) for k in range(50, 60)] + [texts[3], texts[3].upper()]
    sets = [set(zip(*[t.lower().split()[i:] for i in range(3)])) for t in texts]
    want = {
        i: sum(100 * len(a & b) >= 90 * len(a | b) for b in sets) - 1
        for i, a in enumerate(sets)
    }
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), DOC), 3, 90).collect()
    assert {r.doc_id: r.n_links for r in got} == want


def test_one_id_with_several_texts_loses_none(spark):
    rows = [(1, "a b c d e f g"), (1, "quite another text that is clean"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (3, ""), (3, "")]
    table = spark.createDataFrame(rows, DOC).withColumn("root", F.lit("own")).withColumn("unit", F.lit(7))
    kept = sorted((r.doc_id, r.text or "") for r in jaccard.keep_one(table).collect())
    assert kept == [(1, "a b c d e f g"), (1, "quite another text that is clean"), (3, ""), (3, "")]  # null and empty
    out = sorted(map(tuple, jaccard.jaccard_components(table, 3, 90).collect()))
    assert out == [(1, 4, 1, 0), (1, 5, 1, 1), (1, 5, 1, 1), (2, 5, 1, 1), (3, 0, 3, 0), (3, 0, 3, 0), (3, 0, 3, 0)]


@pytest.mark.parametrize("shingles", [60, 1000])
def test_links_are_counted_over_many_blocks(spark, monkeypatch, shingles):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(jaccard, "UNIT_WEIGHT", 1)
    test_jaccard_counts_every_link(spark)


def test_seeds_of_very_large_hosts(spark):
    hosts = spark.createDataFrame([("a", 3 * 10**8, 0), ("b", 10**8, 10**11)], "host string, trust_seed bigint, distrust_seed bigint")
    out = {r.host: (r.trust, r.distrust) for r in url_graph.propagate(hosts, empty(spark, "src string, dst string")).collect()}
    kept = url_graph.MASS * (100 - url_graph.DAMPING) // 100
    assert out == {"a": (kept * 3 // 4, 0), "b": (kept // 4, kept)}


def test_components_raise_when_unfinished(spark):
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components.connected_components(edges).collect()} == {0}
    with pytest.raises(RuntimeError, match="not final"):
        components.connected_components(edges, most_rounds=2)


def test_allowances_may_be_moved(table, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "COSTLY", 0.0)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(table, 3, 90).collect()}
    assert got == {d: c if s else d for d, (s, c) in plain.jaccard(docs, 3, 90, 100).items()}


def test_exact_dedup(spark, docs, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([*docs, (9004, "one"), (None, "one")], DOC).repartition(3).write.parquet(path)
    got = exact_dedup.exact_groups(spark, path, max_files=1).collect()
    want = plain.exact([*docs, (9004, "one"), (-1, "one")])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in got) == want


def test_exact_dedup_compares_bytes(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "ab"), (4, "ac"), (5, "aa")], DOC).write.parquet(path)
    got = exact_dedup.exact_groups(spark, path, digest=lambda t: F.substring(t, 1, 1)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [
        (1, 5, 2, False), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 2, True)
    ]
    empty(spark).write.parquet(str(tmp_path / "none"))
    assert exact_dedup.exact_groups(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("entries", [decontaminate.BLOCK_ENTRIES, 300])
def test_decontamination(spark, table, docs, entries):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(5000, "one"), (5001, None), (5002, "..."), (None, "wort wort"), (5003, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(table, bench, block_entries=entries).collect()
    want = plain.contamination(docs, [x for x in items if x[0] is not None])
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    clashing = table.withColumn("hits", F.lit(1)).withColumn("row", F.lit("x"))
    left = decontaminate.decontaminate(clashing, bench, block_entries=entries)
    assert left.columns == clashing.columns
    assert {r.doc_id for r in left.collect()} == {d for d, x in want.items() if not x[4]}
    cut = decontaminate.decontaminate(clashing, bench, remove="spans", block_entries=entries)
    again = decontaminate.contamination(cut.where("doc_id < 9000"), bench).where("n_hit > 9").count()
    assert cut.count() == len(docs) and again == 0
    assert decontaminate.contamination(table, empty(spark, "item_id bigint, text string")).where("contaminated").count() == 0


def test_suffix_dedup(spark, table, docs, monkeypatch):
    short = [d for d in docs if d[0] < 9005]
    for hot, piece in ((1, 1 << 20), (256, 3000)):
        monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", hot)
        got = suffix_dedup.suffix_dedup(spark.createDataFrame(short, DOC), piece_bytes=piece).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == plain.repeats(short, 100)
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0
    # Long periodic texts, and a copy of one.
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(table.where("doc_id IN (9005, 9006)")).collect()}
    assert got == plain.repeats([d for d in docs if d[0] in (9005, 9006)], 100)


def test_suffix_runs_are_merged_from_disk():
    rng = np.random.default_rng(1)
    regions = [(bytes(rng.integers(97, 99, 40).astype(np.uint8)), int(d), 0) for d in range(30)]
    whole = sorted((int(a), int(b)) for x in suffix_sort.repeats(iter(regions), 7) for a, b in zip(*x))
    parts = sorted((int(a), int(b)) for x in suffix_sort.repeats(iter(regions), 7, piece_bytes=100) for a, b in zip(*x))
    first = {}
    for text, doc, _ in regions:
        for i in range(34):
            first.setdefault(text[i : i + 7], (doc, i))
    assert whole == parts == sorted((d, i) for t, d, _ in regions for i in range(34) if first[t[i : i + 7]] != (d, i))


def test_personal_data(spark, table, docs):
    for r in pii.personal_data(table).collect():
        want = plain.base_spans(dict(docs)[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == n for x in want) for n in range(4)]
    assert pii.personal_data(empty(spark)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Reach host: 10.0.0.{i} now") for i in range(8)] + [(20, "Reach host: srv-77x, please"), (21, "page 77 of 90"), (22, None)]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, DOC).withColumn("base", F.lit(1))).collect()}
    assert out[20].spans == "context:12:19" and out[20].n_context == 1 and out[21].spans == "" and out[22].spans == ""
    assert out[3].spans == "ip:12:20"


def test_contexts_learn_from_whole_identifiers(spark):
    rows = [(i, f"Tel: +1 (614) 555-80{i}0 now") for i in range(4)] + [(10, "Tel: (614) 555 8001, now")]
    rows += [(20 + i, f"Mail <{x}@example.com> or") for i, x in enumerate(("ann", "bob", "cy"))] + [(30, "Mail eve@local. Then"), (31, "a 12 3rd b 1 2")]
    table = spark.createDataFrame(rows, DOC)
    out = {r.doc_id: r for r in pii.personal_data(table).collect()}
    assert out[10].spans == "context:5:19" and out[30].spans == "context:5:14" and out[31].spans == ""
    assert out[0].spans == "phone:5:22" and out[20].spans == "email:6:21"
    base = table.select("doc_id", F.explode(pii.base_spans(F.col("text"))).alias("b")).select("doc_id", "b.*").collect()
    assert {(r.pattern, r.instance) for r in base if r.doc_id in (0, 20)} == {("tel:", "+1 (614) 555-8000"), ("mail", "ann@example.com")}
    found = table.select("doc_id", F.explode(pii.candidates(F.col("text"))).alias("c")).where("doc_id = 31").select("c.*").collect()
    assert [(r.pattern, r.instance) for r in found] == [("a", "12"), ("b", "1 2")]


def test_line_chunks(spark, table, docs):
    want = plain.line_chunks(docs, lambda x: xxhash.xxh64_intdigest(x.encode(), 42))
    for r in line_chunks.line_report(table).collect():
        kept, n_lines, lines, chunks = want[r.doc_id]
        lost = dict(docs)[r.doc_id] is None
        assert (r.n_lines, r.n_removed_lines, r.n_removed_chunks) == (0 if lost else n_lines, lines, chunks)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    clashing = table.withColumn("_key", F.lit(1)).withColumn("removed", F.lit("x"))
    out = line_chunks.line_dedup(clashing)
    assert out.columns == clashing.columns and out.count() == len(docs)
    assert line_chunks.line_report(empty(spark)).count() == 0


def test_line_chunks_with_one_hash_are_compared(spark, monkeypatch):
    rows = [(1, "a\nb"), (2, "a\nc"), (3, "a\nc"), (4, "a\nb"), (4, "a\nb")]
    real = F.xxhash64
    monkeypatch.setattr(line_chunks.F, "xxhash64", lambda *x: real(*x) * 0)
    report = line_chunks.line_report(spark.createDataFrame(rows, DOC), least_lines=1).collect()
    assert sorted((r.doc_id, r.n_removed_chunks) for r in report) == [(1, 0), (2, 0), (3, 1), (4, 1), (4, 1)]


def test_repeated_runs_go_whole(spark, table, docs, monkeypatch):
    rows = [(i, "\n".join([f"own {i} a", "shared one", "shared two", "shared three", f"own {i} b", f"own {i} c"])) for i in range(12)]
    rows += [(50, "x\nx\nx"), (51, "shared two\nshared three"), (52, "shared one"), (None, None), (53, "x\nx"), (53, "x\nx")]
    for collide in (False, True):
        if collide:
            real = F.xxhash64
            monkeypatch.setattr(line_chunks.F, "xxhash64", lambda *x: real(*x) * 0)
        got = line_chunks.run_report(spark.createDataFrame(rows, DOC)).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_removed_lines, r.n_removed_chunks) for r in got)
        assert got == [(-1, 0, 0, 0), (0, 6, 0, 0), *[(i, 6, 3, 1) for i in range(1, 12)], (50, 3, 2, 1), (51, 2, 2, 1), (52, 1, 0, 0), (53, 2, 2, 1), (53, 2, 2, 1)]
    monkeypatch.undo()
    seen, want = set(), {}
    for doc, text in sorted(docs):
        lines, gone = (text or "").split("\n") if text is not None else [], set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            gone |= {i, i + 1} if pair in seen else set()
            seen.add(pair)
        want[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert {r.doc_id: r.text or "" for r in line_chunks.run_dedup(table.withColumn("_out", F.lit(1))).collect()} == want


def test_url_graph(spark):
    page = lambda i, url, *links: (i, url, "".join(f'<a class="x" href="{x}">t</a>' for x in links))
    rows = [
        page(1, "http://Good.example.net/en/1", "https://friend.example.com/x", "/own", "//Second.example.org/y"),
        page(2, "http://bad.net/x", "https://good.example.net/en/"), page(3, "http://points.example.com/en/?q", "http://bad.net/z", "http://friend.example.com"),
        page(4, "http://friend.example.com"), page(5, None), page(6, "no scheme"), page(7, "http://second.example.org/fr/a#t"),
        page(8, "http://farm.example.org/de/1", "http://bad.net/1", "http://bad.net/1"), (9, "http://x.example.com/de/#", None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("trust", F.lit("own"))
    out = {r.page_id: r for r in url_graph.judge_urls(pages).collect()}
    assert [out[i].rule for i in range(1, 10)] == ["example.net/en/", "net/", None, None, None, None, "org/fr/", None, "example.com/de/"]
    verdicts = ["allow", "block", "block", "allow", "allow", "allow", "allow", "block", "block"]
    assert [out[i].verdict for i in range(1, 10)] == verdicts
    edges = [("good.example.net", "friend.example.com"), ("good.example.net", "second.example.org"), ("bad.net", "good.example.net"),
             ("points.example.com", "bad.net"), ("points.example.com", "friend.example.com"), ("farm.example.org", "bad.net")]
    trust = plain.url_masses({"good.example.net": 1, "second.example.org": 1}, edges, url_graph.ROUNDS, url_graph.MASS, url_graph.DAMPING)
    spread = plain.url_masses({"bad.net": 1, "x.example.com": 1}, [(b, a) for a, b in edges], url_graph.ROUNDS, url_graph.MASS, url_graph.DAMPING)
    for r in out.values():
        assert (r.trust, r.distrust) == (trust.get(r.host, 0), spread.get(r.host, 0))
    assert url_graph.judge_urls(empty(spark, "page_id bigint, url string, html string")).count() == 0


def test_mixed_hosts_seed_and_masses_converge(spark):
    page = lambda i, url, link="": (i, url, f'<a href="{link}">t</a>' if link else None)
    rows = [page(1, "http://mixed.org/fr/1"), page(2, "http://mixed.org/x"), page(3, "http://mixed.org/y"), page(4, "http://mixed.org/z")]
    rows += [page(10, "http://part.example.com/de/1"), page(11, "http://part.example.com/x"), page(12, "http://part.example.com/y")]
    rows += [page(20 + i, f"http://h{i}.test/", f"http://h{i - 1}.test/" if i else "http://part.example.com/") for i in range(15)]
    out = {r.page_id: r for r in url_graph.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out[2].trust > 0 and out[2].verdict == "allow" and out[11].distrust > 0 and out[11].verdict == "block"
    assert all(out[20 + i].verdict == "block" and out[20 + i].distrust > 0 for i in range(15))
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    hosts = spark.createDataFrame([("a", 1, 0)], "host string, trust_seed bigint, distrust_seed bigint")
    with pytest.raises(RuntimeError, match="still change"):
        url_graph.propagate(hosts, ring, rounds=3)


def test_samples_are_distinct_and_follow_the_lattice():
    vocabulary = pieces.Vocabulary(*pieces.Vocabulary.load(pieces.MODEL))
    lattices, text = pieces.Lattices(vocabulary), b"to be"
    by_bytes = {p: i for i, p in enumerate(vocabulary.pieces) if np.isfinite(vocabulary.log_p[i]) and i not in set(vocabulary.bytes_at.tolist())}

    def paths(data):
        return [()] if not data else [(by_bytes[data[:k]], *rest) for k in range(1, len(data) + 1) if data[:k] in by_bytes for rest in paths(data[k:])]

    every = {p: sum(vocabulary.log_p[i] for i in p) for p in paths(b" " + text)}
    total = np.logaddexp.reduce(list(every.values()))
    n = 4000
    found = pieces.sample([text] * n, np.arange(n, dtype=np.uint64), lattices, 3)
    for row in found:
        assert len({tuple(p.tolist()) for p, _, _ in row}) == 3
        assert all(math.isclose(every[tuple(p.tolist())] - total, lp, abs_tol=1e-4) for p, lp, _ in row)
    p = {k: math.exp(v - total) for k, v in every.items()}
    for path in sorted(p, key=p.get)[-3:]:
        second = sum(p[a] * p[path] / (1 - p[a]) for a in p if a != path)
        assert abs(np.mean([tuple(r[1][0].tolist()) == path for r in found]) - second) < 0.04
    assert len(pieces.sample([text], np.array([1], dtype=np.uint64), lattices, 64)[0]) == len(every)


def test_encoding_and_decoding(spark, docs):
    rows = [d for d in docs if d[0] < 9005 or d[0] > 9006] + [(9100, "▁ mark \u0000 \U0001f600 ß\r\n" + "x" * 3000)]
    frame = spark.createDataFrame(rows, DOC).withColumn("sample", F.lit("own"))
    out = pieces.sampled_encodings(frame, samples=2)
    got = out.collect()
    assert all(r.lossless for r in got) and {r.doc_id for r in got} == {d for d, _ in rows}
    decoded = {(r.doc_id, r.sample): r.text for r in pieces.decode(out).collect()}
    assert all(decoded[r.doc_id, r.sample] == (dict(rows)[r.doc_id] or "") for r in got)
    again = pieces.sampled_encodings(frame.repartition(5), samples=2, with_ids=True).collect()
    assert sorted((r.doc_id, r.sample, r.ids) for r in got) == sorted((r.doc_id, r.sample, r.ids) for r in again)
    assert pieces.sampled_encodings(empty(spark)).count() == 0


@pytest.mark.parametrize("name, least", [("op3_toxicity", 0.9), ("op10_quality", 0.9)])
def test_held_out_accuracy(spark, name, least):
    folder = "/root/testdata/sf0.1" if name == "op3_toxicity" else "/root/testdata/sf0.01"
    labels = tables.load(spark, folder, "labels").withColumn("label", F.col("toxic" if "toxic" in name else "quality"))
    out = queries.queries()[name](spark, folder).join(labels, "doc_id").where("held_out").select("predicted", "label", "score").toPandas()
    assert (out.predicted == out.label).mean() > least and out.score.between(0, 1).all()
    assert out.predicted[out.label == 1].mean() > 0.8 and out.predicted[out.label == 0].mean() < 0.4


def test_statistics_mean_the_same_at_every_size():
    words = [f"word{i:05d}" for i in range(5000)] + ["w" * 25]
    short, long = (quality.statistics(" ".join(words[-n:]).encode()) for n in (1000, len(words)))
    assert short[19] == long[19] == 25 / 20
    assert (short[20], long[20]) == (1 / 1000, 1 / len(words))


def test_classifiers_take_odd_rows(spark, table):
    none = empty(spark, "doc_id bigint, quality int, toxic int")
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (1, None, None), (9002, 0, 1), (9004, 0, 1)], none.schema)
    odd = table.union(spark.createDataFrame([(None, "x"), (9004, "one")], DOC)).withColumn("score", F.lit("own"))
    for known in (none, labels):
        for out in (quality.quality_scores(odd, known), toxicity.toxicity(odd, known)):
            assert out.where("score BETWEEN 0 AND 1").count() == odd.count()
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.quality_scores(empty(spark), labels).count() == 0 and toxicity.toxicity(empty(spark), labels).count() == 0


def test_spaced_and_altered_terms():
    clean = [(f"the quiet river runs number {i} past the old mill and garden {'abcdefgh'[i % 8]}stone", 0) for i in range(60)]
    model = toxicity.fit(clean + [(f"you are an idiot and a moron number {i}", 1) for i in range(60)])
    worst = lambda text: model.probability(max(model.decide(sorted(toxicity.terms(text)))))
    assert worst("what an id-iot") > 0.5 and worst("an i d i o t indeed") > 0.5 and worst("idxiot") > 0.5
    assert worst("the quiet garden") < 0.3


def test_pipeline_stages(spark):
    docs = tables.load(spark, SMALL, "documents")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "jaccard", "decontamination", "pieces"]
    for name, function in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = function(spark, docs, SMALL)
        if name != "pieces":
            assert out.columns == names
        got = {r.doc_id: r for r in out.collect()}
        if name == "jaccard":
            assert set(got) == {c if s else d for d, (s, c) in plain.jaccard(list(before.items()), 5, 80, 100).items()}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in tables.load(spark, SMALL, "benchmark").collect()]
            assert set(got) == {d for d, x in plain.contamination(before.items(), items).items() if not x[4]}
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in got.values())
        if name == "pieces":
            assert set(got) == set(before)
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_root_is_importable():
    assert Path(corpus_pipeline.__file__).parent == Path(sys.modules["tidepane"].__file__).parent.parent


@pytest.mark.parametrize("num", [90, 80, 50])
def test_linked_sets_share_a_signature(num):
    rng = np.random.default_rng(num)
    plain_scheme, pairs = jaccard.Scheme(3, num, 100), 0
    for trial in range(1500):
        size = int(rng.integers(1, 30 if trial % 3 else 140))
        moves = {}
        for band, segments, base, _ in plain_scheme.roles(size) if trial % 2 else ():
            if base == 1 and segments > 2:
                none, two = rng.choice(segments, 2, replace=False)
                moves |= {(band, int(none)): 0, (band, int(two)): 2}
        scheme = jaccard.Scheme(3, num, 100, moves)
        one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        common = rng.permutation(one)[int(rng.integers(0, size * (100 - num) // 100 + 1)) :]
        added = 0
        while scheme.linked(len(common), len(one), len(common) + added + 1):
            added += 1
        own = rng.integers(0, 1 << 63, added, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        other = np.unique(np.concatenate([common, own]))
        if scheme.linked(len(common), len(one), len(other)):
            pairs += 1
            assert len(np.intersect1d(jaccard.signatures(one, scheme), jaccard.signatures(other, scheme)))
    assert pairs > 1000


def test_small_sets_have_no_thin_signatures():
    """Documents that only share one common shingle meet in no signature."""
    rng = np.random.default_rng(1)
    scheme, common = jaccard.Scheme(3, 90, 100), np.array([1 << 40], dtype=np.uint64)
    seen = []
    for size in range(10, 19):
        for _ in range(50):
            hashes = np.unique(np.concatenate([common, rng.integers(0, 1 << 64, size - 1, dtype=np.uint64)]))
            seen.append(jaccard.signatures(hashes, scheme))
    keys, counts = np.unique(np.concatenate(seen), return_counts=True)
    assert counts.max() == 1


@pytest.mark.parametrize("block, held", [(2, 1), (3, 4)])
def test_jaccard_blocks_of_a_signature(table, docs, monkeypatch, block, held):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "MOST_HELD", held)
    test_jaccard(table, docs, 3, 90)
    test_jaccard(table, docs, 1, 50)


def test_quality_filter_takes_one_python_worker_a_task(spark, docs):
    odd = spark.createDataFrame(docs + [(None, "no id"), docs[0]], DOC)
    labels = tables.load(spark, SMALL, "labels")
    kept = quality.keep_good(odd, labels)
    assert kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("MapInArrow") == 1
    scores = quality.quality_scores(odd, labels).where("score >= 0.5").select("doc_id")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scores.collect())
