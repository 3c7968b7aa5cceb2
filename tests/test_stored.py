"""Stored indexes and transactional ingest: blocks of postings, coded cells, one commit per batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import blockmax as BM
from quillspark.operators import dense as DN
from quillspark.operators import pqcells as PQ
from quillspark.operators import sparse as S
from quillspark.streaming import ingest as IN


def ranked(df):
    return sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """3,000 texts: one word in all of them, some frequent, many rare ones, bursts of a word here and there."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(3000):
        own = ["all"] + [f"f{x}" for x in rng.integers(0, 12, 30)] + [f"r{x}" for x in rng.zipf(1.4, 20) % 4000]
        if i % 500 == 3:
            own += ["f1"] * 40
        rows.append((i, " ".join(own)))
    rows += [(3000, ""), (3001, None)]
    return spark.createDataFrame(rows, "id long, text string").repartition(6)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([
        (1, "all f1 r3999 r17"), (2, "all f1 f2 f3"), (3, "r5 r6 r7"), (4, "all"), (5, "unknown words"),
        (6, "all all f1 r250 r251 r252 f4 f5"), (7, "f1")], "qid long, text string")


@pytest.fixture(scope="module")
def blocks(corpus, tmp_path_factory):
    return BM.store(corpus, str(tmp_path_factory.mktemp("blocks") / "i"), slice_docs=32, part_postings=20_000)


def test_blocks_give_the_same_ranks(corpus, asked, blocks):
    index = S.build_index(corpus)
    assert blocks.n_docs == index.n_docs == 3002 and blocks.avg_len == index.avg_len
    assert blocks.mean_idf == pytest.approx(index.mean_idf)
    for n, positive in ((5, True), (20, False)):
        want = ranked(S.bm25_top(index, asked, n, positive=positive))
        assert want and ranked(BM.top(blocks, asked, n, positive=positive, direct_rows=0)) == want
        assert ranked(BM.top(blocks, asked, n, positive=positive)) == want


def test_blocks_are_skipped(asked, blocks):
    seen = []
    query = asked.filter("qid in (1, 6)")
    BM.top(blocks, query, 5, direct_rows=0, seen=seen).collect()
    terms = S.query_terms(query)
    held = blocks.blocks.join(terms, "term").agg(F.count("*").alias("blocks"), F.sum("n").alias("rows")).first()
    read = [s.agg(F.count("*").alias("blocks"), F.sum("n").alias("rows")).first() for s in seen]
    assert sum(r["blocks"] for r in read) < 0.6 * held["blocks"]
    assert sum(r["rows"] or 0 for r in read) < 0.6 * held["rows"]


def test_a_term_of_all_documents_is_spread(blocks):
    common = blocks.blocks.filter("term = 'all'")
    per_part = [r["n"] for r in common.groupBy("part").agg(F.sum("n").alias("n")).collect()]
    assert len(per_part) >= 4 and sum(per_part) == 3000 and max(per_part) < 1.5 * 3000 / len(per_part)
    assert common.agg(F.max("n")).first()[0] <= 32
    ranges = common.orderBy("lo").select("lo", "hi").collect()
    assert all(a.hi < b.lo for a, b in zip(ranges, ranges[1:]))


def test_blocks_move_texts_not_postings(spark, tmp_path, monkeypatch):
    """The store shuffles documents only: every plan writes what was put together in the task of its slice."""
    rows = [(i, " ".join(["a b c"] * 20)) for i in range(300)] + [(None, "a q"), (7, "a"), (400, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    monkeypatch.setattr(BM, "build_postings", None, raising=False)
    monkeypatch.setattr(BM, "summarise", None, raising=False)
    index = BM.store(df, str(tmp_path / "i"), slice_docs=64)
    held = {(r.term, r.slice): r for r in index.blocks.collect()}
    assert {t for t, _ in held} == {"a", "b", "c", "q"}
    a = [r for (t, _), r in held.items() if t == "a"]
    assert sum(r.n for r in a) == 302 and sum(r.cf for r in a) == 6002 and all(r.n <= 64 for r in a)
    assert min(r.lo for r in a) == 0 and [r.lo for (t, _), r in held.items() if t == "q"] == [None]
    for r in held.values():
        ids = [e.id for e in r.entries if e.id is not None]
        assert ids == sorted(ids) and len(r.entries) == r.n
        assert r.impact == max(e.tf * 2.5 / (e.tf + 1.5 * (0.25 + 0.75 * e.dl / index.avg_len)) for e in r.entries)
    stats = {r.term: (r.df, r.cf) for r in index.term_stats.collect()}
    assert stats == {"a": (302, 6002), "b": (300, 6000), "c": (300, 6000), "q": (1, 1)}


def test_blocks_of_nothing(spark, corpus, asked, tmp_path):
    index = BM.store(corpus.filter("id < 0"), str(tmp_path / "i"))
    assert BM.top(index, asked, 5, direct_rows=0).collect() == []


# --- cells ---------------------------------------------------------------

@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(9)
    heads = rng.standard_normal((12, 20)) * 4
    rows = [(i, [float(x) for x in heads[i % 12 if i % 3 else 0] + rng.standard_normal(20)]) for i in range(6000)]
    base = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    return base, base.filter("id % 60 = 0").select(F.col("id").alias("qid"), "v")


@pytest.fixture(scope="module")
def cells(clustered, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "i")
    model = PQ.fit(clustered[0], 12, subspaces=10)
    PQ.store(clustered[0], model, path, file_rows=150)
    return model, path


def test_cells_recall(spark, clustered, cells):
    base, queries = clustered
    model, path = cells
    exact = {(r.qid, r.id) for r in DN.knn(queries, base, 10).collect()}
    got = PQ.search(queries, spark, path, model, k=10, probe=6, rerank=200).collect()
    assert len(got) == len(exact) and len(exact & {(r.qid, r.id) for r in got}) >= 0.95 * len(exact)
    for q in {r.qid for r in got}:
        own = sorted((r["rank"], r.dist, r.id) for r in got if r.qid == q)
        assert [x[0] for x in own] == list(range(1, 11)) and own == sorted(own, key=lambda x: (x[1], x[2]))
    dist = {(r.qid, r.id): r.dist for r in DN.knn(queries, base, 10).collect()}
    assert all(abs(dist[r.qid, r.id] - r.dist) < 1e-5 for r in got if (r.qid, r.id) in dist)


def test_bounds_stop_the_search(spark, clustered, cells):
    """Cells whose centre is too far away, less their radius, hold no neighbour."""
    model, path = cells
    stored = spark.read.parquet(f"{path}/cells")
    probes = PQ._probes(clustered[1], model, stored, 12)
    exact = DN.knn(clustered[1], clustered[0], 10).groupBy("qid").agg(F.max("dist").alias("worst"))
    kept = probes.join(exact, "qid").agg(F.count("*").alias("n"), F.count_if(F.col("least") <= F.col("worst")).alias("m"))
    kept = kept.first()
    assert kept["m"] < 0.7 * kept["n"]
    # and no true neighbour lies in a cell that the bound leaves out
    where = PQ.vectors(spark, path).select("id", "cell")
    near = DN.knn(clustered[1], clustered[0], 10).join(where, "id").join(probes, ["qid", "cell"])
    assert near.filter(F.col("least") > F.col("dist") + 1e-6).count() == 0


def test_hot_cell_is_many_files_and_others_are_pruned(spark, cells):
    _, path = cells
    stored = PQ.vectors(spark, path)
    sizes = stored.groupBy("cell", "file").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == 6000 and max(r["n"] for r in sizes) < 260
    cells_of = {}
    for r in sizes:
        cells_of.setdefault(r["cell"], []).append(r["n"])
    assert all(len(n) > 1 for n in cells_of.values() if sum(n) > 300) and max(map(len, cells_of.values())) > 2
    probed = spark.createDataFrame([(1,)], "cell int").filter("cell > 0")
    plan = stored.join(F.broadcast(probed), "cell")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan


def test_fewer_rows_than_asked(spark, tmp_path):
    base = spark.createDataFrame([(i, [float(i), 0.0, 1.0]) for i in range(7)], "id long, v array<float>")
    model = PQ.fit(base, 2, subspaces=2)
    PQ.store(base, model, str(tmp_path / "i"))
    q = base.filter("id < 2").select(F.col("id").alias("qid"), "v")
    got = PQ.search(q, spark, str(tmp_path / "i"), model, k=40, probe=2)
    assert sorted((r.qid, r["rank"], r.id) for r in got.collect()) == sorted(
        (r.qid, r["rank"], r.id) for r in DN.knn(q, base, 40).collect())


# --- embedding -----------------------------------------------------------

def test_embedder_waits_and_isolates():
    waits, calls = [], []

    def flaky(texts):
        calls.append(list(texts))
        if len(calls) == 1 or "bad" in texts:
            raise RuntimeError("no")
        return [[float(len(x))] for x in texts]

    e = DN.Embedder(flaky, batch=4, tries=2, pause=0.5, backoff=2.0, sleep=waits.append)
    vectors, errors = e.vectors(["a", "bb", "bad", "cccc"])
    assert vectors == [[1.0], [2.0], None, [4.0]]
    assert [x is None for x in errors] == [True, True, False, True] and errors[2] == "RuntimeError: no"
    assert waits.count(2.0) >= 2 and waits.count(0.5) == 2


def test_embed_or_fail_keeps_every_row(spark):
    def refuse(texts):
        if any(x.startswith("!") for x in texts):
            raise ValueError("refused")
        return [[1.0, 2.0] for _ in texts]

    rows = [(i, "!x" if i % 10 == 3 else f"t{i}") for i in range(100)] + [(100, None)]
    got = DN.embed_or_fail(spark.createDataFrame(rows, "id long, text string"), "text", DN.Embedder(refuse, tries=1))
    assert {r.id for r in got.collect() if r.v is None} == {i for i in range(101) if i % 10 == 3 or i == 100}
    assert got.filter("(v is null) <> (error is not null)").count() == 0


# --- ingest --------------------------------------------------------------

def embedder():
    def vector(texts):
        if any("poison" in x for x in texts):
            raise ValueError("poison")
        return [[float(len(x))] for x in texts]

    return DN.Embedder(vector, tries=1)


FILES = {
    "one.md": "# Title\n\nA first paragraph that is long enough to stay.\n\n## Part\nAnother one that stays.".encode(),
    "two.txt": "这是一个足够长的文本,用来检查编码是否正确。".encode("gbk"),
    "three.exe": b"not accepted at all, whatever it says", "four.txt": b"\xff\xff\xff\xff broken",
    "five.md": b"a poison text that no service wants to embed", "six.txt": b"short", "seven.pdf": b"%PDF-1.4 binary",
}


def batch_of(spark, names, start=0):
    rows = [(n, f"/{start + i}/{n}", FILES.get(n, b"text of another file, long enough")) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "filename string, path string, content binary").selectExpr(
        "filename", "path", f"timestamp_seconds({start} + int(split(path, '/')[1])) as uploaded", "content")


def states(spark, base):
    return sorted((r.path, r.state, r.chunk_count) for r in IN.read(spark, base, "status").collect())


def test_ingest_commits_a_batch_as_one(spark, tmp_path):
    base, service = str(tmp_path / "kb"), embedder()
    assert IN.read(spark, base, "chunks").collect() == []
    first = batch_of(spark, [*FILES, "one.md"])
    IN.ingest_batch(first, 0, base, service)
    want = [("/0/one.md", "ready", 2), ("/1/two.txt", "ready", 1), ("/2/three.exe", "failed", 0),
            ("/3/four.txt", "failed", 0), ("/4/five.md", "failed", 0), ("/5/six.txt", "empty", 0),
            ("/6/seven.pdf", "failed", 0), ("/7/one.md", "refused", 0)]
    assert states(spark, base) == want
    bad = {r.path: (r.reason, bytes(r.content)) for r in IN.read(spark, base, "quarantine").collect()}
    assert set(bad) == {p for p, s, _ in want if s in ("failed", "refused")}
    assert bad["/4/five.md"][0].startswith("embedding") and bad["/3/four.txt"] == ("not readable", FILES["four.txt"])
    chunks = IN.read(spark, base, "chunks")
    assert sorted((r.doc_id, r.path) for r in chunks.collect())[0] == ("one.md", "Title")
    ids = {r.id for r in IN.read(spark, base, "vectors").collect()}
    assert ids == {r.id for r in IN.read(spark, base, "postings").collect()} and len(ids) == 3

    # the same batch again, and a name that is known
    IN.ingest_batch(first, 0, base, service)
    assert states(spark, base) == want
    IN.ingest_batch(batch_of(spark, ["two.txt", "eight.txt"], 20), 1, base, service)
    assert states(spark, base) == sorted([*want, ("/20/two.txt", "refused", 0), ("/21/eight.txt", "ready", 1)])


def test_a_cut_off_batch_is_not_seen_and_done_again(spark, tmp_path, monkeypatch):
    base, service = str(tmp_path / "kb"), embedder()
    files = batch_of(spark, ["one.md", "two.txt"])

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(IN.S, "build_postings", lost)  # chunks and vectors are there by then
        with pytest.raises(RuntimeError, match="driver lost"):
            IN.ingest_batch(files, 0, base, service)
    assert all(IN.read(spark, base, t).collect() == [] for t in IN.TABLES)
    IN.ingest_batch(files, 0, base, service)
    assert [s for _, s, _ in states(spark, base)] == ["ready", "ready"]
    assert IN.read(spark, base, "chunks").count() == IN.read(spark, base, "vectors").count() == 3


def test_ingest_of_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in FILES.items():
        (folder / name).write_bytes(content)
    base, service = str(tmp_path / "kb"), embedder()

    def run():
        IN.ingest(IN.uploads(spark, str(folder), 3), base, str(tmp_path / "cp"), service).awaitTermination()

    run()
    assert sorted((r.filename, r.state) for r in IN.read(spark, base, "status").collect()) == [
        ("five.md", "failed"), ("four.txt", "failed"), ("one.md", "ready"), ("seven.pdf", "failed"),
        ("six.txt", "empty"), ("three.exe", "failed"), ("two.txt", "ready")]
    (folder / "nine file.md").write_bytes(b"one more file that comes later on")
    run()
    assert IN.read(spark, base, "status").filter("state = 'ready'").count() == 3
    assert IN.read(spark, base, "status").filter("filename = 'nine file.md'").count() == 1
