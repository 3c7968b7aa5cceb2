"""Plans that must hold at scale, and results with a third of all rows under one key."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillspark.operators import changes as C
from quillspark.operators import chunking as K
from quillspark.operators import history as H
from quillspark.operators import ranking as R
from quillspark.operators import sparse as S
from quillspark.operators.concat import concat_ordered
from quillspark.plans import catalog, chunk_retrieval
from quillspark.plans import derived as D
from quillspark.plans.catalog import Tables


@pytest.fixture(scope="module")
def t(spark, data_dir):
    return Tables(spark, data_dir)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """(session_id, turn, ts, content): a third of 30000 rows in session 0."""
    n = 30_000
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "s0").otherwise(
            F.concat(F.lit("s"), (F.col("id") % 500 + 1).cast("string"))).alias("session_id"),
        F.col("id").alias("turn"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), F.col("id") * 37 + (F.col("id") / 900).cast("int") * 5000))
        .alias("ts"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("content")).cache()


def test_no_query_has_a_nested_loop_or_python_rows(spark, data_dir):
    for name, build in catalog.queries().items():
        p = plan(build(spark, data_dir))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in p, name


def test_pruning_reaches_the_scan(t, spark, data_dir):
    q = catalog.queries()
    p = plan(q["scan_pruned"](spark, data_dir))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in p
    p = plan(q["filter_user_msgs"](spark, data_dir))
    assert "Not(EqualTo(role,system))" in p and "GreaterThan(turn,0)" in p
    p = plan(S.build_postings(D.doc_vectors(t).select("id", "text")).select("term"))
    assert "embedding" not in p.split("documents.parquet")[0].split("FileScan")[-1]


def test_postings_need_no_shuffle(spark):
    docs = spark.range(10).select("id", F.lit("a b a").alias("text"))
    assert "Exchange" not in plan(S.build_postings(docs))


def test_group_limit_before_the_shuffle(hot):
    p = plan(H.last_n(hot, 8))
    assert p.count("WindowGroupLimit") >= 2 and "Partial" in p


def test_hot_tail(hot):
    got = {(r["session_id"], r["turn"]) for r in H.last_n(hot, 8).collect()}
    pdf = hot.select("session_id", "turn").toPandas().sort_values("turn")
    want = set(pdf.groupby("session_id").tail(8).itertuples(index=False, name=None))
    assert got == want


def test_hot_inactivity_sessions(hot):
    got = sorted((r["session_id"], r["n"]) for r in
                 H.inactivity_sessions(hot, "session_id", "ts").collect())
    pdf = hot.select("session_id", "ts").toPandas().sort_values(["session_id", "ts"])
    gap = pdf.groupby("session_id")["ts"].diff().dt.total_seconds()
    sid = (gap.isna() | (gap >= 3600)).cumsum()
    want = sorted(pdf.groupby(["session_id", sid]).size().reset_index()[["session_id", 0]]
                  .itertuples(index=False, name=None))
    assert got == want
    # what reaches the window is one row per slot, far less than the rows of the hot key
    slots = H.slot_counts(hot, "session_id", "ts", 3600)
    assert slots.filter("session_id = 's0'").count() < 500


def test_hot_concat(hot):
    got = {r["session_id"]: r["content"] for r in
           concat_ordered(hot, ["session_id"], "turn", "content", "|", 64).collect()}
    pdf = hot.select("session_id", "turn", "content").toPandas().sort_values("turn")
    want = pdf.groupby("session_id")["content"].agg("|".join).to_dict()
    assert got == want


def test_hot_document_headings(spark):
    lines = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).cast("bigint").alias("doc_id"),
        F.col("id").cast("int").alias("pos"),
        F.when(F.col("id") % 11 == 0, F.concat(F.lit("# t"), F.col("id").cast("string")))
        .when(F.col("id") % 7 == 0, F.concat(F.lit("## u"), F.col("id").cast("string")))
        .otherwise("x").alias("line"))
    small = {(r["doc_id"], r["pos"]): r["path"] for r in K.heading_path(lines, 32).collect()}
    one = {(r["doc_id"], r["pos"]): r["path"] for r in K.heading_path(lines, 10 ** 6).collect()}
    assert small == one and len(one) == 5000


def test_hot_last_change(hot):
    got = C.last_change(hot.select("session_id", "turn", "content"), ["session_id"], ["turn"])
    pdf = hot.select("session_id", "turn", "content").toPandas().sort_values("turn")
    want = pdf.groupby("session_id").tail(1).itertuples(index=False, name=None)
    assert {tuple(r) for r in got.select("session_id", "turn", "content").collect()} == set(want)


def test_sample_is_repeatable(hot):
    a = R.sample_n(hot, "turn", 15, "x").select("turn").collect()
    b = R.sample_n(hot.repartition(13), "turn", 15, "x").select("turn").collect()
    assert a == b and len(a) == 15


def test_score_matrix_is_bounded():
    """However many rows meet in a task, the distances held at once don't grow with both sides."""
    import tracemalloc

    import numpy as np

    from quillspark.operators import dense

    r = np.random.default_rng(5)
    q, b = r.normal(size=(2048, 4)), r.normal(size=(60_000, 4))
    tracemalloc.start()
    best = dense._fold(q, [(np.arange(len(b)), b)], 1, "cosine", -0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    s = dense._scores(q[:20], b, "cosine")
    assert best[1][:20].tolist() == [int(np.lexsort((np.arange(len(b)), x))[0]) for x in s]


def test_cut_texts_are_given_back_in_pieces():
    """A batch of Arrow texts is cut text by text: neither its texts nor its chunks are Python strings all at once."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute as pc

    lines = ("法规" * 300 + "\n") * 400
    texts = [lines + str(i) for i in range(120)] + [None, "", "x"]
    batch = pa.array(texts)
    want = [len(K.merge_pieces(x, 1200, 200)) if x else 0 for x in texts[-4:]]
    tracemalloc.start()
    n, most = [], 0
    for part in K.cut_texts(iter([batch]), 1200, 200):
        n += pc.list_value_length(part).to_pylist()
        most = max(most, len(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n[-4:] == want and len(n) == len(texts) and min(n[:120]) >= 199
    assert most < 10 and peak < 40 << 20  # the texts are 57 MB as Python strings


def test_text_files_lie_in_blocks(spark, tmp_path, monkeypatch):
    """Folders that the job moves and lists don't grow with the files; every file is read back whole."""
    import hashlib
    import os

    from quillspark.plans import scans
    from quillspark.sources.schemas import INPUTS

    docs = [(i, f"text {i} é\nsecond line", "en", "web", 1) for i in range(0, 2000, 20)] + [(7, None, None, None, None)]
    spark.createDataFrame(docs, INPUTS["documents"]).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(scans, "folder", lambda t, name: str(tmp_path / name))
    monkeypatch.setattr(scans, "FILE_BLOCKS", 4, raising=False)
    got = {r["file"]: (r["gbk"], r["digest"]) for r in scans.read_text_files(Tables(spark, str(tmp_path))).collect()}
    want = {}
    for i, text, *_ in docs[:-1]:
        odd = i // 50 % 2 == 1
        want.setdefault(i // 50, [odd, ""])[1] += f"第{i}条 {text.replace('é', '') if odd else text}\n"
    assert got == {k: (odd, hashlib.md5(x.encode()).hexdigest()) for k, (odd, x) in want.items()} and len(got) == 40
    assert len([x for x in os.listdir(tmp_path / "files") if "=" in x]) <= 4


# --- retrieval over chunks -------------------------------------------------

@pytest.mark.parametrize("positive", [True, False])
def test_bm25_moves_no_pairs(spark, positive):
    """Documents are scored where they are, with the same result for ties, and ids that repeat or are null."""
    docs = [(None if i % 97 == 5 else f"d{i % 450}", " ".join(f"w{(i * k) % 23}" for k in range(1, 2 + i % 7)) if i % 50
             else None) for i in range(600)]
    df = spark.createDataFrame(docs, "id string, text string").repartition(5)
    q = spark.createDataFrame([(n if n else None, f"w{n} w{n} w{n + 1} w0 w{3 * n}") for n in range(20)],
                              "qid long, text string")
    index = S.build_index(df)
    got = S.bm25_top(index, q, 7, positive)
    want = S.bm25_top(replace(index, rows=None), q, 7, positive)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    alone = S.build_index(df.filter("id is not null").dropDuplicates(["id"]))
    pairs = re.compile(r"hashpartitioning\(qid#\w+, id#")
    assert not pairs.search(plan(S.bm25_top(alone, q, 7, positive)))
    assert pairs.search(plan(S.bm25_top(replace(alone, rows=None), q, 7, positive)))


def test_chunk_texts_are_not_moved_to_their_vectors(spark, tmp_path):
    """A chunk comes once for every vector of its number, and only its id meets the vectors."""
    vectors = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (1, [5.0, 6.0]), (None, [7.0, 8.0])]
    texts = [(i, f"text number {i} of some documents " * (40 if i == 2 else 1)) for i in range(6)] + [(2, "x y z " * 9)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    held, v = chunk_retrieval.chunk_vectors(t)
    keyed = chunk_retrieval.chunk_corpus(t).withColumn("vec_id", (F.col("doc_id") * 31 + F.col("chunk_idx")) % 4)
    want = keyed.join(t.embeddings, "vec_id").select("id", "text", "embedding")
    for a, b in ((held, want.select("id", "text")), (v, want.select("id", "embedding"))):
        assert sorted(map(str, (tuple(r) for r in a.collect()))) == sorted(map(str, (tuple(r) for r in b.collect())))
    assert v.count() == want.count() > held.distinct().count() > 0
    assert "hashpartitioning" not in plan(held)
