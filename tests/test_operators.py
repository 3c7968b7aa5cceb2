"""Operators on small fixtures against brute force, and both ways of every size switch."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark import params as P
from quillspark.operators import changes as C
from quillspark.operators import chunking as K
from quillspark.operators import dense as DN
from quillspark.operators import graph as G
from quillspark.operators import history as H
from quillspark.operators import hybrid as HY
from quillspark.operators import joins as JN
from quillspark.operators import quiz as Q
from quillspark.operators import ranking as R
from quillspark.operators import sparse as S
from quillspark.operators import topics as TP
from quillspark.plans import catalog
from quillspark.plans import derived as D
from quillspark.plans import retrieval as RT
from quillspark.plans.catalog import Tables
from quillspark.session import checkpoint_dir, drop_written, written
from quillspark.sources import io, schemas


@pytest.fixture(scope="module")
def t(spark, data_dir):
    return Tables(spark, data_dir)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=str)


# --- retrieval -----------------------------------------------------------

def brute_bm25(docs, queries, n, positive):
    import regex
    tok = {i: regex.findall(r"[\p{L}\p{N}]+", x) for i, x in docs}
    df = {}
    for ts in tok.values():
        for w in set(ts):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(len(docs) - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: (0.25 * mean if x < 0 else x) for w, x in raw.items()}
    avg = sum(map(len, tok.values())) / len(docs)
    out = []
    for qid, text in queries:
        scored = []
        for i, ts in tok.items():
            s, hit = 0.0, False
            for w in regex.findall(r"[\p{L}\p{N}]+", text):
                f = ts.count(w)
                if f:
                    hit = True
                    s += idf[w] * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ts) / avg))
            if hit and (round(s, 6) > 0 or not positive):
                scored.append((-round(s, 5), i))
        out += [(qid, i) for _, i in sorted(scored)[:n]]
    return out


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 30)))) for i in range(150)]
    queries = [(q, " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 8)))) for q in range(25)]
    return docs, queries


@pytest.mark.parametrize("direct_rows", [0, 10 ** 9])
@pytest.mark.parametrize("positive", [True, False])
def test_bm25(spark, words, direct_rows, positive):
    docs, queries = words
    index = S.build_index(spark.createDataFrame(docs, "id long, text string"))
    q = spark.createDataFrame(queries, "qid long, text string")
    got = S.bm25_top(index, q, 5, positive, direct_rows=direct_rows)
    want = brute_bm25(docs, queries, 5, positive)
    assert rows(got, "qid", "id") == sorted(want, key=str)


def test_bm25_pruned_on_data(spark, t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    index = S.build_index(docs)
    q = D.queries_txt(t)
    assert rows(S.bm25_top(index, q, direct_rows=0)) == rows(S.bm25_top(index, q))


def test_index_extend_save_load(spark, words):
    docs, queries = words
    q = spark.createDataFrame(queries, "qid long, text string")
    df = spark.createDataFrame(docs, "id long, text string")
    index = S.extend_index(S.build_index(df.filter("id < 70")), df.filter("id >= 70"))
    want = rows(S.bm25_top(S.build_index(df), q))
    assert rows(S.bm25_top(index, q)) == want
    again = S.extend_index(index, df.filter("id < 10"))  # all known
    assert again.n_docs == index.n_docs and rows(S.bm25_top(again, q)) == want
    S.save_index(index, "idx", 4)
    loaded = S.load_index(spark, "idx")
    assert rows(S.bm25_top(loaded, q)) == want
    plan = loaded.postings.groupBy("term").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # bucketed by term


@pytest.mark.parametrize("copies", [1, 40])
def test_knn_paths_agree(spark, t, copies):
    """Broadcast, grid and brute force; with copies a third and more of the rows are equal."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    if copies > 1:
        one = e.filter("id = 0").select("v")
        hot = spark.range(10_000, 10_000 + copies * 5).join(F.broadcast(one), how="inner", on=F.lit(True))
        e = e.unionByName(hot.select("id", "v"))
    q = e.filter("id < 60").select(F.col("id").alias("qid"), "v")
    a = DN.knn(q, e, 7)
    b = DN.knn(q, e, 7, broadcast_bytes=0, block_rows=50, base_block_bytes=50 * 64 * 8)
    data = e.orderBy("id").collect()
    m = np.array([r["v"] for r in data], dtype=np.float64)
    ids = [r["id"] for r in data]
    want = []
    for r in q.collect():
        d = np.round(((m - np.array(r["v"])) ** 2).sum(1), 6)
        want += [(r["qid"], i) for _, i in sorted(zip(d, ids))[:7]]
    assert rows(a, "qid", "id") == sorted(want, key=str)
    assert rows(b, "qid", "id") == sorted(want, key=str)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.96])
def test_best_match_paths_agree(spark, t, threshold):
    e = t.embeddings
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    base = e.filter("label < 5").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    a = DN.best_match(q, base, threshold)
    b = DN.best_match(q, base, threshold, broadcast_bytes=0, block_rows=60, base_block_bytes=60 * 64 * 8)
    assert rows(a) == rows(b)
    assert a.filter(F.col("similarity") <= threshold).count() == 0


def test_empty_cache_is_all_misses(spark, t):
    q = t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    hits, misses = HY.cache_split(q, D.cache_entries(t).filter("false"))
    assert hits.count() == 0 and misses.count() == q.count()


def test_ivf_recall(spark, t):
    base = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = base.select(F.col("id").alias("qid"), "v")
    centres = DN.fit_cells(base, 8)
    cells = DN.assign_cells(base, centres)
    exact = {(r["qid"], r["id"]) for r in DN.knn(q, base, 10).collect()}
    near = {(r["qid"], r["id"]) for r in DN.knn_cells(q, cells, centres, 10, probe=6).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    every = {(r["qid"], r["id"]) for r in DN.knn_cells(q, cells, centres, 10, probe=8, block_rows=40)
             .collect()}
    assert every == exact


def test_registered_ivf_recall(t):
    """The query as it is registered, not cells of the test's own."""
    exact = {(r["qid"], r["id"]) for r in RT.knn_l2_top40(t).collect()}
    near = {(r["qid"], r["id"]) for r in RT.knn_ivf(t).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_cells_on_disk(spark, t, tmp_path):
    base = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    centres = DN.fit_cells(base, 4)
    path = str(tmp_path / "cells")
    DN.write_cells(base, centres, path)
    stored = spark.read.schema("id long, v array<float>, cell int").parquet(path)
    assert stored.count() == base.count()
    plan = stored.filter("cell = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_embed_batches_and_retries(spark, tmp_path):
    mark = str(tmp_path / "failed-once")

    def flaky(texts):
        import os
        assert len(texts) <= 15
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("first call fails")
        return [[float(len(x)), 1.0] for x in texts]

    df = spark.range(40).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    got = DN.embed(df.coalesce(1), "text", flaky).collect()
    assert len(got) == 40 and all(r["v"] == [float(r["id"]), 1.0] for r in got)


def test_hash_embed_is_unit_length(spark, t):
    v = DN.hash_embed(t.documents.select("doc_id", "text"), "text", 32).select("v").collect()
    norms = [np.linalg.norm(r["v"]) for r in v]
    assert all(abs(n - 1) < 1e-4 or n == 0 for n in norms)


def test_rerank_paths(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    cand = spark.createDataFrame([(i, c, 100 * i + c) for i in (1, 2, 3) for c in range(12)],
                                 "qid long, cand_idx int, id long")
    scores = spark.createDataFrame(
        [(1, c, 1.0 - c / 100) for c in range(12)] + [(2, c, 0.04) for c in range(12)],
        "qid long, cand_idx int, score double")
    got = rows(HY.apply_rerank(q, cand, scores), "qid", "pos", "id", "status")
    assert [r for r in got if r[0] == 1] == sorted(
        [(1, p + 1, 100 + p, "ranked") for p in range(10)], key=str)
    assert [r for r in got if r[0] == 2] == [(2, 0, None, "fallback")]
    assert [r for r in got if r[0] == 3] == [(3, p + 1, 300 + p, "degraded") for p in range(5)]


# --- chunks --------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n。", max_size=900), st.integers(20, 60), st.integers(0, 15))
def test_recursive_chunks_property(text, size, overlap):
    chunks = K.merge_pieces(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    at = 0
    for c in chunks:  # in order, with white space or at most the overlap between neighbours
        gap = len(text[at:]) - len(text[at:].lstrip())
        pos = next(p for p in range(at + gap, at - overlap - 1, -1) if text.startswith(c, max(p, 0)))
        at = max(at, pos + len(c))
    assert text[at:].strip() == ""


def test_fixed_chunks(spark):
    text = "".join(chr(0x4e00 + i % 3000) for i in range(2450))
    df = spark.createDataFrame([(1, text), (2, "x" * 1200), (3, "y" * 1201), (4, "")],
                               "doc_id long, text string")
    got = {(r["doc_id"], r["chunk_idx"]): r["text"] for r in K.fixed_chunks(df).collect()}
    want = {}
    for i, x in ((1, text), (2, "x" * 1200), (3, "y" * 1201)):
        for n, s in enumerate(range(0, max(len(x) - 200, 1), 1000)):
            want[(i, n)] = x[s:s + 1200]
    assert got == want


MD = "intro\n# A\ntext\n## B\ntext\n### C\n#### D\n## E\nx\n# F\n#no heading\n##### deep"
PATHS = ["通用正文", "A", "A", "A > B", "A > B", "A > B > C", "A > B > C > D", "A > E", "A > E", "F", "F",
         "F"]


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_heading_path(spark, block):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(MD.split("\n"))],
                                  "doc_id long, pos int, line string")
    got = [r["path"] for r in K.heading_path(lines, block).orderBy("pos").collect()]
    assert got == PATHS


def test_sections(spark):
    df = spark.createDataFrame([(1, MD)], "doc_id long, text string")
    got = [(r["path"], r["content"]) for r in K.sections(df).orderBy("section_no").collect()]
    assert [g[0] for g in got] == ["通用正文", "A", "A > B", "A > B > C", "A > B > C > D", "A > E", "F"]
    assert "\n".join(g[1] for g in got) == MD


def test_build_chunks(spark):
    df = spark.createDataFrame(
        [(1, 0, "目 次", "x" * 30), (1, 1, "第一章", "第一章........3 and more text"), (1, 2, "第一章", "short"),
         (1, 3, "第一章", "  第12条 机动车应当\u0007按照规定的速度行驶  "), (2, 0, None, "without a heading or clause")],
        "doc_id long, chunk_idx int, path string, text string")
    got = rows(K.build_chunks(df), "doc_id", "chunk_idx", "text")
    assert got == [(1, 3, "【章节】: 第一章 | 【第12条】\n第12条 机动车应当按照规定的速度行驶"),
                   (2, 0, "【章节】: 通用正文 | 【明细条款】\nwithout a heading or clause")]


# --- sessions, ranks, quiz ----------------------------------------------

def test_session_boundary(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01 00:00:01'),
        (1, TIMESTAMP'2024-01-01 01:00:00'), (1, TIMESTAMP'2024-01-01 02:00:00'),
        (1, TIMESTAMP'2024-01-01 02:59:59.999999') AS t(k, ts)""")
    got = H.inactivity_sessions(df, "k", "ts").orderBy("session_start").collect()
    assert [r["n"] for r in got] == [2, 2]
    # away from the exact boundary (which session_window merges) both agree
    off = df.withColumn("ts", F.when(F.hour("ts") == 2, F.col("ts") + F.expr("INTERVAL 1 SECOND"))
                        .otherwise(F.col("ts")))
    want = off.groupBy("k", F.session_window("ts", "3600 seconds")).count()
    have = H.inactivity_sessions(off, "k", "ts")
    assert sorted(r["count"] for r in want.collect()) == sorted(r["n"] for r in have.collect())


def test_global_rank(spark):
    df = spark.range(500)
    got = R.global_rank(df, "id", "s", digits=1).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    import hashlib
    keys = [hashlib.md5(f"{r['id']}#s".encode()).hexdigest() for r in got]
    assert keys == sorted(keys)


@pytest.mark.parametrize("bank,block", [(8, 4), (37, 4), (200, 16)])
def test_unanswered_brute(spark, bank, block):
    import hashlib
    rnd = random.Random(bank)
    users = list(range(12))
    seen = {u: set() for u in users}
    for u in users[1:]:
        seen[u] = set(rnd.sample(range(bank), rnd.randint(0, bank)))
    seen[11] = set(range(bank))  # a user who has seen everything
    log = [(u, q) for u in users for q in seen[u]] + [(3, q) for q in seen[3]] + [(3, 9999)]
    order = sorted(range(bank), key=lambda q: hashlib.md5(f"{q}#daily".encode()).hexdigest())
    want = [(u, q, i + 1) for u in users
            for i, q in enumerate([q for q in order if q not in seen[u]][:10])]
    got = Q.unanswered(spark.createDataFrame([(u,) for u in users], "user_id long"),
                       spark.range(bank), spark.createDataFrame(log, "user_id long, question_id long"),
                       block=block)
    assert rows(got, "user_id", "question_id", "pos") == sorted(want, key=str)


def test_shuffle_keeps_answer(spark):
    data = [(1, ["A. a", "B. b", "C. c", "D. d"], "C"), (2, ["A. a", "B. a", "C. c", "D. d"], "A"),
            (3, ["A. a", "B. b", "C. c", "D. d"], "E")]
    df = spark.createDataFrame(data, "id int, options array<string>, answer string")
    got = {r["id"]: r["s"] for r in df.select("id", Q.shuffle_options(
        F.col("options"), F.col("answer"), 1).alias("s")).collect()}
    for i, opts, _ in data:
        assert sorted(o[3:] for o in got[i]["options"]) == sorted(o[3:] for o in opts)
        assert [o[0] for o in got[i]["options"]] == list("ABCD")
    right = dict((o[0], o[3:]) for o in got[1]["options"])
    assert right[got[1]["correct_answer"]] == "c"
    twice = [o[0] for o in got[2]["options"] if o[3:] == "a"]
    assert got[2]["correct_answer"] == max(twice)  # the last equal text wins
    assert got[3]["correct_answer"] == "A" and got[3]["matched"] is False


def test_build_questions_skips(spark):
    ok = '{"content":"q","options":["A. a","B. b"],"correct_answer":" b ","explanation":"e"}'
    five = '{"content":"q","options":["A","B","C","D","E"],"correct_answer":"A","explanation":"e"}'
    df = spark.createDataFrame([(1, f"x {ok} y"), (2, five), (3, "none"), (4, '{"content":"q"}')],
                               "id long, response string")
    got = Q.build_questions(df).collect()
    assert [r["id"] for r in got] == [1] and 3 <= got[0]["difficulty"] <= 5
    assert {o[0]: o[3:] for o in got[0]["options"]}[got[0]["correct_answer"]] == "b"


# --- graph ---------------------------------------------------------------

def test_graph_build(spark):
    text = "long enough source text here"
    raw = spark.createDataFrame([
        (1, text, '```json\n[{"s":"a","cat_s":"X","r":"r","t":"b","cat_t":"Y"}]\n```'),
        (2, text, '[{"s":"b","cat_s":"Z","r":"r","t":"b","cat_t":"Z"},{"s":"q"}]'),
        (3, "short", '[{"s":"n","cat_s":"X","r":"r","t":"m","cat_t":"Y"}]'),
        (4, text, "no json"), (5, text, '[{"s":"a","cat_s":"W","r":"r","t":"b","cat_t":"W"}]')],
        "id long, source_text string, response string")
    tr = G.valid_triples(raw)
    nodes, edges = G.nodes(tr), G.edges(tr)
    assert rows(nodes, "name", "category") == [("a", "X"), ("b", "Y")]
    links = G.links(edges, nodes)
    assert rows(links) == [("a", "r", "b"), ("b", "r", "b")]
    gone = nodes.filter("name <> 'a'")
    assert rows(G.links(edges, gone)) == [("b", "r", "b")]


def test_expanded_lines_are_whole(spark):
    """A line per query and link, each text once, and one for a query without any; no pairs of query and name meet."""
    links = [("red a", "r", "blue"), ("blue", "r", "red b"), ("red a", "r", "red b"), ("x -r-> red", "r", "y"),
             ("x", "r", "red -r-> y"), ("green", "r", "grey")]
    df = spark.createDataFrame(links, "source string, value string, target string")
    tk = spark.createDataFrame([(1, "red"), (1, "a"), (2, "blue"), (3, "nowhere")], "qid long, token string")
    got = [tuple(r) for r in G.expanded_lines(tk.select("qid").distinct(), tk, df).collect()]
    line = lambda s, v, t: f"{s} -{v}-> {t}"
    want = {(1, line(*x)) for x in links[:5]} | {(2, line(*x)) for x in links[:2]} | {(3, P.NO_GRAPH_CONTEXT)}
    assert len(got) == len(set(got)) and set(got) == want


def test_graph_context_gives_the_links(spark, data_dir):
    """Every link of a query as a line, not only the classes of names."""
    rows = catalog.queries()["graph_context"](spark, data_dir)
    assert rows.columns == ["qid", "line"]
    links = catalog.queries()["graph_context_links"](spark, data_dir).agg(F.sum("links")).first()[0]
    assert rows.filter(F.col("line") != P.NO_GRAPH_CONTEXT).count() == links
    block = catalog.queries()["context_block"](spark, data_dir)
    assert block.filter("part = '2_graph' and line like '% -%-> %'").count() > 0


def test_classes_expand_to_the_links(spark):
    import random
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab三四 .") for _ in range(n))
    links = [(word(r.randint(1, 9)), "r", word(r.randint(1, 9))) for _ in range(120)] + [("aa", "r", "aa")]
    df = spark.createDataFrame(sorted(set(links)), "source string, value string, target string")
    tokens = [(q, word(r.randint(1, 4))) for q in range(40) for _ in range(3)] + [(50, "nowhere"), (51, ""), (52, "a")]
    tk = spark.createDataFrame(tokens, "qid long, token string")
    q = tk.select("qid").distinct()
    members, classes = G.context_classes(q, tk, G.name_index(df))
    names = {n for s, _, t in links for n in (s, t)}
    want = {(t, n) for _, t in tokens if t for n in names if t in n}
    count = {n: sum(n in (s, t) for s, _, t in set(links)) for n in names}
    assert {tuple(x) for x in classes.collect()} == {(t, n, count[n]) for t, n in want}
    has = {t for t, _ in want}
    own = {(qid, t) for qid, t in tokens if t in has}
    assert {tuple(x) for x in members.collect()} == own | {(x.qid, None) for x in q.collect()
                                                          if x.qid not in {i for i, _ in own}}
    got = [tuple(x) for x in G.expand(members, classes, df).collect()]
    full = {(qid, *link) for qid, t in tokens if t for link in set(links) if t in link[0] or t in link[2]}
    assert len(got) == len(set(got)) and set(got) == full



def test_mentions_brute(spark):
    links = [("red light", "r", "fine"), ("drunk", "r", "red card"), ("x", "y", "z"), ("red", "q", "red")]
    tokens = [(1, "red"), (1, "card"), (2, "fin"), (3, "nothing"), (4, "x")]
    df = spark.createDataFrame(links, "source string, value string, target string")
    tk = spark.createDataFrame(tokens, "qid long, token string")
    names = G.matched_names(tk, df)
    want = {(q, *e) for q, w in tokens for e in links if w in e[0] or w in e[2]}
    assert rows(G.mentions(names, df), "qid", "source", "value", "target") == sorted(want, key=str)
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid long")
    lines = rows(G.context_lines(q, names, df))
    assert (3, P.NO_GRAPH_CONTEXT) in lines and (2, "red light -r-> fine") in lines


# --- changes, prefs, topics, sources -------------------------------------

def test_feedback_false_overwrites_true(spark):
    msgs = spark.createDataFrame([(1, "s"), (2, "s")], "message_id long, session_id string")
    sess = spark.createDataFrame([("s", 7)], "session_id string, user_id long")
    fb = spark.createDataFrame([(1, 7, True, "a", 1), (1, 7, False, "b", 2), (2, 8, True, "c", 1)],
                               "message_id long, user_id long, is_helpful boolean, note string, version long")
    ok, bad = C.split_feedback(fb, msgs, sess)
    assert bad.count() == 1
    got = rows(C.apply_feedback(msgs.select("message_id"), ok))
    assert got == [(1, False, "b"), (2, None, None)]


def test_delete_needs_owner(spark):
    sess = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, user_id long")
    msgs = spark.createDataFrame([(1, "a"), (2, "b")], "message_id long, session_id string")
    req = spark.createDataFrame([("a", 1), ("b", 1)], "session_id string, user_id long")
    s, m = C.delete_sessions(sess, msgs, req)
    assert rows(s, "session_id") == [("b",)] and rows(m, "message_id") == [(2,)]


def test_purge_orphans(spark):
    chunks = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, chunk_idx int")
    docs = spark.createDataFrame([(1,)], "id long")
    assert rows(C.orphans(chunks, docs), "doc_id") == [(2,)]
    assert rows(C.purge_orphans(chunks, docs), "doc_id") == [(1,)]


def test_prefs(spark):
    df = spark.createDataFrame([({"llm_model": "m", "extra": "e"},), (None,)], "p map<string,string>")
    a, b = [r[0] for r in df.select(JN.merge_prefs(F.col("p"))).collect()]
    assert a == {**P.DEFAULT_PREFS, "llm_model": "m", "extra": "e"} and b == P.DEFAULT_PREFS


def test_kmeans_invariants(spark, t):
    v = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    many, cost = TP.cluster(v, 8, n_init=3)
    _, single = TP.cluster(v, 8, n_init=1)
    sizes = [r["count"] for r in many.groupBy("cluster").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == v.count() and cost <= single + 1e-9
    assert TP.cluster(v.limit(9)) is None


def test_topic_refresh(spark, tmp_path):
    path = str(tmp_path / "topics")
    io.replace_rows(spark.createDataFrame([(1, "old")], "id long, topic_name string"), path)
    io.replace_rows(spark.createDataFrame([(2, "new")], "id long, topic_name string"), path)
    got = io.with_schema(spark.read.parquet(path), "hot_topics")
    assert [f.name for f in got.schema.fields][:2] == ["id", "topic_name"]
    assert rows(got, "id", "topic_name") == [(2, "new")]


def test_text_files(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("交通法规 é".encode())
    (tmp_path / "g.txt").write_bytes("交通法规".encode("gbk"))
    got = {r["path"][-5:]: r["text"] for r in io.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"u.txt": "交通法规 é", "g.txt": "交通法规"}


def test_frame_file(spark, tmp_path):
    (tmp_path / "s.txt").write_text(
        'data: {"type":"sources","data":"x"}\n\ndata: {bad\n\n: ping\n\ndata:{"type":"done"}\n\n')
    got = io.read_frames(spark, str(tmp_path))
    assert rows(got, "type", "data") == [("done", None), ("sources", "x")]


def test_declared_schemas(spark, tmp_path):
    from pyspark.sql.types import StructType
    for name, ddl in schemas.TABLES.items():
        path = str(tmp_path / name)
        spark.createDataFrame([], ddl).write.parquet(path)
        assert io.read_table(spark, path, name).schema == StructType.fromDDL(ddl)


def test_written_tables(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = written(spark.range(5))
    assert df.count() == 5
    drop_written(spark)
