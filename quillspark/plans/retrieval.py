"""Sparse, dense and hybrid retrieval, rerank, evidence, cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..operators import blockmax as BM
from ..operators import dense as DN
from ..operators import history as H
from ..operators import hybrid as HY
from ..operators import pqcells as PQ
from ..operators import sparse as S
from ..session import written
from . import derived as D
from .catalog import query
from .joins import graph_lines, stored_links
from .streams import folder

# Oracle building blocks
D.add_ctes(
    corpus_tok=((), r"""
        SELECT doc_id AS id, u.x AS term FROM documents,
               UNNEST(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS u(x)"""),
    post=(("corpus_tok",), "SELECT term, id, count(*) AS tf FROM corpus_tok GROUP BY term, id"),
    dlen=(("corpus_tok",), """
        SELECT d.doc_id AS id, coalesce(c.n, 0) AS dl FROM documents d
        LEFT JOIN (SELECT id, count(*) AS n FROM corpus_tok GROUP BY id) c ON c.id = d.doc_id"""),
    cstat=(("dlen",), "SELECT count(*) AS n_docs, avg(dl) AS avg_len FROM dlen"),
    rawidf=(("post", "cstat"), """
        SELECT term, count(*) AS df,
               ln((any_value(n_docs) - count(*) + 0.5)::DOUBLE) - ln((count(*) + 0.5)::DOUBLE) AS raw
        FROM post, cstat GROUP BY term"""),
    idf=(("rawidf",), """
        SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM rawidf)
                              ELSE raw END AS idf FROM rawidf"""),
    qterms=(("queries_txt",), r"""
        SELECT qid, u.x AS term, count(*) AS qf FROM queries_txt,
               UNNEST(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS u(x) GROUP BY qid, u.x"""),
    bm25=(("post", "dlen", "cstat", "idf", "qterms"), """
        SELECT q.qid, p.id, floor((sum(floor(q.qf * i.idf * (p.tf * 2.5::DOUBLE
                 / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.dl / c.avg_len)))
                 * 1e9::DOUBLE + 0.5::DOUBLE)::BIGINT) + 500)::DOUBLE / 1000.0::DOUBLE)
                 / 1e6::DOUBLE AS score
        FROM qterms q JOIN post p ON q.term = p.term JOIN idf i ON i.term = q.term
        JOIN dlen d ON d.id = p.id, cstat c GROUP BY q.qid, p.id"""),
    bm25_20=(("bm25",), """
        SELECT * FROM (SELECT qid, id, score,
                 row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
          FROM bm25 WHERE score > 0) WHERE rank <= 20"""),
    knn=(("queries_both", "doc_vectors"), """
        SELECT * FROM (SELECT qid, id, dist,
                 row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank
          FROM (SELECT q.qid, d.id, round(list_sum(list_transform(
                  list_zip(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])),
                  lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS dist
                FROM queries_both q, doc_vectors d)) WHERE rank <= 40"""),
    cand=(("knn", "bm25_20"), """
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY src, rank) - 1 AS cand_idx, id FROM (
          SELECT *, row_number() OVER (PARTITION BY qid, h ORDER BY src, rank) AS rn FROM (
            SELECT x.qid, x.id, x.rank, x.src, md5(d.text) AS h FROM (
              SELECT qid, id, rank, 0 AS src FROM knn
              UNION ALL SELECT qid, id, rank, 1 FROM bm25_20) x
            JOIN documents d ON d.doc_id = x.id)) WHERE rn = 1"""),
    scores=(("cand", "queries_both", "doc_vectors"), """
        SELECT c.qid, c.cand_idx, CASE WHEN c.qid % 9 = 8 THEN -1.0::DOUBLE ELSE
                 round(list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])), 6) END
                 AS score
        FROM cand c JOIN queries_both q ON q.qid = c.qid JOIN doc_vectors d ON d.id = c.id
        WHERE c.qid % 11 <> 10"""),
    final=(("scores", "cand", "queries_both"), """
        SELECT s.qid, s.pos, c.id, 'ranked' AS status FROM (
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand_idx) AS pos
          FROM scores) s JOIN cand c ON c.qid = s.qid AND c.cand_idx = s.cand_idx
        WHERE s.pos <= 10 AND s.score >= 0.05
        UNION ALL SELECT qid, cand_idx + 1, id, 'degraded' FROM cand
        WHERE cand_idx < 5 AND qid NOT IN (SELECT qid FROM scores)"""),
)


def corpus(t):
    return t.texts.select(F.col("doc_id").alias("id"), "text")


@query("postings", "SELECT term, id, tf FROM post", ("post",))
def postings(t):
    return S.build_postings(corpus(t)).select("term", "id", "tf")


@query("bm25_stats", """
    SELECT n_docs, round(avg_len, 6) AS avg_len, (SELECT round(avg(raw), 6) FROM rawidf) AS mean_idf,
           (SELECT count(*) FROM rawidf) AS vocabulary, (SELECT sum(df)::BIGINT FROM rawidf) AS postings
    FROM cstat""", ("cstat", "rawidf"))
def bm25_stats(t):
    return S.bm25_stats(S.build_index(corpus(t)))


@query("bm25_scores", "SELECT qid, id, score FROM bm25", ("bm25",))
def bm25_scores(t):
    return S.bm25_scores(S.build_index(corpus(t)), D.queries_txt(t))


@query("bm25_top20", "SELECT qid, id, score, rank FROM bm25_20", ("bm25_20",))
def bm25_top20(t):
    """From stored blocks."""
    r = BM.top(BM.store(corpus(t), folder(t, "blocks")), D.queries_txt(t), P.SPARSE_K)
    return r.withColumn("rank", F.col("rank").cast("bigint"))


@query("bm25_pruned_top20", "SELECT qid, id, score, rank FROM bm25_20", ("bm25_20",))
def bm25_pruned_top20(t):
    """The same where bounds decide which blocks are read, whatever the size of the lists."""
    r = BM.top(BM.store(corpus(t), folder(t, "blocks")), D.queries_txt(t), P.SPARSE_K, direct_rows=0)
    return r.withColumn("rank", F.col("rank").cast("bigint"))


@query("bm25_top5", """
    SELECT * FROM (SELECT qid, id, score,
             row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm25)
    WHERE rank <= 5""", ("bm25",))
def bm25_top5(t):
    r = S.bm25_top(S.build_index(corpus(t)), D.queries_txt(t), 5, positive=False)
    return r.withColumn("rank", F.col("rank").cast("bigint"))


@query("knn_l2_top40", "SELECT qid, id, dist, rank FROM knn", ("knn",))
def knn_l2_top40(t):
    r = DN.knn(D.queries_both(t), D.doc_vectors(t), P.DENSE_K)
    return r.select("qid", "id", "dist", F.col("rank").cast("bigint").alias("rank"))


@query("knn_ivf")
def knn_ivf(t):
    base, path = written(D.doc_vectors(t).select("id", "v")), folder(t, "cells")
    model = PQ.fit(base, 16)
    PQ.store(base, model, path)
    return PQ.search(D.queries_both(t), t.spark, path, model)


@query("knn_ivf_all_cells", "SELECT qid, id, dist, rank FROM knn", ("knn",))
def knn_ivf_all_cells(t):
    """With every cell probed and no codes the result is exact."""
    base = D.doc_vectors(t).select("id", "v")
    centres = DN.fit_cells(base, 16)
    # the cells are counted and read: assign them once
    r = DN.knn_cells(D.queries_both(t), written(DN.assign_cells(base, centres)), centres, probe=16)
    return r.select("qid", "id", "dist", F.col("rank").cast("bigint").alias("rank"))


@query("knn_ivf_recall", "SELECT true AS enough")
def knn_ivf_recall(t):
    """Whether the stored cells give at least nine tenths of the exact neighbours."""
    exact = DN.knn(D.queries_both(t), D.doc_vectors(t), P.DENSE_K).select("qid", "id")
    both = exact.join(knn_ivf(t).select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return both.agg((F.count("hit") >= F.count("*") * 0.9).alias("enough"))


@query("hash_embed")
def hash_embed(t):
    return DN.hash_embed(corpus(t), "text").select("id", F.to_json("v").alias("v"))


@query("hash_embed_shape", """
    SELECT d.doc_id AS id, 256 AS dim, c.id IS NOT NULL AS unit FROM documents d
    LEFT JOIN (SELECT DISTINCT id FROM corpus_tok) c ON c.id = d.doc_id""", ("corpus_tok",))
def hash_embed_shape(t):
    """The vector of a text with tokens has length one, that of any other is zero."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return DN.hash_embed(corpus(t), "text").select(
        "id", F.size("v").alias("dim"), (F.abs(square - 1) < 1e-3).alias("unit"))


class Refused(Exception):
    """What the stand-in for a hosted service raises."""


def service(texts: list[str]) -> list[list[float]]:
    """Two numbers per text; refuses a whole call for one bad text in it."""
    if any(len(x) % 7 == 3 for x in texts):
        raise Refused("a text of this length")
    return [[float(len(x)), 1.0] for x in texts]


@query("embed_dead_letters", """
    SELECT doc_id AS id, CASE WHEN text IS NULL THEN 'no text' WHEN length(text) % 7 = 3 THEN 'refused' ELSE 'embedded'
           END AS outcome, CASE WHEN length(text) % 7 <> 3 THEN length(text)::DOUBLE END AS first FROM documents""")
def embed_dead_letters(t):
    """A service that fails for some texts: these rows carry an error, all others their vector."""
    rows = DN.embed_or_fail(corpus(t), "text", DN.Embedder(service, tries=2))
    return rows.select("id", F.when(F.col("error") == "no text", "no text")
                       .when(F.col("error").startswith("Refused"), "refused")
                       .when(F.col("error").isNull(), "embedded").otherwise(F.col("error")).alias("outcome"),
                       F.get("v", F.lit(0)).cast("double").alias("first"))


def candidates(t):
    return HY.hybrid_candidates(D.queries_both(t), D.doc_vectors(t))


@query("hybrid_candidates", "SELECT qid, cand_idx, id FROM cand", ("cand",))
def hybrid_candidates(t):
    return candidates(t).withColumn("cand_idx", F.col("cand_idx").cast("bigint"))


@query("rerank_jaccard", """
    SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand_idx) AS rank
    FROM (SELECT c.qid, c.cand_idx, c.id, CASE WHEN len(a) + len(b) > 0 THEN round(
              len(list_intersect(a, b))::DOUBLE
              / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) ELSE 0 END AS score
          FROM cand c
          JOIN (SELECT qid, list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS a
                FROM queries_both) q ON q.qid = c.qid
          JOIN (SELECT doc_id, list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS b
                FROM documents) d ON d.doc_id = c.id)
    QUALIFY rank <= 10""", ("cand", "queries_both"))
def rerank_jaccard(t):
    q = D.queries_txt(t).select("qid", F.col("text").alias("query"))
    c = candidates(t)
    wanted = corpus(t).join(c.select("id").distinct(), "id", "left_semi")
    rows = c.join(q, "qid").join(wanted, "id")
    best = HY.rerank(rows, HY.jaccard(F.col("query"), F.col("text")), P.RERANK_TOP_N)
    return best.select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def rerank_scores(t, cand):
    """Deterministic scorer: cosine of the vectors; some questions score badly, some not at all."""
    from ..functions import vectors as V

    q = D.queries_both(t).select("qid", V.as_double(F.col("v")).alias("qv"))
    d = D.doc_vectors(t).select("id", V.as_double(F.col("v")).alias("dv"))
    wanted = d.join(cand.select("id").distinct(), "id", "left_semi")
    rows = cand.filter(F.col("qid") % 11 != 10).join(q, "qid").join(wanted, "id")
    return rows.select("qid", "cand_idx", F.when(F.col("qid") % 9 == 8, F.lit(-1.0)).otherwise(
        F.round(V.cosine(F.col("qv"), F.col("dv")), 6)).alias("score"))


@query("rerank_cutoff", """
    SELECT qid, cand_idx, score FROM scores WHERE coalesce(score, -100) >= 0.05""", ("scores",))
def rerank_cutoff(t):
    s = HY.cutoff(rerank_scores(t, candidates(t)))
    return s.withColumn("cand_idx", F.col("cand_idx").cast("bigint"))


@query("rerank_positional", """
    SELECT s.qid, s.cand_idx, c.id, s.score FROM scores s
    JOIN cand c ON c.qid = s.qid AND c.cand_idx = s.cand_idx""", ("scores", "cand"))
def rerank_positional(t):
    """Score rows carry positions only; the documents come from the candidate list."""
    c = candidates(t)
    joined = c.join(rerank_scores(t, c), ["qid", "cand_idx"])
    return joined.select("qid", F.col("cand_idx").cast("bigint").alias("cand_idx"), "id", "score")


def final_docs(t):
    c = candidates(t)
    return written(HY.apply_rerank(D.queries_both(t), c, written(rerank_scores(t, c))))


@query("rerank_or_fallback", f"""
    SELECT qid, pos, id, status, '' AS answer FROM final
    UNION ALL SELECT qid, 0, -1, 'fallback', '{P.FALLBACK_ANSWER}' FROM queries_both
    WHERE qid NOT IN (SELECT qid FROM final)""", ("final",))
def rerank_or_fallback(t):
    final = final_docs(t)
    return final.join(HY.answers(final), "qid", "left").select(
        "qid", F.col("pos").cast("bigint").alias("pos"), F.coalesce("id", F.lit(-1)).cast("bigint").alias("id"),
        "status", F.coalesce("answer", F.lit("")).alias("answer"))


@query("context_block", """
    WITH tok AS (SELECT DISTINCT qid, u.x AS token FROM queries_both,
                   UNNEST(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS u(x)),
    links AS (SELECT a.name AS source, e.relation AS value, b.name AS target
              FROM edges e JOIN nodes a ON e.source_id = a.node_id
              JOIN nodes b ON e.target_id = b.node_id),
    names AS (SELECT source AS name FROM links UNION SELECT target FROM links),
    hit AS (SELECT DISTINCT qid, name FROM tok JOIN names ON contains(name, token)),
    lines AS (SELECT DISTINCT qid, source || ' -' || value || '-> ' || target AS line
              FROM hit JOIN links ON hit.name = links.source OR hit.name = links.target),
    tail AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back
             FROM msgs),
    hist AS (SELECT CAST(substr(session_id, 2) AS BIGINT) AS qid,
                    string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || content,
                               chr(10) ORDER BY turn) AS history
             FROM tail WHERE back <= 8 GROUP BY session_id),
    ok AS (SELECT DISTINCT qid FROM final)
    SELECT qid, '1_sources' AS part,
           string_agg('[资料' || pos || ']: ' || d.text, chr(10) ORDER BY pos) AS line
    FROM final f JOIN documents d ON d.doc_id = f.id GROUP BY qid
    UNION ALL SELECT qid, '2_graph', line FROM lines WHERE qid IN (SELECT qid FROM ok)
    UNION ALL SELECT qid, '2_graph', '暂无图谱逻辑关联' FROM ok
              WHERE qid NOT IN (SELECT qid FROM lines)
    UNION ALL SELECT qid, '3_history', history FROM hist WHERE qid IN (SELECT qid FROM ok)
    UNION ALL SELECT qid, '4_query', text FROM queries_both WHERE qid IN (SELECT qid FROM ok)
    """, ("final", "nodes", "edges", "msgs", "queries_both"))
def context_block(t):
    final = final_docs(t)
    # only the queries that get an answer are looked up in the graph
    asked = D.queries_both(t).select("qid", "text").join(
        final.filter(F.col("id").isNotNull()).select("qid").distinct(), "qid", "left_semi")
    graph = graph_lines(asked, stored_links(t))
    history = H.transcripts(D.msgs(t)).select(
        F.expr("substring(session_id, 2)").cast("bigint").alias("qid"), "history")
    return HY.evidence(asked, final, corpus(t), graph, history)


# --- cache ---------------------------------------------------------------

D.add_ctes(hits=(("cache_entries",), """
    SELECT qid, key, similarity, answer, thr FROM (
      SELECT *, row_number() OVER (PARTITION BY thr, qid ORDER BY similarity DESC, key) AS rn FROM (
        SELECT t.thr, e.vec_id AS qid, c.key, c.answer, round(list_cosine_similarity(
                 CAST(e.embedding AS DOUBLE[]), CAST(c.v AS DOUBLE[])), 6) AS similarity
        FROM embeddings e, cache_entries c, (VALUES (0.96), (0.5)) t(thr))
      WHERE similarity > thr) WHERE rn = 1"""))


def lookups(t):
    return t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))


@query("semantic_cache_lookup", """
    SELECT qid, key, similarity, answer FROM hits WHERE thr = 0.5""", ("hits",))
def semantic_cache_lookup(t):
    return HY.cache_lookup(lookups(t), D.cache_entries(t), 0.5)


@query("cache_split", """
    SELECT e.vec_id AS qid, CASE WHEN h.qid IS NULL THEN 'retrieve' ELSE 'cache' END AS route,
           coalesce(h.answer, '') AS answer
    FROM embeddings e LEFT JOIN (SELECT * FROM hits WHERE thr = 0.96) h ON h.qid = e.vec_id""",
       ("hits",))
def cache_split(t):
    hits, misses = HY.cache_split(lookups(t), D.cache_entries(t))
    return hits.select("qid", F.lit("cache").alias("route"), "answer").unionByName(
        misses.select("qid", F.lit("retrieve").alias("route"), F.lit("").alias("answer")))
