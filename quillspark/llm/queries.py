"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import (codes, exact_dedup, language, licenses, merkle, mixing, negatives, ngram_lm, packing, quality, shards,
               simhash, token_files)
from .tables import prepared, read

SHARDS = 40
SEQUENCE = 4096


def op1_backoff_lm(spark: SparkSession, root: str) -> DataFrame:
    return ngram_lm.score(read(spark, root, "documents"))


def op2_nearest_codes(spark: SparkSession, root: str) -> DataFrame:
    return codes.nearest(read(spark, root, "embeddings"), F.col("key") % 20 == 0)


def domains(docs: DataFrame) -> dict[str, Column]:
    """The tree of a mixture: domains are groups of sources."""
    domain = F.concat(F.lit("domain"), F.crc32(F.encode(docs["source"].cast("string"), "utf-8")) % 4)
    return {"domain": domain, "lang": docs["lang"], "source": docs["source"]}


#: English counts double among the languages of a domain.
LANGUAGE_WEIGHTS = {(f"domain{i}", "en"): 2.0 for i in range(4)}


def op3_mixture(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    return mixing.select(docs, domains(docs), LANGUAGE_WEIGHTS, 0.6, 2, 20240519).select(
        "doc.doc_id", "leaf.domain", "leaf.lang", "leaf.source", "epoch", F.col("budget").alias("leaf_budget"),
        mixing.tokens_in(F.col("doc.text")).alias("tokens"))


def op4_token_files(spark: SparkSession, root: str, tokenizer: str | None = None) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    token_files.write(read(spark, root, "documents"), path,
                      tokenizer or public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.checksums(token_files.read_tokens(spark, path))


def op5_best_fit_packing(spark: SparkSession, root: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(read(spark, root, "documents"),
                        tokenizer or public_tokenizers.path("word_bpe_49k.json"), 1, SEQUENCE)


def op6_quality(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    return quality.score(docs, quality.fit(docs, quality.grades(read(spark, root, "labels"))))


def op7_language(spark: SparkSession, root: str, pieces: str | None = None) -> DataFrame:
    docs = read(spark, root, "documents")
    return language.predict(docs, language.fit(docs, pieces or public_tokenizers.path("piece_bpe_32k.model")))


def op8_sharding(spark: SparkSession, root: str) -> DataFrame:
    return shards.place(read(spark, root, "documents"), shards.Tree.even(4, 2, 5), SHARDS)


def op9_simhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_groups(read(spark, root, "documents"))


def op10_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return exact_dedup.duplicate_groups(read(spark, root, "documents"))


def op11_merkle(spark: SparkSession, root: str) -> DataFrame:
    return merkle.manifest(read(spark, root, "documents"))


def op12_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.integers(read(spark, root, "embeddings"), "vec_id", "embedding", label, 256)
    return negatives.mine(rows, F.col("id") % 100 == 0)


def op13_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(read(spark, root, "documents"))


_QUERIES = (op1_backoff_lm, op2_nearest_codes, op3_mixture, op4_token_files, op5_best_fit_packing, op6_quality,
            op7_language, op8_sharding, op9_simhash_near_dedup, op10_exact_dedup,
            op11_merkle, op12_hard_negatives, op13_license_scan)

ORACLE_SQL = {
    "op2_nearest_codes": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS row, embedding::DOUBLE[] AS e FROM embeddings),
             s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
                   FROM v q JOIN v c ON c.row <> q.row WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY row ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
                   FROM documents),
             g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
                          count(*) OVER (PARTITION BY norm) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op11_merkle": r"""
        WITH RECURSIVE
        d AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                     || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                     || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                     translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
                     xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
                         string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                         lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS crc
              FROM documents),
        leaf AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
                        sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
                        CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(small) || ':' || small, '-')) END
                        AS altered FROM d),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
                          count(*) OVER (PARTITION BY g) AS n FROM leaf),
        tree AS (SELECT g, 0 AS level, i, h, n FROM placed
                 UNION ALL
                 SELECT g, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM tree
                 WHERE n > 1 GROUP BY g, level, i // 8, n),
        upper AS (SELECT 0 AS level, g AS i, h, count(*) OVER () AS n FROM tree WHERE n = 1
                  UNION ALL
                  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM upper
                  WHERE n > 1 GROUP BY level, i // 8, n),
        runs AS (SELECT g, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM tree WHERE n > 1
                 GROUP BY g, level, i // 8),
        upper_runs AS (SELECT level, i // 8 AS run, list(h ORDER BY i) AS hs FROM upper WHERE n > 1
                       GROUP BY level, i // 8),
        fold AS (SELECT doc_id, g, i, h AS leaf, 0 AS level, '' AS proof, coalesce(altered, h) AS f FROM placed
                 UNION ALL
                 SELECT doc_id, g, i // 8, leaf, level + 1,
                        proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], ''),
                        sha256(array_to_string(hs[:i % 8], '') || f || array_to_string(hs[i % 8 + 2:], ''))
                 FROM fold JOIN runs USING (g, level) WHERE run = i // 8),
        under AS (SELECT f.* FROM fold f JOIN tree t ON t.g = f.g AND t.n = 1 AND t.level = f.level),
        above AS (SELECT doc_id, g, g AS i, leaf, 0 AS level, proof, f FROM under
                  UNION ALL
                  SELECT doc_id, g, i // 8, leaf, level + 1,
                         proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], ''),
                         sha256(array_to_string(hs[:i % 8], '') || f || array_to_string(hs[i % 8 + 2:], ''))
                  FROM above JOIN upper_runs USING (level) WHERE run = i // 8)
        SELECT a.doc_id, a.leaf, t.h AS subroot, u.h AS root, sha256(a.proof) AS proof_sha256,
               a.f AS folded_root, a.f = u.h AS verified
        FROM above a JOIN upper u ON u.n = 1 AND u.level = a.level JOIN tree t ON t.g = a.g AND t.n = 1""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS row,
                          CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.row, a.vec_id AS anchor_id, o.row AS other, o.vec_id, a.label = o.label AS same,
                          CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score
                   FROM v a JOIN v o ON o.row <> a.row AND len(o.e) = len(a.e) WHERE a.vec_id % 100 = 0),
             p AS (SELECT * FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id, other) <= 5),
             n AS (SELECT p.row, p.other, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id,
                          p.score AS positive_score, s.score AS negative_score, CAST(row_number() OVER (
                              PARTITION BY p.row, p.other ORDER BY s.score DESC, s.vec_id, s.other) AS INTEGER) AS rank
                   FROM p JOIN s ON s.row = p.row AND NOT s.same
                   WHERE 80 * p.score <= 100 * s.score AND s.score <= p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, root, f=f: f(prepared(spark), root)) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
