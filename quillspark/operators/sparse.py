"""Sparse retrieval: inverted index tables and BM25.

The index is ``postings(term, id, tf, dl)`` and ``term_stats(term, df, cf)``
plus three numbers about the corpus. A saved index is bucketed by term.

An index that has just been built is stored with one row per document. A task scores its
documents there and keeps the best of every query, so (query, document) pairs never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .. import params as P
from ..functions.text import tokenize
from ..session import written
from .ranking import top_n

# Posting rows that a query set may read before pruning pays off: reading takes two microseconds of a core per
# row and moves sums only, while pruning reads the lists up to three times.
DIRECT_ROWS = 4_000_000_000
UNIT = 1e9
# Weights of query terms that are broadcast (32 MB), and queries of a score matrix of CELLS numbers.
BROADCAST_WEIGHTS = 500_000
BROADCAST_QUERIES = 10_000
CELLS = 1 << 20
# Tokens never hold this character; a run is one token repeated.
SEP = "\u0001"
RUN = f"([^{SEP}]+)(?:{SEP}\\1)*(?={SEP}|$)"


@dataclass
class SparseIndex:
    postings: DataFrame
    term_stats: DataFrame
    n_docs: int
    avg_len: float
    mean_idf: float
    #: The same postings with one row (id, dl, entries) per document, where they are stored so.
    rows: DataFrame | None = None


def build_postings(docs: DataFrame, tokenizer=None, keep: tuple[str, ...] = (), mark: bool = False) -> DataFrame:
    """(id, text) -> (term, id, tf, dl) and the columns to ``keep``.

    A document's tokens are sorted, joined and matched as runs of one repeated
    token, all inside its row: building the postings moves nothing between
    tasks, and the counts follow from the lengths of the runs. With ``mark``,
    each document adds one row without a term, so that documents can be counted.
    """
    toks = docs.select("id", *keep, F.sort_array(tokenize(F.col("text"), tokenizer)).alias("ts"))
    runs = F.regexp_extract_all(F.array_join("ts", SEP), F.lit(RUN), F.lit(0))
    if mark:
        runs = F.concat(F.coalesce(runs, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    term = F.substring_index("run", SEP, 1)
    tf = ((F.length("run") + 1) / (F.length(term) + 1)).cast("bigint")
    return (toks.select("id", *keep, F.size("ts").alias("dl"), F.explode(runs).alias("run"))
            .select(term.alias("term"), "id", tf.alias("tf"), "dl", *keep))


def build_rows(docs: DataFrame, tokenizer=None) -> DataFrame:
    """(id, text) -> (id, dl, entries): the postings of ``build_postings`` as a list in their document's row."""
    toks = docs.select("id", F.sort_array(tokenize(F.col("text"), tokenizer)).alias("ts"))
    runs = toks.select("id", F.size("ts").alias("dl"),
                       F.regexp_extract_all(F.array_join("ts", SEP), F.lit(RUN), F.lit(0)).alias("runs"))

    def entry(run):
        term = F.substring_index(run, SEP, 1)
        return F.struct(term.alias("term"), ((F.length(run) + 1) / (F.length(term) + 1)).cast("bigint").alias("tf"))

    return runs.select("id", "dl", F.transform("runs", entry).alias("entries"))


def _opened(rows: DataFrame) -> DataFrame:
    return rows.select("id", "dl", F.explode("entries").alias("e")).select("e.term", "id", "e.tf", "dl")


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + F.lit(0.5)) - F.log(df + F.lit(0.5))


def summarise(postings: DataFrame, n_docs: int, rows: DataFrame | None = None) -> SparseIndex:
    """Statistics of written postings; only two numbers reach the driver."""
    stats = written(postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    sums = stats.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("tokens"),
                     F.coalesce(F.avg(raw_idf(F.lit(n_docs), F.col("df"))), F.lit(0.0))
                     .alias("mean")).first()
    return SparseIndex(postings, stats, n_docs, sums["tokens"] / max(n_docs, 1), sums["mean"], rows)


def build_index(docs: DataFrame, tokenizer=None) -> SparseIndex:
    """Index of (id, text). The postings are written once, then everything reads them."""
    rows = written(build_rows(docs, tokenizer), "zstd")
    return summarise(_opened(rows), rows.count(), rows)


def extend_index(index: SparseIndex, docs: DataFrame, tokenizer=None) -> SparseIndex:
    """Only the new documents are tokenised; the statistics are taken anew.

    Documents whose ids have postings are in the index and are left as they are.
    A document without tokens has none, so it must not be given twice.
    """
    fresh = written(docs.join(index.postings.select("id").distinct(), "id", "left_anti"))
    both = index.postings.unionByName(written(build_postings(fresh, tokenizer)))
    return summarise(both, index.n_docs + fresh.count())


def save_index(index: SparseIndex, table: str, buckets: int) -> None:
    """Tables bucketed by term: scoring then joins without moving the postings."""
    for name, df in (("postings", index.postings), ("terms", index.term_stats)):
        (df.write.bucketBy(buckets, "term").sortBy("term").mode("overwrite")
         .saveAsTable(f"{table}_{name}"))
    spark = index.postings.sparkSession
    row = [(index.n_docs, index.avg_len, index.mean_idf)]
    (spark.createDataFrame(row, "n_docs BIGINT, avg_len DOUBLE, mean_idf DOUBLE")
     .write.mode("overwrite").saveAsTable(f"{table}_corpus"))


def load_index(spark, table: str) -> SparseIndex:
    c = spark.table(f"{table}_corpus").first()
    return SparseIndex(spark.table(f"{table}_postings"), spark.table(f"{table}_terms"),
                       c["n_docs"], c["avg_len"], c["mean_idf"])


def query_terms(queries: DataFrame, tokenizer=None) -> DataFrame:
    """(qid, text) -> (qid, term, qf): repeated tokens count repeatedly."""
    return (queries.select("qid", F.explode(tokenize(F.col("text"), tokenizer)).alias("term"))
            .groupBy("qid", "term").agg(F.count("*").alias("qf")))


def _weights(index: SparseIndex, terms: DataFrame, epsilon: float) -> DataFrame:
    """Query terms with df and idf. A negative idf is replaced by ``epsilon`` times
    the mean idf of the whole vocabulary, negative ones included."""
    raw = raw_idf(F.lit(index.n_docs), F.col("df"))
    idf = F.when(raw < 0, F.lit(epsilon * index.mean_idf)).otherwise(raw)
    return terms.join(index.term_stats, "term").select("qid", "term", "qf", "df", idf.alias("idf"))


def _part(index: SparseIndex, k1: float, b: float) -> Column:
    """One term's share of a document's score, as a whole number of 1e-9 units.

    Whole numbers add up alike in any order, so scores and ranks do not depend
    on how the shuffle happened to deliver the rows.
    """
    length = F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(index.avg_len)
    tf = F.col("tf")
    share = F.col("qf") * F.col("idf") * (tf * F.lit(k1 + 1) / (tf + F.lit(k1) * length))
    return F.floor(share * F.lit(UNIT) + F.lit(0.5))


def _parts(index: SparseIndex, weighted: DataFrame, k1: float, b: float) -> DataFrame:
    return index.postings.join(weighted, "term").withColumn("part", _part(index, k1, b))


def bm25_scores(index: SparseIndex, queries: DataFrame, k1: float = P.BM25_K1, b: float = P.BM25_B,
                epsilon: float = P.BM25_EPSILON, tokenizer=None) -> DataFrame:
    """(qid, id, score) of every document that shares a term with the query."""
    weighted = _weights(index, query_terms(queries, tokenizer), epsilon)
    return _scored(_parts(index, weighted, k1, b))


def _scored(parts: DataFrame) -> DataFrame:
    return parts.groupBy("qid", "id").agg(_rounded(F.sum("part")).alias("score"))


def _rounded(total: Column) -> Column:
    return F.floor((total + 500) / F.lit(1000.0)) / F.lit(1e6)


def bm25_top(index: SparseIndex, queries: DataFrame, n: int = P.SPARSE_K, positive: bool = True,
             k1: float = P.BM25_K1, b: float = P.BM25_B, epsilon: float = P.BM25_EPSILON,
             direct_rows: int = DIRECT_ROWS, tokenizer=None) -> DataFrame:
    """Exact top ``n`` per query: (qid, id, score, rank), by rounded score, ties by id.

    ``positive`` keeps scores above 0 only. When the query terms' posting lists
    add up to more than ``direct_rows``, the longest lists are left unread.
    """
    weighted = written(_weights(index, query_terms(queries, tokenizer), epsilon))
    asked = weighted.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("volume"), F.count("*").alias("weights"),
                         F.count("idf").alias("known"), F.countDistinct("qid").alias("queries")).first()
    if asked["volume"] > direct_rows:
        scores = _pruned_scores(index, weighted, n, k1, b)
    elif (index.rows is not None and asked["weights"] == asked["known"] <= BROADCAST_WEIGHTS
          and asked["queries"] <= BROADCAST_QUERIES):
        scores = _row_scores(index, weighted, n, positive, k1, b)
    else:
        scores = _scored(_parts(index, weighted, k1, b))
    if positive:
        scores = scores.filter(F.col("score") > 0)
    return top_n(scores, ["qid"], [F.desc("score"), "id"], n)


def _row_scores(index: SparseIndex, weighted: DataFrame, n: int, positive: bool, k1: float, b: float) -> DataFrame:
    """Scores that hold the best ``n`` of every query, taken in the tasks that have the documents.

    An id that has several documents has the sum of their scores; these few are brought together.
    """
    again = written(index.rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    if again.isEmpty():
        return _task_best(index, index.rows, weighted, n, positive, k1, b)
    several = again.withColumnRenamed("id", "again")
    same = index.rows["id"].eqNullSafe(several["again"])
    alone = _task_best(index, index.rows.join(several, same, "left_anti"), weighted, n, positive, k1, b)
    shared = _opened(index.rows.join(several, same, "left_semi")).join(weighted, "term")
    return alone.unionByName(_scored(shared.withColumn("part", _part(index, k1, b))))


def _task_best(index: SparseIndex, rows: DataFrame, weighted: DataFrame, n: int, positive: bool, k1: float,
               b: float) -> DataFrame:
    """(qid, id, score) of every task's best ``n`` per query and all that are as good as the last of them."""
    w = weighted.select("qid", "term", "qf", "idf").toArrow()  # counted by the caller
    qid, term = (w.column(c).combine_chunks().dictionary_encode("encode") for c in ("qid", "term"))
    code = term.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    counts = np.bincount(code, minlength=len(term.dictionary))
    factor = w.column("qf").to_numpy()[order] * w.column("idf").to_numpy()[order]
    query = qid.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(
        (qid.dictionary, term.dictionary, counts, np.cumsum(counts) - counts, query, factor))
    avg_len, unit = index.avg_len, UNIT
    schema = StructType([StructField("qid", weighted.schema["qid"].dataType), rows.schema["id"],
                         StructField("part", LongType())])
    out = to_arrow_schema(schema)

    def parts(entries: pa.Array, dl: np.ndarray):
        """(document, query, part) of a batch, about ``CELLS`` at a time; the numbers are those of ``_part``."""
        _, terms, counts, starts, query, factor = shared.value
        doc = np.repeat(np.arange(len(entries)), pc.fill_null(pc.list_value_length(entries), 0).to_numpy(
            zero_copy_only=False))
        flat = entries.flatten()
        code = pc.fill_null(pc.index_in(pc.struct_field(flat, "term"), value_set=terms), -1).to_numpy(
            zero_copy_only=False)
        held = np.flatnonzero(code >= 0)
        code, doc = code[held], doc[held]
        tf = pc.struct_field(flat, "tf").to_numpy(zero_copy_only=False)[held]
        weight = tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl[doc] / avg_len))
        so_far = np.cumsum(counts[code])
        lo = 0
        while lo < len(code):
            done = so_far[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(so_far, done + CELLS, "right")))
            own = counts[code[lo:hi]]
            posting = np.repeat(np.arange(lo, hi), own)
            at = np.arange(len(posting)) - np.repeat(np.cumsum(own) - own, own) + starts[code[posting]]
            yield doc[posting], query[at], np.floor(factor[at] * weight[posting] * unit + 0.5).astype(np.int64)
            lo = hi

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = len(shared.value[0])
        best = np.full((queries, n), -np.inf)
        step = max(1, CELLS // max(1, queries))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                some = batch.slice(first, step)
                width = some.num_rows
                sums, met = np.zeros(queries * width, np.int64), np.zeros(queries * width, bool)
                for doc, query, part in parts(some.column("entries"), some.column("dl").to_numpy(zero_copy_only=False)):
                    np.add.at(sums, query * width + doc, part)
                    met[query * width + doc] = True
                score = np.floor((sums + 500) / 1000.0)
                score[~met | (score <= 0) if positive else ~met] = -np.inf
                score = score.reshape(queries, width)
                both = np.concatenate([best, score], axis=1)
                best = np.partition(both, width, axis=1)[:, width:]
                # ties are told apart by id, later
                q, d = np.nonzero((score >= best.min(axis=1)[:, None]) & (score > -np.inf))
                if len(q):
                    yield pa.RecordBatch.from_arrays(
                        [shared.value[0].take(pa.array(q)).cast(out.field(0).type),
                         some.column("id").take(pa.array(d)), pa.array(sums[q * width + d])], schema=out)

    found = rows.select("id", "dl", "entries").mapInArrow(scan, schema)
    return found.select("qid", "id", _rounded(F.col("part")).alias("score"))


def _pruned_scores(index: SparseIndex, weighted: DataFrame, n: int, k1: float, b: float,
                   seed_share: float = 0.1) -> DataFrame:
    """Full scores of all documents that can be among a query's best ``n``.

    1. A query's rarest terms (about ``seed_share`` of its postings) give
       partial scores; the n-th best, less what negative terms can take away, is
       a floor under the true n-th score.
    2. A document that holds only the commonest terms cannot reach the floor
       when the upper bounds of those terms add up to less. Only the other
       ("essential") terms' postings are read, and they raise the floor again.
    3. The few documents that can still reach it get their remaining terms by
       an equality join on (term, id), which has no hot keys.
    """
    slack = 1e-5 * UNIT
    bound = F.col("qf") * F.col("idf") * F.lit((k1 + 1) * UNIT)
    whole = W.partitionBy("qid")
    rare_first = whole.orderBy(F.desc("idf"), "term")
    after = rare_first.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = rare_first.rowsBetween(W.unboundedPreceding, -1)
    w = (weighted.withColumn("ub", F.greatest(bound, F.lit(0.0)))
         .withColumn("drop_all", F.sum(F.least(bound, F.lit(0.0))).over(whole))
         .withColumn("from_here", F.sum("ub").over(after))
         .withColumn("seed", (F.col("idf") > 0) & (
             F.coalesce(F.sum("df").over(before), F.lit(0))
             <= F.sum("df").over(whole) * seed_share)))

    def floors(partial):
        nth = top_n(partial, ["qid"], [F.desc("s"), "id"], n, "r").filter(F.col("r") == n)
        return nth.select("qid", (F.col("s") + F.col("drop_all") - slack).alias("floor"))

    def partial_scores(terms):
        return (_parts(index, terms, k1, b).groupBy("qid", "id")
                .agg(F.sum("part").alias("s"), F.max("drop_all").alias("drop_all"),
                     F.max("rest_ub").alias("rest_ub")))

    lowest = F.lit(float("-inf"))
    seeds = w.filter("seed").withColumn("rest_ub", F.lit(0.0))
    w = w.join(floors(partial_scores(seeds)), "qid", "left").withColumn(
        "essential", F.col("from_here") >= F.coalesce("floor", lowest))
    rest_ub = F.sum(F.when(~F.col("essential"), F.col("ub"))).over(whole)
    w = written(w.withColumn("rest_ub", F.coalesce(rest_ub, F.lit(0.0))).drop("floor"))

    scored = partial_scores(w.filter("essential"))
    kept = (scored.join(floors(scored), "qid", "left")
            .filter(F.col("s") + F.col("rest_ub") >= F.coalesce("floor", lowest)))
    kept = written(kept.select("qid", "id", "s"))
    others = w.filter(~F.col("essential")).select("qid", "term", "qf", "idf")
    rest = (kept.select("qid", "id").join(others, "qid").join(index.postings, ["term", "id"])
            .select("qid", "id", _part(index, k1, b).alias("part")))
    return _scored(kept.select("qid", "id", F.col("s").alias("part")).unionByName(rest))


def bm25_stats(index: SparseIndex) -> DataFrame:
    return index.term_stats.agg(
        F.lit(index.n_docs).cast("bigint").alias("n_docs"),
        F.round(F.lit(index.avg_len), 6).alias("avg_len"),
        F.round(F.lit(index.mean_idf), 6).alias("mean_idf"),
        F.count("*").alias("vocabulary"), F.sum("df").alias("postings"))
