"""Sparse retrieval from stored blocks of postings, of which a query reads only those that matter.

Documents are numbered in id order and cut into slices. A block holds the postings of
one term in one slice, sorted by id, with its id range and its largest impact (the
share of a score at weight one). A term that is in every document is one small block
per slice, and slices are dealt to all partitions of the stored table, so no task holds its list.

A query gets the exact best n in steps, each of which reads less per row than the next:

1. its rarest terms give partial scores, and the n-th best of these a floor;
2. terms whose bounds together stay below the floor can't lift a document over it
   alone, so only slices that hold another term are looked at;
3. of those, the largest impacts of the blocks in a slice bound all scores in it;
4. the slices of the highest bounds are scored and raise the floor; then those that
   still reach it. Only these blocks' postings are read.

Scores are the same whole numbers that the posting table gives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.text import tokenize
from ..session import written
from .ranking import top_n
from .sparse import DIRECT_ROWS, UNIT, _part, _scored, _weights, query_terms, raw_idf

SLICE_DOCS = 256
#: Postings per partition of the stored table.
PART_POSTINGS = 20_000_000
#: Tokens that one task makes into blocks.
TASK_TOKENS = 4_000_000
#: Slices that a query scores before its floor is raised.
FIRST_SLICES = 8
SEED_SHARE = 0.1
SLACK = 1e-5 * UNIT


@dataclass
class BlockIndex:
    """blocks (term, slice, part, lo, hi, n, cf, impact, entries), term_stats (term, df, cf, impact) and three numbers."""

    blocks: DataFrame
    term_stats: DataFrame
    n_docs: int
    avg_len: float
    mean_idf: float


def _slice_blocks(avg_len: float, k1: float, b: float):
    """The blocks of one slice, from its documents (id, ts, slice, part)."""
    def blocks(docs: pa.Table) -> pa.Table:
        docs = docs.take(pc.sort_indices(docs.column("id"), null_placement="at_start")).combine_chunks()
        lists = docs.column("ts").combine_chunks()
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a term in a document is a run of one number
        pair, tf = np.unique(code * max(1, len(length)) + np.repeat(np.arange(len(length)), length), return_counts=True)
        code, at = np.divmod(pair, max(1, len(length)))
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        ends = np.append(starts[1:], len(code))
        dl = length[at]
        impact = tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / avg_len)) if len(tf) else np.zeros(0)
        ids = docs.column("id").combine_chunks()
        held = ids.take(pa.array(at))
        # rows without an id come first
        named = np.append(0, np.cumsum(at >= ids.null_count))
        first = np.minimum(ends - (named[ends] - named[starts]), ends - 1)
        n = len(starts)
        return pa.table({
            "term": coded.dictionary.take(pa.array(code[starts])),
            "slice": pa.repeat(docs.column("slice")[0], n),
            "lo": held.take(pa.array(first)), "hi": held.take(pa.array(ends - 1)),
            "n": pa.array(ends - starts), "cf": pa.array(np.add.reduceat(tf, starts) if n else tf),
            "impact": pa.array(np.maximum.reduceat(impact, starts) if n else impact),
            "entries": pa.ListArray.from_arrays(
                pa.array(np.append(starts, len(code)), pa.int32()),
                pa.StructArray.from_arrays([held, pa.array(tf), pa.array(dl, pa.int32())], names=["id", "tf", "dl"])),
            "part": pa.repeat(docs.column("part")[0], n)})

    return blocks


def store(docs: DataFrame, path: str, tokenizer=None, k1: float = P.BM25_K1, b: float = P.BM25_B,
          slice_docs: int = SLICE_DOCS, part_postings: int = PART_POSTINGS) -> BlockIndex:
    """Write the index of (id, text) to ``path``. Impacts are those of ``k1`` and ``b``."""
    spark = docs.sparkSession
    docs = written(docs.select("id", tokenize(F.col("text"), tokenizer).alias("ts")))  # counted, then placed
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.size("ts"), F.lit(0))), F.lit(0))
                    .alias("tokens")).first()
    avg_len = size["tokens"] / max(size["n"], 1)
    parts = max(1, -(-size["tokens"] // part_postings))
    tasks = max(parts, _partitions(spark), -(-size["tokens"] // TASK_TOKENS))
    # a slice is whole in one task, so its blocks are put together there and no posting moves
    placed = (docs.repartitionByRange("id").sortWithinPartitions("id")
              .withColumn("slice", F.expr(f"monotonically_increasing_id() div {slice_docs}"))
              .withColumn("part", F.pmod("slice", F.lit(parts)).cast("int"))
              .withColumn("deal", F.pmod(F.floor(F.col("slice") / parts), F.lit(max(8, -(-tasks // parts)))))
              .repartition(tasks, "part", "deal"))
    id_type = docs.schema["id"].dataType.simpleString()
    schema = (f"term string, slice bigint, lo {id_type}, hi {id_type}, n bigint, cf bigint, impact double, "
              f"entries array<struct<id:{id_type},tf:bigint,dl:int>>, part int")
    blocks = placed.groupBy("part", "deal", "slice").applyInArrow(_slice_blocks(avg_len, k1, b), schema)
    (blocks.sortWithinPartitions("part", "term", "slice")
     .write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks"))
    # a table without rows has no file to tell its columns
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/columns")
    (_blocks(spark, path).groupBy("term")
     .agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.max("impact").alias("impact"))
     .write.mode("overwrite").parquet(f"{path}/terms"))
    mean = spark.read.parquet(f"{path}/terms").agg(
        F.coalesce(F.avg(raw_idf(F.lit(size["n"]), F.col("df"))), F.lit(0.0)).alias("mean")).first()["mean"]
    row = [(size["n"], avg_len, mean, parts)]
    (spark.createDataFrame(row, "n_docs BIGINT, avg_len DOUBLE, mean_idf DOUBLE, parts INT")
     .write.mode("overwrite").parquet(f"{path}/corpus"))
    return load(spark, path)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/blocks")


def load(spark: SparkSession, path: str) -> BlockIndex:
    c = spark.read.parquet(f"{path}/corpus").first()
    return BlockIndex(_blocks(spark, path), spark.read.parquet(f"{path}/terms"), c["n_docs"], c["avg_len"], c["mean_idf"])


def _read(index: BlockIndex, own: DataFrame, wanted: DataFrame, k1: float, b: float) -> DataFrame:
    """(qid, id, part score) of the postings in the blocks of ``own`` (qid, term, qf, idf) in the slices ``wanted``
    (qid, slice). Blocks are chosen whole, then opened."""
    asked = wanted.groupBy("slice").agg(F.collect_set("qid").alias("qids"))
    # a block moves at most once, whatever the number of queries
    held = (index.blocks.select("term", "slice", "entries").join(own.select("term").distinct(), "term", "left_semi")
            .join(asked, "slice"))
    return (held.join(own, "term").filter(F.array_contains("qids", F.col("qid")))
            .select("qid", "qf", "idf", F.explode("entries").alias("e"))
            .select("qid", "qf", "idf", "e.*").select("qid", "id", _part(index, k1, b).alias("part")))


def _read_terms(index: BlockIndex, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """The same for whole terms (qid, term, qf, idf)."""
    return (index.blocks.select("term", "entries").join(terms, "term")
            .select("qid", "qf", "idf", F.explode("entries").alias("e"))
            .select("qid", "qf", "idf", "e.*").select("qid", "id", _part(index, k1, b).alias("part")))


def top(index: BlockIndex, queries: DataFrame, n: int = P.SPARSE_K, positive: bool = True, k1: float = P.BM25_K1,
        b: float = P.BM25_B, epsilon: float = P.BM25_EPSILON, direct_rows: int = DIRECT_ROWS, tokenizer=None,
        seen: list[DataFrame] | None = None) -> DataFrame:
    """Exact top ``n`` per query: (qid, id, score, rank), by rounded score, ties by id.

    When the query terms' lists add up to at most ``direct_rows`` postings, they are simply read.
    ``seen`` collects the tables of blocks that were asked for, for tests and reports.
    """
    weighted = written(_weights(index, query_terms(queries, tokenizer), epsilon))
    volume = weighted.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    if volume <= direct_rows:
        scores = _scored(_read_terms(index, weighted, k1, b))
    else:
        scores = _scored(_pruned(index, weighted, n, k1, b, seen))
    if positive:
        scores = scores.filter(F.col("score") > 0)
    return top_n(scores, ["qid"], [F.desc("score"), "id"], n)


def _floors(scores: DataFrame, n: int) -> DataFrame:
    """The n-th best score per query, a hair less."""
    nth = top_n(scores, ["qid"], [F.desc("s"), "id"], n, "r").filter(F.col("r") == n)
    return nth.select("qid", (F.col("s") - SLACK).alias("floor"))


def _bounded(weighted: DataFrame, terms: DataFrame) -> DataFrame:
    """Query terms, rarest first, with what each can add at most and what all after it can."""
    most = F.col("qf") * F.col("idf") * F.col("impact") * F.lit(UNIT) + 1
    least = F.col("qf") * F.col("idf") * F.lit((P.BM25_K1 + 1) * UNIT)
    whole = W.partitionBy("qid")
    order = whole.orderBy(F.desc("idf"), "term")
    return (weighted.join(terms.select("term", "impact"), "term")
            .withColumn("most", F.greatest(most, F.lit(0.0)))
            .withColumn("drop_all", F.sum(F.least(least, F.lit(0.0))).over(whole))
            .withColumn("from_here", F.sum("most").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
            .withColumn("before", F.coalesce(F.sum("df").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("seed", (F.col("idf") > 0) & (F.col("before") <= F.sum("df").over(whole) * SEED_SHARE))
            .drop("before", "impact"))


def _pruned(index: BlockIndex, weighted: DataFrame, n: int, k1: float, b: float,
            seen: list[DataFrame] | None) -> DataFrame:
    """(qid, id, part) of all documents that can be among a query's best ``n``."""
    lowest = F.lit(float("-inf"))
    terms = written(_bounded(weighted, index.term_stats))
    seeds = terms.filter("seed")
    partial = _read_terms(index, seeds.select("qid", "term", "qf", "idf"), k1, b)
    summed = partial.groupBy("qid", "id").agg(F.sum("part").alias("s"))
    floors = _floors(summed, n).join(terms.select("qid", "drop_all").distinct(), "qid").select(
        "qid", (F.col("floor") + F.col("drop_all")).alias("floor"))
    terms = written(terms.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", lowest))
                    .withColumn("essential", F.col("from_here") >= F.col("floor")))

    own = terms.select("qid", "term", "qf", "idf")
    most = F.greatest(F.col("qf") * F.col("idf") * F.col("impact") * F.lit(UNIT) + 1, F.lit(0.0))
    heads = index.blocks.select("term", "slice", "impact").join(
        terms.select("qid", "term", "qf", "idf", "essential"), "term").withColumn("most", most)
    rest = terms.groupBy("qid").agg(F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))), F.lit(0.0))
                                    .alias("rest"), F.min("floor").alias("floor"))
    # slices that hold an essential term, bounded by its block and by what the other terms can add anywhere,
    # then by the blocks of all terms in the slice
    bounds = (heads.groupBy("qid", "slice").agg(F.sum(F.when(F.col("essential"), F.col("most"))).alias("first"),
                                                F.sum("most").alias("bound")).join(rest, "qid")
              .filter((F.col("first") + F.col("rest") >= F.col("floor")) & (F.col("bound") >= F.col("floor")))
              .select("qid", "slice", "bound"))
    bounds = written(bounds)
    bounds = written(top_n(bounds, ["qid"], [F.desc("bound"), "slice"], FIRST_SLICES, "place")
                     .withColumn("early", F.lit(True)).select("qid", "slice", "bound", "early")
                     .join(bounds, ["qid", "slice", "bound"], "right"))

    def scored(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select("qid", "slice")
        if seen is not None:
            seen.append(index.blocks.select("part", "term", "slice", "n").join(own, "term").join(wanted, ["qid", "slice"]))
        return written(_read(index, own, wanted, k1, b).groupBy("qid", "id").agg(F.sum("part").alias("part")))

    early = scored(bounds.filter("early"))
    raised = _floors(early.withColumnRenamed("part", "s"), n)
    late = scored(bounds.filter("early is null").join(raised, "qid", "left")
                  .filter(F.col("bound") >= F.coalesce("floor", lowest)))
    return early.unionByName(late)
