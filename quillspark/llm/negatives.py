"""Hard-negative mining: inner products bounded by segment summaries.

A vector is cut into segments; of each, mean and deviation are stored. By
Cauchy-Schwarz the inner product of two segments of m components lies within

    m * mean * mean' -+ m * deviation * deviation'

so the sums over segments bound a score. ``LEVELS`` cuts ever finer: a pair that a
level can't decide goes on to the next, and only what is left is scored exactly.

``first`` finds each anchor's best rows of its own label, ``between`` the best rows
of other labels within a window of scores below each of these. Anchors and rows
are dealt to hash blocks of bounded size, and every anchor block meets every row
block in a task of its own, which keeps the k best of each anchor; pairs are
never rows. A label, however common, is no grouping key.

Scores are whole numbers and exact: ``integers`` leaves out vectors whose squared
length reaches 2^61, so no inner product leaves a long.

Defined cases: vectors that are null, or hold a null or a number that is not
finite, take no part, nor do rows without id or label. Vectors of another length
are another space; empty ones score 0. Rows are told apart by place, not by id:
a repeated row is another row, and a repeated anchor an anchor of its own. Ties
go to the smaller id. A negative positive score has no window. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Segments per vector, coarse to fine.
LEVELS = (4, 16, 32)
ROW_BLOCK = 1 << 14
ANCHOR_BLOCK = 1 << 12
FLOAT_EXACT = 2.0**53


def integers(vectors: DataFrame, vec_id: str, value: str, label: Column, scale: float) -> DataFrame:
    """row, id, label and v (floor of ``scale`` times each component) of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    length = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x * F.lit(float(scale) ** 2))
    return (vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"),
                           label.cast("long").alias("label"), F.col(value).cast("array<double>").alias("v"))
            .where("id is not null and label is not null and v is not null").where(finite)
            .where(length < F.lit(2.0**61)).withColumn("v", scaled).withColumn("dim", F.size("v")))


def summaries(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Means, then deviations of the segments, each times the root of the segment's size."""
    n, dim = vectors.shape
    edges = np.arange(parts + 1) * dim // parts
    sizes = np.maximum(np.diff(edges), 1)
    padded = np.concatenate([np.zeros((n, 1)), np.cumsum(vectors, axis=1)], axis=1)
    mean = (padded[:, edges[1:]] - padded[:, edges[:-1]]) / sizes
    moved = vectors - np.repeat(mean, np.diff(edges), axis=1)
    padded = np.concatenate([np.zeros((n, 1)), np.cumsum(moved * moved, axis=1)], axis=1)
    spread = np.sqrt(np.maximum((padded[:, edges[1:]] - padded[:, edges[:-1]]) / sizes, 0))
    return np.concatenate([mean, spread], axis=1) * np.sqrt(np.tile(sizes, 2))


def _matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(whole), -1)


def _levels(dim: int) -> list[int]:
    return [parts for parts in LEVELS if parts < dim]


def _summary_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        made: list[np.ndarray] = [np.zeros(0)] * len(dims)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            v = _matrix(batch.column("v").take(pa.array(at)), np.float64)
            parts = [summaries(v, p) for p in _levels(int(dim))]
            for i, own in zip(at, np.concatenate(parts, axis=1) if parts else np.zeros((len(at), 0))):
                made[i] = own
        yield pa.record_batch([*batch.columns, pa.array(made, pa.list_(pa.float64()))],
                              names=[*batch.schema.names, "summary"])


def summarised(rows: DataFrame) -> DataFrame:
    """``rows`` (row, id, label, v, dim) with the stored summaries of all levels, written."""
    kind = "row long, id long, label long, v array<long>, dim int, summary array<double>"
    return written(rows.select("row", "id", "label", "v", "dim").mapInArrow(_summary_rows, kind))


class Block:
    """Rows of one block: exact vectors and the summaries of each level."""

    def __init__(self, table: pa.Table):
        self.row, self.id, self.label = [table.column(c).to_numpy() for c in ("row", "id", "label")]
        dim = int(table.column("dim")[0].as_py())
        self.v = _matrix(table.column("v"), np.int64)
        joined = _matrix(table.column("summary"), np.float64)
        cuts = np.cumsum([0] + [2 * p for p in _levels(dim)])
        self.levels = [joined[:, a:b] for a, b in zip(cuts, cuts[1:])]
        self.real = self.v.astype(np.float64)
        self.length = np.sqrt((self.real**2).sum(axis=1))

    def bounds(self, level: int, rows: np.ndarray, other: Block, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of ``rows`` with row ``i`` of ``other``."""
        mine, theirs = self.levels[level][rows], other.levels[level][i]
        half = mine.shape[1] // 2
        middle, wide = mine[:, :half] @ theirs[:half], mine[:, half:] @ theirs[half:]
        wide += 1e-9 * (1 + self.length[rows] * other.length[i])  # for the rounding of both sums
        return middle - wide, middle + wide

    def scores(self, rows: np.ndarray, other: Block, i: int) -> np.ndarray:
        """Exact inner products; sums below 2^53 are exact in doubles too, and faster there."""
        if len(rows) and float(self.length[rows].max()) * float(other.length[i]) < FLOAT_EXACT / 2:
            return (self.real[rows] @ other.real[i]).astype(np.int64)
        return self.v[rows] @ other.v[i]

    def order(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best: higher scores, then smaller ids."""
        if len(rows) > 4 * k:
            near = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
        else:
            near = np.arange(len(rows))
        return near[np.lexsort((self.row[rows[near]], self.id[rows[near]], -scores[near]))[:k]]


def positives(anchors: Block, i: int, block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block and scores: the k best of the anchor's label, itself left out."""
    rows = np.flatnonzero((block.label == anchors.label[i]) & (block.row != anchors.row[i]))
    for level in range(len(block.levels)):
        if len(rows) <= k:
            break
        low, high = block.bounds(level, rows, anchors, i)
        rows = rows[high >= -np.partition(-low, k - 1)[k - 1]]
    scores = block.scores(rows, anchors, i)
    best = block.order(rows, scores, k)
    return rows[best], scores[best]


def negatives(anchors: Block, i: int, block: Block, windows: list[tuple[int, int]],
              k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores (both ends inside): rows and scores of the k best of other labels."""
    rows = np.flatnonzero(block.label != anchors.label[i])
    for level in range(len(block.levels)):
        low, high = block.bounds(level, rows, anchors, i)
        keep = np.zeros(len(rows), bool)
        for least, most in windows:
            floor: float = least
            sure = np.flatnonzero((low >= least) & (high <= most))
            if len(sure) >= k:
                floor = max(floor, -np.partition(-low[sure], k - 1)[k - 1])
            keep |= (high >= floor) & (low <= most)
        rows = rows[keep]
    scores = block.scores(rows, anchors, i)
    found = []
    for least, most in windows:
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        best = inside[block.order(rows[inside], scores[inside], k)]
        found.append((rows[best], scores[best]))
    return found


def _grid(rows: DataFrame, anchors: DataFrame, row_block: int, anchor_block: int):
    """Both sides dealt to blocks, ready to be grouped together; gathers one row per vector length."""
    down = {r["dim"]: -(-r["n"] // anchor_block) for r in anchors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sizes = {r["dim"]: (-(-r["n"] // row_block), down[r["dim"]])
             for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect() if r["dim"] in down}
    shape = F.lit(None).cast("struct<across: int, down: int>")
    for dim, (a, d) in sizes.items():
        shape = F.when(F.col("dim") == dim, F.struct(F.lit(a).alias("across"), F.lit(d).alias("down"))).otherwise(shape)

    def dealt(side: DataFrame, own: str, other: str, name: str, twin: str) -> DataFrame:
        return (side.withColumn("shape", shape).where("shape is not null")
                .withColumn(name, F.pmod(F.xxhash64("row"), F.col(f"shape.{own}")).cast("int"))
                .withColumn(twin, F.explode(F.sequence(F.lit(0), F.col(f"shape.{other}") - 1)))
                # new columns: both sides come from one table
                .select(name, twin, *[F.col(c).alias(c) for c in side.columns]))

    grid = ["dim", "row_block", "anchor_block"]
    return (dealt(anchors, "down", "across", "anchor_block", "row_block").groupBy(*grid),
            dealt(rows, "across", "down", "row_block", "anchor_block").groupBy(*grid))


_POSITIVE = "anchor long, anchor_id long, row long, id long, score long"
_NEGATIVE = ("anchor long, anchor_id long, positive long, positive_id long, positive_score long, "
             "row long, id long, score long")


def _table(kind: str, rows: list[tuple]) -> pa.Table:
    names = [part.split()[0] for part in kind.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def first(rows: DataFrame, anchors: DataFrame, k: int, row_block: int = ROW_BLOCK,
          anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """The k best other rows of each anchor's label: anchor, anchor_id, row, id, score, rank."""
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            own, block = Block(left), Block(right)
            for i in range(len(own.row)):
                at, scores = positives(own, i, block, k)
                found += [(own.row[i], own.id[i], block.row[j], block.id[j], s) for j, s in zip(at, scores)]
        return _table(_POSITIVE, found)

    left, right = _grid(rows, anchors, row_block, anchor_block)
    best = W.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row")
    return (left.cogroup(right).applyInArrow(cell, _POSITIVE)
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))


def between(rows: DataFrame, anchors: DataFrame, chosen: DataFrame, k: int, least_share: int = 80,
            most_share: int = 100, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """For each positive in ``chosen`` the k best rows of other labels whose score is between
    ``least_share`` and ``most_share`` hundredths of the positive's."""
    asked = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "row", "id", "score")))
                                         .alias("asked"))
    wanted = (anchors.join(asked, anchors["row"] == asked["anchor"])
              .select(*[anchors[c] for c in anchors.columns], *[F.col(f"asked.{c}").alias(f"asked_{c}")
                                                                for c in ("row", "id", "score")]))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            own, block = Block(left), Block(right)
            asked_rows, asked_ids, asked_scores = [left.column(f"asked_{c}").to_pylist()
                                                   for c in ("row", "id", "score")]
            for i in range(len(own.row)):
                windows = [(-(-least_share * s // 100), most_share * s // 100) for s in asked_scores[i]]
                hits = negatives(own, i, block, windows, k)
                for row, vec, score, (at, scores) in zip(asked_rows[i], asked_ids[i], asked_scores[i], hits):
                    found += [(own.row[i], own.id[i], row, vec, score, block.row[j], block.id[j], s)
                              for j, s in zip(at, scores)]
        return _table(_NEGATIVE, found)

    left, right = _grid(rows, wanted, row_block, anchor_block)
    best = W.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), "id", "row")
    return (left.cogroup(right).applyInArrow(cell, _NEGATIVE)
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))


def mine(rows: DataFrame, is_anchor: Callable[[DataFrame], Column] | Column, n_positives: int = 5,
         n_negatives: int = 5, least_share: int = 80, most_share: int = 100, row_block: int = ROW_BLOCK,
         anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` are those of ``integers``; ``is_anchor`` is a condition on them.
    """
    stored = summarised(rows)
    anchors = stored.where(is_anchor(stored) if callable(is_anchor) else is_anchor)
    chosen = written(first(stored, anchors, n_positives, row_block, anchor_block))
    found = between(stored, anchors, chosen, n_negatives, least_share, most_share, row_block, anchor_block)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
