"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector o is centred, scaled to length 1 and turned by a random rotation; the
signs of its components are its code, kept as packed words. Beside it are stored
three numbers: the length of o - c, the inner product of the turned vector with its own
code, and that of the centre with o - c. A query is turned likewise and quantised to ``PLANES``
bit planes, so its inner product with a code is a weighted sum of bit counts of
code AND plane. The numbers turn it into an estimate of the inner product
with the vector, whose error is at most

    (EPSILON * sqrt((1 - w^2) / w^2 / (dim - 1)) + sqrt(dim) * step / 2 / w) * |o - c| * |q - c|

but for a vanishing share of rotations (w: the inner product with the own code, step: the
quantisation step of the unit query). A query takes first the vectors of the best lower bounds,
reranks them on the original vectors, and then all whose upper bound reaches the k-th score found.

Codes are made once and written. Rows and queries are dealt to hash blocks of bounded size, and
every query block meets every row block in a task of its own, which keeps the k best. The
original vectors travel beside the codes: at 64 components the bounds leave a third of all
rows, and these pairs would be far more rows than the vectors are.

Defined cases: vectors that are null, empty, zero, or hold a null or a number
that is not finite take no part, nor do rows without vec_id. Vectors of another
length are another space. Rows are told apart by place: those that repeat a vec_id are
candidates of their own, also for each other, and a repeated query has its ranks
twice. Ties go to the smaller vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

EPSILON = 3.0
SEED = 20240517
VECTOR_BLOCK = 1 << 15
QUERY_BLOCK = 1 << 13
PLANES = 6


@functools.lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, length of the centred vector, and its inner product with the own code."""
    dim = vectors.shape[1]
    moved = vectors - centre
    length = np.linalg.norm(moved, axis=1)
    turned = moved @ rotation(dim)
    own = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    with np.errstate(invalid="ignore", divide="ignore"):
        own = np.where(length > 0, own / length, 1.0)
    return packed(turned > 0), length, own


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words."""
    octets = np.packbits(bits, axis=1)
    octets = np.pad(octets, ((0, 0), (0, -octets.shape[1] % 8)))
    return np.ascontiguousarray(octets).view(np.uint64)


class Index:
    """One block of rows: their codes and numbers for the estimate, their vectors for the rerank."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, words: np.ndarray,
                 length: np.ndarray, own: np.ndarray, centre: np.ndarray):
        self.rows, self.ids, self.vectors, self.words, self.centre = rows, ids, vectors, words, centre
        dim = vectors.shape[1]
        self.length, self.scale = length, length / np.maximum(own, 1e-12)
        wide = np.sqrt(np.maximum(0, 1 - own ** 2)) / np.maximum(own, 1e-12)
        # a hair for the rounding of the estimate itself
        self.error = EPSILON * wide / math.sqrt(max(1, dim - 1)) * length + 1e-9 * (1 + length)
        self.base = vectors @ centre - centre @ centre
        self.ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products with a query, and their errors."""
        dim = len(query)
        moved = query - self.centre
        turned = moved @ rotation(dim)
        least, most = float(turned.min()), float(turned.max())
        step = (most - least) / (2**PLANES - 1)
        level = np.rint((turned - least) / step).astype(np.int64) if step else np.zeros(dim, np.int64)
        planes = packed((level[None, :] >> np.arange(PLANES)[:, None]) & 1)
        counts = np.zeros(len(self.words), np.int64)
        for j, plane in enumerate(planes):
            counts += np.bitwise_count(self.words & plane).sum(axis=1, dtype=np.int64) << j
        # the sum over the set bits of the quantised query, and over all of its components
        chosen, whole = step * counts + least * self.ones, step * level.sum() + least * dim
        middle = self.scale * (2 * chosen - whole) / math.sqrt(dim) + self.base + query @ self.centre
        reach = float(np.linalg.norm(moved))
        return middle, self.error * reach + self.scale * math.sqrt(dim) * step / 2 + 1e-9 * (1 + reach * self.length)

    def search(self, rows: np.ndarray, queries: np.ndarray, k: int):
        """For each query (by its row) its k best others (all, if fewer): positions and scores."""
        for row, query in zip(rows, queries):
            middle, slack = self.bounds(query)
            low = middle - slack
            mine = self.rows == row
            low[mine] = -np.inf
            n = len(low) - int(mine.sum())
            if n <= 0:
                continue
            take = min(k, n)
            first = np.argpartition(-low, take - 1)[:take]
            bar = exact(self.vectors[first], query).min()
            reached = middle + slack >= bar
            reached[first] = True
            reached[mine] = False
            maybe = np.flatnonzero(reached)
            near = self.vectors[maybe] @ query  # in any order of addition; the last digits follow below
            kept = maybe[near >= -np.partition(-near, take - 1)[take - 1] - 1e-9 * (1 + np.abs(near).max())]
            scores = exact(self.vectors[kept], query)
            best = np.lexsort((self.rows[kept], self.ids[kept], -scores))[:take]
            yield row, kept[best], scores[best]


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up component by component, so equal rows score alike."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += vectors[:, j] * query[j]
    return total


def usable(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """row, key, v (doubles) and dim of the rows that take part."""
    v = F.col("v")
    good = (F.col("key").isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0))
    return (vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"),
                           F.col(value).cast("array<double>").alias("v"))
            .where(good).withColumn("dim", F.size("v")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


_CODED = "row long, key long, v array<double>, dim int, code binary, length double, own double"


def _code_rows(centres: dict[int, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                words, length, own = encode(_matrix(part.column("v")), centres[int(dim)])
                yield pa.record_batch([*part.columns, pa.array([w.tobytes() for w in words], pa.binary()),
                                       pa.array(length), pa.array(own)],
                                      names=[*part.schema.names, "code", "length", "own"])
    return run


def coded(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """The rows of ``usable`` with their codes, written."""
    return written(rows.select("row", "key", "v", "dim").mapInArrow(_code_rows(centres), _CODED))


_HIT = "query long, query_id long, row long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", value: str = "embedding",
            vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows of every query row.

    ``is_query`` is a condition on the column ``key``.
    """
    rows = written(usable(vectors, key, value))
    # one small row per vector length; the mean is over all rows
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()}
    centres = {r["dim"]: np.array([m for _, m in sorted(r["means"])]) for r in (
        rows.select("dim", F.posexplode("v")).groupBy("dim", "pos").agg(F.avg("col").alias("mean"))
        .groupBy("dim").agg(F.collect_list(F.struct("pos", "mean")).alias("means")).collect())}
    blocks = {d: (-(-n // vector_block), -(-q // query_block)) for d, (n, q) in sizes.items() if q}
    if not blocks:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shape = F.create_map(*[x for d, (n, q) in blocks.items() for x in (
        F.lit(d), F.struct(F.lit(n).alias("v"), F.lit(q).alias("q")))])[F.col("dim")]
    stored = coded(rows, centres)

    def dealt(side: DataFrame, own: str, other: str, columns: list[str]) -> DataFrame:
        return (side.withColumn("shape", shape).where("shape is not null")
                .withColumn(f"{own}_block", F.pmod(F.xxhash64("row"), F.col(f"shape.{own}")).cast("int"))
                .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"shape.{other}") - 1)))
                # new columns: both sides come from one table
                .select(*[F.col(c).alias(c) for c in ("dim", "v_block", "q_block", *columns)]))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        if len(left) and len(right):
            centre = centres[left.column("dim")[0].as_py()]
            words = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint64).reshape(len(right), -1)
            index = Index(*[right.column(c).to_numpy() for c in ("row", "key")], _matrix(right.column("v")), words,
                          *[right.column(c).to_numpy() for c in ("length", "own")], centre)
            names = dict(zip(left.column("row").to_pylist(), left.column("key").to_pylist()))
            for row, at, scores in index.search(left.column("row").to_numpy(), _matrix(left.column("v")), k):
                for column, part in zip(found, (np.full(len(at), row), np.full(len(at), names[int(row)]),
                                                index.rows[at], index.ids[at], scores)):
                    column.append(part)
        names = [part.split()[0] for part in _HIT.split(", ")]
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(
            found, (*[pa.int64()] * 4, pa.float64()))], names=names)

    grid = ["dim", "v_block", "q_block"]
    hits = (dealt(stored.where(is_query), "q", "v", ["row", "key", "v"]).groupBy(*grid)
            .cogroup(dealt(stored, "v", "q", ["row", "key", "v", "code", "length", "own"]).groupBy(*grid))
            .applyInArrow(cell, _HIT))
    best = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
