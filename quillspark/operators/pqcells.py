"""Nearest neighbours from stored cells of product-quantised codes.

Vectors belong to the cell of their nearest centre. What is left of a vector beside the
centre is cut into subspaces and each piece replaced by the number of its nearest codeword:
one byte per subspace. The stored table is partitioned by cell and dealt to files of
bounded size inside it, so a cell that holds a third of all vectors is many files.

A search reads the codes of the cells near a query and adds up distances from a table of
query piece by codeword. Only the ``rerank`` rows of the least sums are scored on their
vectors. Cells come in two steps: the nearest first; of the others, those that can still
hold a neighbour: no vector of a cell is nearer than the centre's distance less the cell's
radius. Which cells are read is a join with the partition column, so Spark prunes the rest.

Centres are fitted on all vectors, codebooks on the ``SAMPLE`` rows or so of the least id
hashes; all vectors are stored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .. import params as P
from ..session import written
from .dense import _arrow_matrix, fit_cells
from .ranking import top_n

SAMPLE = 16_384
CODEWORDS = 256
SUBSPACES = 32
FILE_ROWS = 1 << 16
QUERY_BLOCK = 1 << 12
TILE = 1024


@dataclass
class Model:
    """centres (cells x dim) and codebooks (subspaces x codewords x width); the last subspace is padded with 0."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def _lloyd(rows: np.ndarray, k: int, seed: int, turns: int = 8) -> np.ndarray:
    """k-means in memory, for a bounded sample; fewer rows than codewords repeat some."""
    rng = np.random.default_rng(seed)
    found = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(turns):
        near = np.concatenate([_squares(rows[i:i + TILE], found).argmin(1) for i in range(0, len(rows), TILE)])
        n = np.bincount(near, minlength=k)
        for d in range(rows.shape[1]):
            sums = np.bincount(near, rows[:, d], minlength=k)
            found[:, d] = np.where(n > 0, sums / np.maximum(n, 1), found[:, d])
    return found


def _cells(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row, and the distance to it."""
    parts = [_squares(vectors[i:i + TILE], centres) for i in range(0, len(vectors), TILE)]
    cell = np.concatenate([p.argmin(1) for p in parts]) if parts else np.zeros(0, int)
    return cell, np.linalg.norm(vectors - centres[cell], axis=1)


def _pieces(rows: np.ndarray, subspaces: int, width: int) -> np.ndarray:
    out = np.zeros((len(rows), subspaces * width))
    out[:, :rows.shape[1]] = rows
    return out.reshape(len(rows), subspaces, width)


def fit(base: DataFrame, cells: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS,
        sample: int = SAMPLE, seed: int = P.TOPIC_SEED) -> Model:
    """Centres and codebooks of (id, v)."""
    base = base.select("id", "v").filter(F.col("v").isNotNull())
    centres = fit_cells(base, cells, seed)
    n = base.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * sample / max(n, 1)))
    rows = base.filter(share).limit(2 * sample).toPandas()  # bounded: about ``sample`` rows
    vectors = np.stack(rows["v"].to_numpy()).astype(np.float64)
    cell, _ = _cells(vectors, centres)
    width = -(-centres.shape[1] // subspaces)
    pieces = _pieces(vectors - centres[cell], subspaces, width)
    return Model(centres, np.stack([_lloyd(pieces[:, m], codewords, seed + m) for m in range(subspaces)]))


def encode(vectors: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, distance to its centre, and codes of every row."""
    cell, far = _cells(vectors, model.centres)
    pieces = _pieces(vectors - model.centres[cell], model.books.shape[0], model.books.shape[2])
    codes = np.zeros(pieces.shape[:2], np.uint8)
    for m, book in enumerate(model.books):
        for i in range(0, len(pieces), TILE):
            codes[i:i + TILE, m] = _squares(pieces[i:i + TILE, m], book).argmin(1)
    return cell, far, codes


def store(base: DataFrame, model: Model, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write (id, v) to ``path``: vectors (by cell), and cells (cell, n, radius)."""
    id_type = base.schema["id"].dataType
    schema = StructType([StructField("id", id_type), *StructType.fromDDL(
        "v array<double>, cell int, far double, code binary").fields])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far, codes = encode(_arrow_matrix(batch.column(1)), model)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(far),
                                       pa.array([c.tobytes() for c in codes], pa.binary())],
                                      names=["id", "v", "cell", "far", "code"])

    made = written(base.select("id", F.col("v").cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
                   .mapInArrow(rows, schema))
    cells = made.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    files = base.sparkSession.read.parquet(f"{path}/cells").select(
        "cell", F.ceil(F.col("n") / file_rows).cast("int").alias("files"))
    dealt = (made.join(F.broadcast(files), "cell")  # one row per centre
             .withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")).cast("int")).drop("files", "far"))
    (dealt.repartition("cell", "file").sortWithinPartitions("cell", "file", "id")
     .write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def _probes(queries: DataFrame, model: Model, cells: DataFrame, probe: int) -> DataFrame:
    """(qid, qv, cell, place, least): the ``probe`` nearest cells, and the least distance a vector there can have."""
    radius = np.full(len(model.centres), -np.inf)  # one number per centre
    for r in cells.select("cell", "radius").collect():
        radius[r["cell"]] = r["radius"]
    held = np.flatnonzero(radius > -np.inf)
    schema = StructType([queries.schema["qid"], *StructType.fromDDL(
        "qv array<double>, cell int, place int, least double").fields])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _arrow_matrix(batch.column(1))
            for i in range(0, len(q), TILE):
                far = np.sqrt(_squares(q[i:i + TILE], model.centres[held]))
                order = np.argsort(far, axis=1, kind="stable")[:, :probe]
                at = np.repeat(np.arange(i, i + len(far)), order.shape[1])
                near = np.take_along_axis(far, order, 1).ravel()
                cell = held[order.ravel()]
                part = batch.take(pa.array(at))
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(cell, pa.int32()),
                     pa.array(np.tile(np.arange(order.shape[1]), len(far)), pa.int32()),
                     pa.array(np.maximum(near - radius[cell] - 1e-9, 0) ** 2)],
                    names=["qid", "qv", "cell", "place", "least"])

    asked = queries.select("qid", F.col("v").cast("array<double>").alias("qv")).filter(F.col("qv").isNotNull())
    return asked.mapInArrow(rows, schema)


def _estimates(probes: DataFrame, stored: DataFrame, model: Model, keep: int) -> DataFrame:
    """(qid, id, cell, estimate): per task and query the ``keep`` least; only codes are read."""
    blocks = probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("down"))
    files = stored.select("cell", "file").distinct()
    asked = (probes.select("qid", "qv", "cell").join(F.broadcast(blocks), "cell")  # one row per centre
             .withColumn("row", F.pmod(F.xxhash64("qid"), F.col("down")).cast("int")).drop("down")
             .join(files, "cell"))
    codes = (stored.select("id", "code", "cell", "file").join(F.broadcast(blocks), "cell")
             .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).drop("down"))
    schema = StructType([probes.schema["qid"], stored.schema["id"], StructField("cell", IntegerType()),
                         StructField("estimate", DoubleType())])
    names = [f.name for f in schema]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(left) and len(right):
            cell = left.column("cell")[0].as_py()
            q = _arrow_matrix(left.column("qv").combine_chunks())
            pieces = _pieces(q - model.centres[cell], model.books.shape[0], model.books.shape[2])
            code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(right), -1)
            ids = right.column("id").combine_chunks()
            every = np.arange(code.shape[1])
            for qid, piece in zip(left.column("qid").to_pylist(), pieces):
                table = ((model.books - piece[:, None, :]) ** 2).sum(axis=2)
                total = table[every, code].sum(axis=1)
                best = np.argpartition(total, keep - 1)[:keep] if len(total) > keep else np.arange(len(total))
                for column, value in zip(out, ([qid] * len(best), ids.take(pa.array(best)).to_pylist(),
                                               [cell] * len(best), total[best].tolist())):
                    column += value
        kinds = [left.schema.field("qid").type, right.schema.field("id").type, pa.int32(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    key = ["cell", "file", "row"]
    # new columns: both sides use the stored table
    codes = codes.select(*[F.col(c).alias(c) for c in codes.columns])
    return asked.groupBy(*key).cogroup(codes.groupBy(*key)).applyInArrow(task, schema)


def _exact(chosen: DataFrame, queries: DataFrame, stored: DataFrame) -> DataFrame:
    """(qid, id, dist) of the chosen rows on their vectors."""
    q = queries.select("qid", F.col("v").cast("array<double>").alias("qv"))
    square = F.aggregate(F.zip_with("qv", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return (chosen.select("qid", "id", "cell").join(stored.select("id", "v", "cell"), ["cell", "id"])
            .join(q, "qid").select("qid", "id", F.round(square, 6).alias("dist")))


def search(queries: DataFrame, spark: SparkSession, path: str, model: Model, k: int = P.DENSE_K, probe: int = 14,
           rerank: int | None = None, first: int = 4) -> DataFrame:
    """(qid, id, dist, rank) of ``k`` near vectors per query (qid, v), ties by id.

    ``rerank`` rows per query are scored exactly, k of them after the ``first`` cells if that leaves as many
    for the rest. Unless given, these are 4 k, but at most a quarter of all rows and k at least.
    """
    stored, cells = vectors(spark, path), spark.read.parquet(f"{path}/cells")
    if rerank is None:
        rerank = min(4 * k, (cells.agg(F.sum("n")).first()[0] or 0) // 4)
    rerank = max(k, rerank)
    probes = written(_probes(queries, model, cells, probe))
    near = _estimates(probes.filter(F.col("place") < first), stored, model, rerank)
    near = written(top_n(near, ["qid"], ["estimate", "id"], rerank, "at"))
    soon = k if rerank >= 2 * k else 0
    early = written(_exact(near.filter(F.col("at") <= soon), queries, stored))
    last = (early.groupBy("qid").agg(F.count("*").alias("n"), F.max("dist").alias("worst"))
            .filter(F.col("n") >= k).select("qid", "worst"))
    # the stop rule: a cell that holds nothing nearer than the k-th so far is not read
    later = (probes.filter(F.col("place") >= first).join(last, "qid", "left")
             .filter(F.col("worst").isNull() | (F.col("least") <= F.col("worst") + 1e-6)).drop("worst"))
    more = _estimates(written(later), stored, model, rerank)
    rest = top_n(near.filter(F.col("at") > soon).drop("at").unionByName(more), ["qid"], ["estimate", "id"],
                 rerank - soon, "at")
    late = _exact(written(rest), queries, stored)
    return top_n(early.unionByName(late), ["qid"], ["dist", "id"], k)
