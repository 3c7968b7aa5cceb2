"""Dense retrieval: exact and cell-probed nearest neighbours, similarity matches, embeddings.

Distances are computed by NumPy on Arrow batches. Every task keeps only the best
rows per query, so pairs are never materialised:

* a query table below ``broadcast_bytes`` (measured) is broadcast and the
  vectors stay where they are;
* a bigger one is laid out with the vectors on a grid of equal hash blocks, and
  each grid cell is one bounded group, whatever the keys look like.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from .. import params as P
from .ranking import top_n

BROADCAST_BYTES = 32 << 20
BLOCK_ROWS = 16384
MERGE_SALTS = 16
BASE_BLOCK_BYTES = 64 << 20
#: Numbers in a score matrix: 32 MB, and as much again while it is made.
TILE = 1 << 22
#: Scores that far apart stay apart when they are rounded.
ROUNDING = 2e-6


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.empty((0, 0))


def _arrow_matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, straight from its Arrow buffer."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scores(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Rounded score matrix, smaller is better."""
    s = _rounded(_plain_scores(q, b, metric))
    return s + 0.0 if metric == "l2" else s


def _plain_scores(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The same before rounding, with one more matrix of that size at a time."""
    s = q @ b.T
    if metric == "l2":
        s *= -2
        s += (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :]
        return np.maximum(s, 0, out=s)
    s /= np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.negative(s, out=s)


def _rounded(s: np.ndarray) -> np.ndarray:
    return np.round(s, 6)


def _best(qi: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int):
    """First ``k`` entries per query in (score, id) order."""
    order = np.lexsort((ids, s, qi))
    qi, ids, s = qi[order], ids[order], s[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1] if len(qi) else np.array([], int)
    pos = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
    keep = pos < k
    return qi[keep], ids[keep], s[keep]


def _block_best(q, ids, b, k, metric, limit):
    """Best ``k`` of one block for every query; ``limit`` drops worse scores."""
    s = _plain_scores(q, b, metric)
    cut = np.full(len(q), np.inf)
    if s.shape[1] > k:
        # a score that is not a number comes last
        cut = np.fmin.reduce(s, axis=1) if k == 1 else np.partition(s, k - 1, axis=1)[:, k - 1]
        cut[np.isnan(cut)] = np.inf
    if limit is not None:
        cut = np.minimum(cut, limit)
    # only what can be among the best after rounding is rounded
    qi, bi = np.nonzero(s <= cut[:, None] + ROUNDING)
    s = _rounded(s[qi, bi]) + 0.0
    if limit is not None:
        keep = s <= limit
        qi, bi, s = qi[keep], bi[keep], s[keep]
    return _best(qi, ids[bi], s, k)


def _fold(q, batches, k, metric, limit):
    """Best ``k`` of all batches. A score matrix has at most ``TILE`` numbers, however large both sides are."""
    held, rows = None, 0
    for ids, b in batches:
        wide = max(1, min(len(b), TILE // 1024))
        step = max(1, TILE // wide)
        for at in range(0, len(ids), wide):
            for lo in range(0, len(q), step):
                qi, i, s = _block_best(q[lo:lo + step], ids[at:at + wide], b[at:at + wide], k, metric, limit)
                if not len(qi):
                    continue
                held = [] if held is None else held
                held.append((qi + lo, i, s))
                rows += len(qi)
            if held and rows > 8 * k * max(len(q), 1):
                held = [_best(*[np.concatenate(x) for x in zip(*held)], k)]
                rows = len(held[0][0])
    return None if held is None else _best(*[np.concatenate(x) for x in zip(*held)], k)


def _out_schema(queries: DataFrame, base: DataFrame) -> StructType:
    return StructType([StructField("qid", queries.schema["qid"].dataType),
                       StructField("id", base.schema["id"].dataType),
                       StructField("score", DoubleType())])


def _cell_best(k: int, metric: str, limit: float | None, schema: StructType):
    """Best ``k`` per query of one grid cell: tables with qid, qv and with id, bv."""
    out = to_arrow_schema(schema)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        best = None
        if left.num_rows and right.num_rows:
            b = _arrow_matrix(right.column("bv").combine_chunks())
            ids = right.column("id").to_numpy()
            best = _fold(_arrow_matrix(left.column("qv").combine_chunks()), [(ids, b)], k, metric, limit)
        if best is None:
            return out.empty_table()
        qids = left.column("qid").to_numpy()[best[0]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((qids, *best[1:]), out)], schema=out)

    return cell


def _nearest(queries: DataFrame, base: DataFrame, k: int, metric: str, limit: float | None,
             broadcast_bytes: int, block_rows: int, base_block_bytes: int) -> DataFrame:
    """(qid, v) x (id, v) -> partial best rows (qid, id, score), smaller is better."""
    queries = queries.select("qid", "v").filter(F.col("v").isNotNull())
    base = base.select("id", "v").filter(F.col("v").isNotNull())
    schema = _out_schema(queries, base)
    measured = queries.agg(F.count("*").alias("n"),
                           F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    if measured["n"] * (measured["dim"] * 8 + 64) <= broadcast_bytes:
        rows = queries.toPandas()  # measured above
        qids = rows["qid"].to_numpy()
        shared = queries.sparkSession.sparkContext.broadcast(_matrix(rows["v"]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = ((b.column("id").to_numpy(zero_copy_only=False), _arrow_matrix(b.column("v")))
                     for b in batches if b.num_rows)
            best = _fold(shared.value, pairs, k, metric, limit)
            if best is not None:
                yield pa.RecordBatch.from_pydict({
                    "qid": pa.array(qids[best[0]]), "id": pa.array(best[1]),
                    "score": pa.array(best[2])})

        return base.mapInArrow(scan, schema)

    n_base = base.count()
    q_blocks = -(-measured["n"] // block_rows)
    b_blocks = max(1, -(-n_base * measured["dim"] * 8 // base_block_bytes))
    # fresh names: both sides may come from the same table
    q = (queries.select(F.col("qid").alias("qid"), F.col("v").alias("qv"))
         .withColumn("gq", F.pmod(F.xxhash64("qid"), F.lit(q_blocks)))
         .withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(b_blocks - 1)))))
    b = (base.select(F.col("id").alias("id"), F.col("v").alias("bv"))
         .withColumn("gb", F.pmod(F.xxhash64("id"), F.lit(b_blocks)))
         .withColumn("gq", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))

    keys = [F.col("gq").cast("bigint"), F.col("gb").cast("bigint")]
    return (q.groupBy(*keys).cogroup(b.groupBy(*keys))
            .applyInArrow(_cell_best(k, metric, limit, schema), schema))


def knn(queries: DataFrame, base: DataFrame, k: int = P.DENSE_K,
        broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
        base_block_bytes: int = BASE_BLOCK_BYTES) -> DataFrame:
    """Exact ``k`` nearest by squared L2: (qid, id, dist, rank), ties by id."""
    part = _nearest(queries, base, k, "l2", None, broadcast_bytes, block_rows, base_block_bytes)
    # every task brings k rows per query: first merged per query and salt, then per query
    part = (part.withColumnRenamed("score", "dist")
            .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(MERGE_SALTS))))
    part = top_n(part, ["qid", "salt"], ["dist", "id"], k).select("qid", "id", "dist")
    return top_n(part, ["qid"], ["dist", "id"], k)


def best_match(queries: DataFrame, base: DataFrame, threshold: float,
               broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
               base_block_bytes: int = BASE_BLOCK_BYTES) -> DataFrame:
    """Most similar row per query with cosine strictly above ``threshold``, ties by id."""
    limit = -threshold - 1e-9
    part = _nearest(queries, base, 1, "cosine", limit, broadcast_bytes, block_rows,
                    base_block_bytes)
    best = part.groupBy("qid").agg(F.min(F.struct("score", "id")).alias("m"))
    return best.select("qid", F.col("m.id").alias("id"), (-F.col("m.score")).alias("similarity"))


# --- cells (approximate, for very large tables) --------------------------

def fit_cells(base: DataFrame, cells: int, seed: int = P.TOPIC_SEED, max_iter: int = 10):
    """KMeans cell centres: a (cells x dim) matrix, small by construction."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = base.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter).fit(feats)
    return np.array(model.clusterCenters())


def _cells_of(centres: np.ndarray, probe: int) -> Callable[[Column], Column]:
    shared = centres

    @F.pandas_udf("array<int>")
    def nearest(vs: pd.Series) -> pd.Series:
        s = _scores(_matrix(vs), shared, "l2")
        order = np.argsort(s, axis=1, kind="stable")[:, :probe]
        return pd.Series(list(order.astype(np.int32)))

    return nearest


def assign_cells(df: DataFrame, centres: np.ndarray) -> DataFrame:
    return df.withColumn("cell", F.get(_cells_of(centres, 1)(F.col("v")), 0))


def write_cells(base: DataFrame, centres: np.ndarray, path: str, mode: str = "append") -> None:
    """The stored index: vectors partitioned by cell, so a probe prunes directories."""
    assign_cells(base, centres).write.mode(mode).partitionBy("cell").parquet(path)


def knn_cells(queries: DataFrame, base: DataFrame, centres: np.ndarray, k: int = P.DENSE_K,
              probe: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``k`` nearest within the ``probe`` nearest cells of each query.

    ``base`` carries ``cell``. A cell's vectors are split into hash blocks sized
    by the cell's row count, and its queries likewise, so a cell that holds a
    third of the table is many groups.
    """
    sizes = base.groupBy("cell").agg(F.count("*").alias("rows"))  # one row per cell
    blocks = sizes.select("cell", F.ceil(F.col("rows") / block_rows).cast("int").alias("nb"))
    probes = queries.select(F.col("qid").alias("qid"), F.col("v").alias("qv"),
                            F.explode(_cells_of(centres, probe)(F.col("v"))).alias("cell"))
    asked = probes.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("nq"))
    grid = blocks.join(asked, "cell")  # at most one row per centre, so broadcast below

    def sides(prefix):
        return F.broadcast(grid.select("cell", F.col("nb").alias(f"{prefix}_nb"),
                                       F.col("nq").alias(f"{prefix}_nq")))

    stored = base.select(F.col("cell").alias("cell"), F.col("id").alias("id"), F.col("v").alias("bv"))
    b = (stored.join(sides("b"), "cell")
         .withColumn("gb", F.pmod(F.xxhash64("id"), F.col("b_nb")))
         .withColumn("gq", F.explode(F.sequence(F.lit(0), F.col("b_nq") - 1))))
    q = (probes.join(sides("q"), "cell")
         .withColumn("gq", F.pmod(F.xxhash64("qid"), F.col("q_nq")))
         .withColumn("gb", F.explode(F.sequence(F.lit(0), F.col("q_nb") - 1))))

    keys = [F.col("cell"), F.col("gq").cast("bigint"), F.col("gb").cast("bigint")]
    schema = _out_schema(queries, base)
    part = (q.groupBy(*keys).cogroup(b.groupBy(*keys))
            .applyInArrow(_cell_best(k, "l2", None, schema), schema))
    return top_n(part.withColumnRenamed("score", "dist"), ["qid"], ["dist", "id"], k)


# --- embedding -----------------------------------------------------------

@dataclass(frozen=True)
class Embedder:
    """A batch function ``fn(texts) -> vectors`` and how a task may call it.

    A call takes at most ``batch`` texts. After each one the task pauses, and after a
    failure it waits, twice as long each time. ``fn`` may be a hosted service.
    """

    fn: Callable[[list[str]], list[list[float]]]
    batch: int = P.EMBED_BATCH
    tries: int = P.EMBED_TRIES
    pause: float = 0.0
    backoff: float = 0.0
    sleep: Callable[[float], None] = time.sleep

    def call(self, texts: list[str]) -> list[list[float]]:
        """Vectors of at most ``batch`` texts; the last failure is raised."""
        for attempt in range(self.tries):
            try:
                found = self.fn(texts)
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                if self.pause:
                    self.sleep(self.pause)
                return found
            except Exception:
                if attempt == self.tries - 1:
                    raise
                if self.backoff:
                    self.sleep(self.backoff * 2**attempt)
        return []

    def vectors(self, texts: list[str]) -> tuple[list, list[str | None]]:
        """Vectors and errors; a batch that fails is halved until the texts at fault stand alone."""
        try:
            return list(self.call(texts)), [None] * len(texts)
        except Exception as e:
            if len(texts) == 1:
                return [None], [f"{type(e).__name__}: {e}"[:200]]
        half = len(texts) // 2
        left, right = self.vectors(texts[:half]), self.vectors(texts[half:])
        return left[0] + right[0], left[1] + right[1]


def embed(df: DataFrame, text_col: str, fn: Callable[[list[str]], list[list[float]]],
          out: str = "v", batch: int = P.EMBED_BATCH, tries: int = P.EMBED_TRIES) -> DataFrame:
    """Add vectors from a batch function ``fn(texts) -> vectors``, retried ``tries`` times."""
    schema = StructType(df.schema.fields
                        + StructType.fromDDL(f"{out} ARRAY<FLOAT>").fields)
    service = Embedder(fn, batch, tries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [str(x) for x in pdf[text_col]]
            vecs: list = []
            for lo in range(0, len(texts), batch):
                vecs.extend(service.call(texts[lo:lo + batch]))
            yield pdf.assign(**{out: vecs})

    return df.mapInPandas(run, schema)


def embed_or_fail(df: DataFrame, text_col: str, embedder: Embedder, out: str = "v",
                  error: str = "error") -> DataFrame:
    """Add vectors, and for rows that can't be embedded an error instead; no row ends the job.

    A null text is such a row.
    """
    schema = StructType(df.schema.fields
                        + StructType.fromDDL(f"{out} ARRAY<FLOAT>, {error} STRING").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(text_col).to_pylist()
            vecs: list = [None] * len(texts)
            errors: list[str | None] = ["no text"] * len(texts)
            at = [i for i, x in enumerate(texts) if x is not None]
            for lo in range(0, len(at), embedder.batch):
                part = at[lo:lo + embedder.batch]
                for i, v, e in zip(part, *embedder.vectors([texts[i] for i in part])):
                    vecs[i], errors[i] = v, e
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(vecs, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                names=[*rows.schema.names, out, error])

    return df.mapInArrow(run, schema)


def hash_embed(df: DataFrame, text_col: str, dim: int = 256, out: str = "v") -> DataFrame:
    """Offline embedding: hashed term counts weighted by idf, unit length; no Python."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from ..functions.text import tokenize

    toks = df.withColumn("_ts", tokenize(F.col(text_col)))
    tf = HashingTF(inputCol="_ts", outputCol="_tf", numFeatures=dim).transform(toks)
    weighted = IDF(inputCol="_tf", outputCol="_w").fit(tf).transform(tf)
    unit = Normalizer(inputCol="_w", outputCol="_u").transform(weighted)
    return unit.withColumn(out, vector_to_array("_u", "float32")).drop("_ts", "_tf", "_w", "_u")
